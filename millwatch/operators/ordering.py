"""Ordering work that no single task has to do alone.

A plain ``row_number`` over a machine puts the whole machine in one task, and
one machine may hold a third of all readings.  The operators here keep the
plain window while every machine is small and otherwise cut the timeline into
cells: number inside the cell, add the rows of the earlier cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwatch.session import stage

# Most rows a window group may hold before it is cut into cells.
GROUP_ROWS = 2_000_000
# Cell widths tried in turn, in seconds; the last resort also cuts by row id.
CELL_SECONDS = (30 * 86_400, 86_400, 3_600, 60, 1)
# Cells that one prefix-sum group takes at most.
_CELLS_PER_BLOCK = 65_536

_SLOT_BITS = 33


def seconds_of(moment: Column) -> Column:
    """Whole seconds since 1970 of a zone-free timestamp."""
    days = F.datediff(F.to_date(moment), F.lit("1970-01-01").cast("date")).cast("long")
    seconds_in_day = F.hour(moment) * 3_600 + F.minute(moment) * 60 + F.second(moment)
    return days * 86_400 + seconds_in_day


def fraction_of(moment: Column) -> Column:
    """Microseconds beyond the whole second.

    Zones differ by whole seconds, so these are the same in whichever the session reads a
    zone-free timestamp; taken as a whole number, as decimals cost several times as much.
    """
    return F.pmod(F.unix_micros(moment.cast("timestamp")), F.lit(1_000_000))


def micros_of(moment: Column) -> Column:
    """Whole microseconds since 1970 of a zone-free timestamp."""
    return seconds_of(moment) * 1_000_000 + fraction_of(moment)


#: Cell of null times and ids, before all others.
_FIRST = -(1 << 62)


def largest_group(df: DataFrame, *keys: Column | str) -> int:
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).agg(F.max("rows")).first()
    return int(row[0] or 0)


def _cells(time: str, ident: str, width: int | None, group_rows: int) -> tuple[Column, Column]:
    """Order-keeping cell columns; without a width, one microsecond by blocks of ids.

    Null times and null ids get the first cell, where a sort puts them.
    """
    if width is not None:
        cell = F.floor(seconds_of(F.col(time)) / width).cast("long")
        return F.coalesce(cell, F.lit(_FIRST)), F.lit(0).cast("long")
    block = F.floor(F.col(ident) / group_rows).cast("long")
    return F.coalesce(micros_of(F.col(time)), F.lit(_FIRST)), F.coalesce(block, F.lit(_FIRST))


def _counts(df: DataFrame, *keys: str) -> tuple[DataFrame, int]:
    """Rows per key as a small staged table, and the largest number."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    counts = stage(counted, "counts")
    return counts, int(counts.agg(F.max("_rows")).first()[0] or 0)


def choose_cells(
    df: DataFrame, key: str, time: str, ident: str, group_rows: int
) -> tuple[tuple[Column, Column] | None, DataFrame]:
    """The widest cells that keep every group small, and the rows per group.

    No cells if none are needed; the counts are then per key.  Ids are unique,
    so the last resort bounds a group by construction.
    """
    keys = df.select(key, time, ident)
    counts, largest = _counts(keys, key)
    if largest <= group_rows:
        return None, counts
    for width in (*CELL_SECONDS, None):
        cells = _cells(time, ident, width, group_rows)
        marked = keys.withColumns({"_cell": cells[0], "_part": cells[1]})
        counts, largest = _counts(marked, key, "_cell", "_part")
        if largest <= group_rows:
            break
    return cells, counts


def _cell_offsets(counts: DataFrame, key: str) -> DataFrame:
    """Rows of the key in earlier cells and in all, per (key, cell, part).

    The sums run over blocks of cells first and inside each block second, so
    that a long timeline is shared among tasks too.
    """
    counts = counts.withColumn("_block", F.floor(F.col("_cell") / _CELLS_PER_BLOCK))
    earlier = (Window.unboundedPreceding, -1)
    by_key = Window.partitionBy(key)
    blocks = (
        counts.groupBy(key, "_block")
        .agg(F.sum("_rows").alias("_block_rows"))
        .withColumn(
            "_before_block",
            F.coalesce(
                F.sum("_block_rows").over(by_key.orderBy("_block").rowsBetween(*earlier)),
                F.lit(0),
            ),
        )
        .withColumn("_all", F.sum("_block_rows").over(by_key))
        .drop("_block_rows")
    )
    inside = Window.partitionBy(key, "_block").orderBy("_cell", "_part").rowsBetween(*earlier)
    return (
        counts.withColumn("_before_cell", F.coalesce(F.sum("_rows").over(inside), F.lit(0)))
        .join(blocks, [key, "_block"])
        .select(
            key,
            "_cell",
            "_part",
            (F.col("_before_block") + F.col("_before_cell")).alias("_before"),
            "_all",
        )
    )


def with_positions(
    df: DataFrame,
    key: str,
    time: str,
    ident: str,
    group_rows: int = GROUP_ROWS,
    position: str = "position",
    size: str = "group_size",
) -> DataFrame:
    """Add each row's 1-based place in its key's timeline and the key's row count.

    One shuffle of the rows either way: the counts that are joined back are
    broadcast if Spark finds them small, or hashed on the columns the window
    is partitioned by already.  Rows with a null key are left out.
    """
    df = df.where(F.col(key).isNotNull())
    cells, counts = choose_cells(df, key, time, ident, group_rows)
    if cells is None:
        timeline = Window.partitionBy(key).orderBy(time, ident)
        placed = df.withColumn(position, F.row_number().over(timeline).cast("long")).join(
            counts.withColumnRenamed("_rows", size), key
        )
        return placed.select(*df.columns, position, size)
    marked = df.withColumns({"_cell": cells[0], "_part": cells[1]})
    inside = Window.partitionBy(key, "_cell", "_part").orderBy(time, ident)
    return (
        marked.withColumn("_inner", F.row_number().over(inside))
        .join(_cell_offsets(counts, key), [key, "_cell", "_part"])
        .withColumns({position: F.col("_before") + F.col("_inner"), size: F.col("_all")})
        .select(*df.columns, position, size)
    )


def with_earlier_rows(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    payload: Column,
    rows: int,
    group_rows: int = GROUP_ROWS,
) -> tuple[DataFrame, list[str]]:
    """Add a column for each of the last ``rows`` payloads of a row's timeline, its own first.

    ``position`` numbers the timeline from 1.  The timeline is cut into chunks;
    the rows at the end of a chunk are also handed to the next one, so every
    window is complete and no window group exceeds a chunk.  Null where the timeline
    has no such row.  A lag reads one row; a moving list would be filled anew for each row.
    """
    offset = F.col(position) - 1
    chunk = F.floor(offset / group_rows)
    hand_on = offset % group_rows >= group_rows - (rows - 1)
    copies = F.when(hand_on, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    timeline = Window.partitionBy(*keys, "_chunk").orderBy(position)
    names = [f"_back{n}" for n in range(rows)]
    seen = (
        df.withColumn("_home", chunk)
        .withColumns({"_chunk": F.explode(copies), names[0]: payload})
        .withColumns({name: F.lag(names[0], n).over(timeline) for n, name in enumerate(names) if n})
        .where(F.col("_chunk") == F.col("_home"))
    )
    return seen.drop("_home", "_chunk"), names


def with_trailing_rows(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    payload: Column,
    rows: int,
    name: str,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Add the last ``rows`` payloads of each row's timeline as a list, itself included and last."""
    seen, names = with_earlier_rows(df, keys, position, payload, rows, group_rows)
    return seen.withColumn(name, F.array_compact(F.array(*reversed(names)))).drop(*names)


def with_previous(
    df: DataFrame,
    key: str,
    time: str,
    ident: str,
    column: str,
    name: str,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Add the column's value in the key's previous row (null in its first, and without a key)."""
    keyed, unkeyed = df.where(F.col(key).isNotNull()), df.where(F.col(key).isNull())
    none = unkeyed.withColumn(name, F.lit(None).cast(df.schema[column].dataType))
    if largest_group(keyed, key) <= group_rows:
        timeline = Window.partitionBy(key).orderBy(time, ident)
        return keyed.withColumn(name, F.lag(column).over(timeline)).unionByName(none)
    placed = with_positions(keyed, key, time, ident, group_rows, "_place", "_size")
    paired = with_trailing_rows(
        placed, [key], "_place", F.struct(F.col(column).alias("v")), 2, "_pair", group_rows
    )
    value = F.when(F.size("_pair") == 2, F.col("_pair")[0]["v"])
    return paired.withColumn(name, value).drop("_place", "_size", "_pair").unionByName(none)


def with_global_row_number(
    df: DataFrame, order: Sequence[Column | str] | None, name: str, kept: Sequence[Column | str] = ("*",)
) -> DataFrame:
    """Number all rows from 1 in the given order, or in the frame's own order.

    The rows are range-partitioned and sorted, numbered inside each partition
    and staged; one small table, with a row per partition, holds the offsets.
    Columns that only the order needs are not staged if the ``kept`` ones are named.
    """
    placed = (df.orderBy(*order) if order else df).select(*kept)
    staged = stage(placed.withColumn("_slot", F.monotonically_increasing_id()), "numbered")
    partition = F.shiftright("_slot", _SLOT_BITS)
    ordered = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy(partition.alias("_partition"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            "_partition",
            F.coalesce(F.sum("_rows").over(ordered), F.lit(0)).alias("_offset"),
        )
    )
    inner = F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    # One row per write task; staged, so that Spark knows its size before it plans the join.
    return (
        staged.withColumn("_partition", partition)
        .join(stage(offsets, "offsets"), "_partition")
        .withColumn(name, F.col("_offset") + inner + 1)
        .drop("_slot", "_partition", "_offset")
    )


def with_rank_by_group(
    df: DataFrame, group: str, order: Sequence[Column | str], name: str
) -> DataFrame:
    """Unique rank 1..n inside each of a few large groups.

    Each group may hold a quarter of all rows and most of its rows may tie, so
    the rank comes from one global numbering, restarted at every group.
    """
    numbered = with_global_row_number(df, [F.col(group), *order], "_number")
    # a row per group, staged: a join of known small size needs no shuffle of the rows on the group
    starts = stage(numbered.groupBy(group).agg(F.min("_number").alias("_start")), "starts")
    return (
        numbered.join(starts, group)
        .withColumn(name, F.col("_number") - F.col("_start") + 1)
        .drop("_number", "_start")
    )
