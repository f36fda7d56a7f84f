"""Records of comma-separated files whose quoted fields may hold line breaks, split in parallel.

A file is read as lines, by as many tasks as it has blocks.  Whether a line begins
inside quotes depends on all lines before it, but a line can only do four things
with that: keep it, turn it round, or settle it either way.  Such steps can be
combined, so every block is summed up under both assumptions, the blocks of a file
are combined in order, and each line then knows whether it begins a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millwatch.session import stage

# Where a reader stands: before a field, in a plain field, inside quotes, behind a quote that may have closed them.
_FIELD, _PLAIN, _QUOTED, _CLOSED = range(4)


def _outside(text: Column, empty: int | Column) -> Column:
    """State after a stretch of text outside quotes."""
    empty = empty if isinstance(empty, Column) else F.lit(empty)
    return F.when(text == "", empty).when(F.endswith(text, F.lit(",")), _FIELD).otherwise(_PLAIN)


def _ends_quoted(line: Column, quoted: bool) -> Column:
    """Whether a line ends inside quotes, given how it begins.

    A quote opens only at the start of a field and is a plain sign in the middle of
    one; inside quotes two quotes stand for one.
    """
    stretches = F.split(line, '"')

    def step(state: Column, text: Column) -> Column:
        behind = F.when(text == "", _CLOSED).otherwise(_outside(text, _CLOSED))
        return F.when(state.isin(_FIELD, _CLOSED), _QUOTED).when(state == _PLAIN, _outside(text, _PLAIN)).otherwise(behind)

    begin = F.lit(_QUOTED) if quoted else _outside(stretches[0], _FIELD)
    last = F.aggregate(F.slice(stretches, F.lit(2), F.size(stretches)), begin.cast("int"), lambda s, t: step(s, t).cast("int"))
    return F.when(F.contains(line, F.lit('"')), last == _QUOTED).otherwise(F.lit(quoted))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the block they come from, their order in it, and how they end under both assumptions."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").alias("_line"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_slot"),
    )
    return lines.withColumns(
        {f"_end_{name}": _ends_quoted(F.col("_line"), q).cast("int") for name, q in (("out", False), ("in", True))}
    )


def has_quoted_breaks(lines: DataFrame) -> bool:
    """Whether any line, begun outside quotes, ends inside them."""
    return not lines.where("_end_out = 1").limit(1).isEmpty()


def _running(df: DataFrame, keys: list[str], order: list[str], out: str, in_: str) -> DataFrame:
    """Add ``_begin_out`` and ``_begin_in``: the state before each row under both assumptions on the first one.

    A row that ends alike either way settles the state; one that ends differently from
    how it began turns it round.  So the state is that of the last settling row, turned
    round as often as rows since then do.
    """
    rows = Window.partitionBy(*keys).orderBy(*order)
    turned = df.withColumn("_turns", F.sum(F.when((F.col(out) == 1) & (F.col(in_) == 0), 1).otherwise(0)).over(rows) % 2)
    settled = F.when(F.col(out) == F.col(in_), F.col(out).bitwiseXOR(F.col("_turns")))
    before = rows.rowsBetween(Window.unboundedPreceding, -1)
    placed = turned.withColumn("_settled", settled).withColumns(
        {"_last": F.last("_settled", ignorenulls=True).over(before), "_so_far": F.coalesce(F.last("_turns").over(before), F.lit(0))}
    )
    return placed.withColumns(
        {
            f"_begin_{name}": F.coalesce(F.col("_last"), F.lit(entry)).bitwiseXOR(F.col("_so_far")).cast("int")
            for name, entry in (("out", 0), ("in", 1))
        }
    ).drop("_turns", "_settled", "_last", "_so_far")


#: Bytes of text that one task sorts by block or by record; short lines take twenty times as much there.
_PART_BYTES = 8 << 20


def _dealt(rows: DataFrame, size: int, *keys: str) -> DataFrame:
    """Rows by key in parts of ``_PART_BYTES``, where the session's own number of parts would make larger ones."""
    parts = -(-size // _PART_BYTES)
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys) if parts > usual else rows


def quoted_records(lines: DataFrame, size: int) -> DataFrame:
    """``_record`` (its lines joined by line feeds) and ``_number``, from 1 in file order, without each file's header.

    Blank lines between records are no records.  Quotes that are never closed are
    refused.  Lines are shuffled once, by block; only records of several lines are
    gathered, each by its number, also where a block ends inside them.  ``size`` is the
    bytes of all lines: a task sorts no more of them where there are more in all.
    """
    blank = F.trim(F.regexp_replace("_line", "\r$", "")) == ""
    placed = _running(_dealt(lines, size, "_file", "_start"), ["_file", "_start"], ["_slot"], "_end_out", "_end_in")
    inside = Window.partitionBy("_file", "_start").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    counted = stage(
        placed.withColumns(
            {
                f"_rank_{name}": F.sum(F.when((F.col(f"_begin_{name}") == 0) & ~blank, 1).otherwise(0)).over(inside)
                for name in ("out", "in")
            }
        ).withColumns(
            # how the line ends, given how its block begins
            {
                f"_stop_{name}": F.when(F.col(f"_begin_{name}") == 0, F.col("_end_out")).otherwise(F.col("_end_in"))
                for name in ("out", "in")
            }
        ),
        "lines",
    )
    blocks = counted.groupBy("_file", "_start").agg(
        *[F.max_by(f"_stop_{name}", "_slot").alias(f"_stop_{name}") for name in ("out", "in")],
        *[F.max(f"_rank_{name}").alias(f"_rank_{name}") for name in ("out", "in")],
    )
    # the first block of a file begins outside quotes
    entered = _running(blocks, ["_file"], ["_start"], "_stop_out", "_stop_in").withColumn("_enter", F.col("_begin_out"))
    ordered = Window.orderBy("_file", "_start")
    rank = F.when(F.col("_enter") == 0, F.col("_rank_out")).otherwise(F.col("_rank_in"))
    stop = F.when(F.col("_enter") == 0, F.col("_stop_out")).otherwise(F.col("_stop_in"))
    numbered = entered.withColumns({"_rows": rank, "_stop": stop}).withColumns(
        {
            "_offset": F.coalesce(F.sum("_rows").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_files": F.dense_rank().over(Window.orderBy("_file")),
        }
    )
    starts = stage(
        numbered.select(
            F.col("_file").alias("_of"), F.col("_start").alias("_at"), "_enter", "_offset", "_files", "_stop",
            F.min("_offset").over(Window.partitionBy("_file")).alias("_first"),
            (F.max("_start").over(Window.partitionBy("_file")) == F.col("_start")).alias("_final"),
        ),
        "blocks",
    )
    open_file = starts.where("_final and _stop = 1").first()
    if open_file is not None:
        raise ValueError(f"The file is not a valid CSV: a quote is never closed in {open_file['_of']}.")

    outside = F.col("_enter") == 0
    # a row for each block: sent to the lines, which need no further shuffle by block
    known = counted.join(F.broadcast(starts), (F.col("_file") == F.col("_of")) & (F.col("_start") == F.col("_at"))).select(
        "_line", "_start", "_slot", "_files", "_first",
        (F.col("_offset") + F.when(outside, F.col("_rank_out")).otherwise(F.col("_rank_in"))).alias("_place"),
        F.when(outside, F.col("_begin_out")).otherwise(F.col("_begin_in")).alias("_begin"),
        F.when(outside, F.col("_stop_out")).otherwise(F.col("_stop_in")).alias("_ends"),
        blank.alias("_blank"),
    )
    rows = known.where("(_begin = 1 or not _blank) and _place > _first + 1")  # the first record of a file is its header
    number = F.col("_place") - F.col("_files")
    line = F.struct("_start", "_slot", "_line")
    parts = rows.where("_begin = 1 or _ends = 1").select(number.alias("_number"), line.alias("_piece"))
    one = rows.where("_begin = 0 and _ends = 0").select(F.col("_line").alias("_record"), number.alias("_number"))
    several = (
        _dealt(parts, size, "_number")
        .groupBy("_number")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("_piece")), lambda x: x["_line"]), "\n").alias("_record"))
    )
    both = one.unionByName(several)
    return both.withColumn("_record", F.regexp_replace("_record", "\r$", ""))
