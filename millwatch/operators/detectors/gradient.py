"""Training of small networks on all rows, by gradient sums inside Spark.

Rows are packed once into blocks: a block holds a few hundred rows, chosen by a hash
of their ids and sorted by id, so it is the same whatever the layout of the table.
Every evaluation of the loss is one pass: tasks sum loss and gradient of their blocks,
each block rounded to a fixed point, and whole numbers are summed.  So the result does
not depend on the number of tasks or their order, and a lost task only repeats its own
sums.  The driver holds the parameters, a few thousand numbers, and takes
quasi-Newton steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch import fixed
from millwatch.session import stage

#: Rows of a block on average.
BLOCK_ROWS = 256
#: Fixed point of the sums; entries of a block's gradient are held to this many bits before the point.
_UNIT = float(1 << 22)
_BOUND = float(1 << 20)

#: (parameters, rows, targets) -> (sum of losses, its gradient by the parameters)
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[float, np.ndarray]]


#: Bytes of blocks that one task packs, and tasks for each core, so that passes over the blocks keep all cores busy.
_TASK_BYTES = 64 << 20
_TASKS_PER_CORE = 4


def pack_blocks(
    df: DataFrame, ident: str, values: Column, target: Column, rows: int, block_rows: int = BLOCK_ROWS, kind: str = "float64"
) -> DataFrame:
    """One row for each block: its values, a fixed number for each row, and its targets, as bytes of ``kind``.

    Every pass reads the blocks again; bytes go from file to numpy as they are.
    """
    blocks = max(1, -(-rows // block_rows))
    entry = F.struct(F.col(ident).alias("i"), values.alias("v"), target.cast("double").alias("t"))
    entries = df.select(F.pmod(F.xxhash64(ident, F.lit(7)), F.lit(blocks)).alias("_block"), entry.alias("_entry"))
    width = 8 * fixed.WINDOW_ROWS * 8  # about what a row may take
    tasks = max(_TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, rows * width // _TASK_BYTES)
    packed = (
        entries.repartition(min(blocks, tasks), "_block").groupBy("_block").agg(F.sort_array(F.collect_list("_entry")).alias("_rows"))
    )
    lists = packed.select(F.flatten(F.transform("_rows", lambda r: r["v"])).alias("values"), F.transform("_rows", lambda r: r["t"]).alias("targets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array([_numbers(column, row).astype(kind).tobytes() for row in range(batch.num_rows)], pa.binary()) for column in batch.columns]
            counts = pa.array([len(column) for column in batch.column(1)], pa.int32())
            yield pa.RecordBatch.from_arrays([*columns, counts], ["values", "targets", "rows"])

    return stage(lists.mapInArrow(run, "values binary, targets binary, rows int"), "blocks")


#: Rows of a block of a timeline: few enough that what is computed on them stays near the core.
_TIMELINE_ROWS = 2_048


def pack_timelines(
    df: DataFrame, keys: Sequence[str], position: str, features: Sequence[str], target: Column, rows: int, window: int, group_rows: int
) -> DataFrame:
    """Timelines as blocks of consecutive rows, from which a kernel reads each row's trailing window.

    A row is kept once and not in the windows of all that follow it: a block holds
    ``window - 1`` rows ahead of its own, with target -1, and a timeline's first row is
    repeated ahead of it, as in the windows themselves.  Timelines are cut into chunks as
    they are there, so that none has to pass one task.
    """
    offset, ahead = F.col(position) - 1, window - 1
    chunk = F.floor(offset / group_rows)
    copies = F.when(offset % group_rows >= group_rows - ahead, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    width = len(features)
    placed = df.select(
        *keys, F.col(position).alias("_position"), chunk.alias("_home"), F.explode(copies).alias("_chunk"),
        *[F.col(name).cast("float").alias(f"_v{i}") for i, name in enumerate(features)], target.cast("float").alias("_target"),
    ).withColumn("_target", F.when(F.col("_chunk") == F.col("_home"), F.col("_target")).otherwise(F.lit(-1.0).cast("float")))
    tasks = max(_TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, rows * 4 * (width + 1) // _TASK_BYTES)
    ordered = placed.repartition(max(1, min(tasks, -(-rows // _TIMELINE_ROWS))), *keys, "_chunk").sortWithinPartitions(*keys, "_chunk", "_position")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros((ahead, width), np.float32)
        for batch in batches:
            if not batch.num_rows:
                continue
            first = batch.column(0).to_numpy() == 1
            times = np.where(first, window, 1)
            targets = np.full(int(times.sum()), -1, np.float32)
            targets[np.cumsum(times) - 1] = batch.column(1).to_numpy()
            values = np.column_stack([batch.column(2 + i).to_numpy() for i in range(width)])
            values = np.concatenate([last, np.repeat(values, times, axis=0)])
            targets = np.concatenate([np.full(ahead, -1, np.float32), targets])
            last = values[len(values) - ahead :].copy()
            blocks = []
            for start in range(ahead, len(values), _TIMELINE_ROWS):
                part = slice(start - ahead, start + _TIMELINE_ROWS)
                marked = targets[part].copy()
                marked[:ahead] = -1
                blocks.append((values[part].tobytes(), marked.tobytes(), len(marked)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*blocks), (pa.binary(), pa.binary(), pa.int32()))],
                ["values", "targets", "rows"],
            )

    narrow = ordered.select("_position", "_target", *[f"_v{i}" for i in range(width)])
    return stage(narrow.mapInArrow(run, "values binary, targets binary, rows int"), "timelines")


def _numbers(column: pa.Array, row: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False)


def _block_numbers(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Values, a row for each of the block's rows, and targets."""
    for row, count in enumerate(batch.column(2).to_pylist()):
        values, targets = (batch.column(i)[row].as_buffer() for i in range(2))
        kind = np.dtype(f"f{targets.size // count}")
        yield np.frombuffer(values, kind).reshape(count, -1), np.frombuffer(targets, kind)


def gradient_sums(blocks: DataFrame, kernel: Kernel, parameters: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss and gradient summed over all rows: one aggregate with a row for each parameter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(parameters) + 1, np.int64)
        for batch in batches:
            for values, targets in _block_numbers(batch):
                loss, gradient = kernel(parameters, values, targets)
                sums = np.nan_to_num(np.concatenate(([loss], gradient)), nan=0.0, posinf=_BOUND, neginf=-_BOUND)
                total += np.rint(np.clip(sums, -_BOUND, _BOUND) * _UNIT).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["place", "total"])

    sums = blocks.mapInArrow(run, "place int, total bigint").groupBy("place").agg(F.sum("total").alias("total"))
    found = np.zeros(len(parameters) + 1)
    for row in sums.collect():
        found[row["place"]] = row["total"] / _UNIT
    return float(found[0]), found[1:]


def minimise(
    evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]],
    start: np.ndarray,
    iterations: int,
    memory: int = 8,
    tolerance: float = 1e-6,
) -> np.ndarray:
    """Limited-memory quasi-Newton descent; a step is halved until the loss falls enough."""
    at, (loss, slope) = start.astype(np.float64), evaluate(start)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        direction = slope.copy()
        factors = []
        for move, change in reversed(moves):
            factor = (move @ direction) / (move @ change)
            factors.append(factor)
            direction -= factor * change
        if moves:
            move, change = moves[-1]
            direction *= (move @ change) / (change @ change)
        else:
            direction /= max(1.0, float(np.linalg.norm(slope)))
        for (move, change), factor in zip(moves, reversed(factors)):
            direction += move * (factor - (change @ direction) / (move @ change))
        fall = float(slope @ direction)
        if fall <= 0:
            moves.clear()
            direction, fall = slope.copy(), float(slope @ slope)
        step = 1.0
        for _ in range(12):
            there = at - step * direction
            new_loss, new_slope = evaluate(there)
            if new_loss <= loss - 1e-4 * step * fall:
                break
            step /= 2
        else:
            return at
        move, change = there - at, new_slope - slope
        if move @ change > 1e-12:
            moves = [*moves[1 - memory :], (move, change)] if memory > 1 else [(move, change)]
        gain, at, loss, slope = loss - new_loss, there, new_loss, new_slope
        if gain <= tolerance * max(abs(loss), tolerance):
            break
    return at


def train(
    df: DataFrame, ident: str, values: Column, target: Column, rows: int, kernel: Kernel, start: Sequence[float] | np.ndarray,
    iterations: int, ridge: float = 1e-5, kind: str = "float64",
) -> np.ndarray:
    """Parameters that make the mean loss over all rows small; ``ridge`` holds them back a little.

    Kernels see rows of ``kind``; parameters, sums and steps are double in any case.
    """
    blocks = pack_blocks(df, ident, values, target, rows, kind=kind)
    return train_on(blocks, rows, kernel, start, iterations, ridge)


def train_on(
    blocks: DataFrame, rows: int, kernel: Kernel, start: Sequence[float] | np.ndarray, iterations: int, ridge: float = 0.0
) -> np.ndarray:
    """The same on packed rows."""

    def evaluate(parameters: np.ndarray) -> tuple[float, np.ndarray]:
        loss, gradient = gradient_sums(blocks, kernel, parameters)
        return (
            loss / rows + ridge * float(parameters @ parameters) / 2,
            gradient / rows + ridge * parameters,
        )

    return minimise(evaluate, np.asarray(start, np.float64), iterations)
