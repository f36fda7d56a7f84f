"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry.

Components are scaled to whole numbers and vectors cut into equal parts; every part
position has a codebook of its own, moved over a few rounds to the means of the parts
that chose it.  The nearest entry is searched through memoised grid cells: a part
falls into a coarse cell, whose box tells which entries can be nearest to any point
in it.  An entry whose least distance to the box exceeds the largest distance of some
other entry is dominated and never tried.  Tasks remember the entries of a cell, and
only those are evaluated exactly.  All arithmetic is in integers, so codes, errors and
codebooks do not depend on the layout of the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwatch.session import stage

#: Width of a cell in scaled units, and cells that a task remembers for each part position.
CELL = 256
CELLS = 1 << 15
#: Largest scaled component; squared distances of wide parts stay inside 64 bits.
LARGEST = 1 << 26


def _scaled(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows kept, all their components as integers, their lengths)."""
    length = pc.list_value_length(column)
    there = ~np.asarray(length.is_null())
    size = np.asarray(length.fill_null(0)).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    end = np.cumsum(size)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    kept = there & (bad[end] == bad[end - size])
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(flat[np.repeat(kept, size)] * scale)
    if len(whole) and np.abs(whole).max() > LARGEST:
        raise ValueError(f"Vector components beyond {LARGEST // scale} cannot be coded.")
    return kept, whole.astype(np.int64), size[kept]


def whole_vectors(df: DataFrame, vector: str, keep: list[str], scale: int = 4096) -> DataFrame:
    """``keep`` and ``vector`` as array<bigint> of floor(scale * x), without rows that have no finite vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, whole, size = _scaled(batch.column(0), scale)
            offsets = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
            found = pa.ListArray.from_arrays(offsets, pa.array(whole))
            others = [c.filter(pa.array(rows)) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([*others, found], [*keep, vector])

    schema = T.StructType([df.schema[name] for name in keep] + [T.StructField(vector, T.ArrayType(T.LongType()))])
    return df.select(F.col(vector).alias("_v"), *keep).mapInArrow(run, schema)


class Cells:
    """Nearest entries of one part position, by remembered candidates of grid cells.

    A cell is found by a hash of its corner; a part whose corner differs from the one
    remembered under that hash is held against all entries.
    """

    def __init__(self, entries: np.ndarray, cell: int = CELL, most: int = CELLS) -> None:
        self.entries, self.cell, self.most = entries, cell, most
        width = entries.shape[1]
        self.factors = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(width)], np.uint64)
        self.slots: dict[int, int] = {}
        self.corners, self.masks = np.zeros((0, width), np.int64), np.zeros((0, len(entries)), bool)

    def _candidates(self, corner: np.ndarray) -> np.ndarray:
        """For each box, which entries no other entry dominates: least distance against the least largest one."""
        middle = (2 * self.cell * corner + (self.cell - 1))[:, None, :]
        gap = np.abs(2 * self.entries[None] - middle)
        far = gap + (self.cell - 1)
        near = np.maximum(gap - (self.cell - 1), 0)
        return np.einsum("ijk,ijk->ij", near, near) <= np.einsum("ijk,ijk->ij", far, far).min(1)[:, None]

    def _remember(self, keys: list[int], corner: np.ndarray) -> None:
        if len(self.slots) + len(keys) > self.most:
            self.slots.clear()
            self.corners, self.masks = self.corners[:0], self.masks[:0]
        begin = len(self.corners)
        masks = [self._candidates(corner[i : i + 1024]) for i in range(0, len(corner), 1024)]
        self.corners = np.concatenate((self.corners, corner))
        self.masks = np.concatenate((self.masks, *masks))
        self.slots.update(zip(keys, range(begin, begin + len(keys))))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of every part; ties go to the lower entry."""
        rows, width = parts.shape
        if width == 0 or rows == 0:
            return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        corner = parts // self.cell
        keys, first, place = np.unique(corner.view(np.uint64) @ self.factors, return_index=True, return_inverse=True)
        names = keys.tolist()
        missing = [i for i, name in enumerate(names) if name not in self.slots]
        if missing and len(self.slots) + len(missing) > self.most:
            missing = list(range(len(names)))  # the memory is full and starts anew
        if missing:
            self._remember([names[i] for i in missing], corner[first[missing]])
        slot = np.array([self.slots[name] for name in names])[place]
        masks = self.masks[slot]
        masks[(self.corners[slot] != corner).any(1)] = True
        row, entry = np.nonzero(masks)
        gap = parts[row] - self.entries[entry]
        distance = np.einsum("ij,ij->i", gap, gap)
        starts = np.concatenate(([0], np.cumsum(masks.sum(1))[:-1]))
        least = np.minimum.reduceat(distance, starts)
        hits = np.flatnonzero(distance == least[row])
        lowest = hits[np.concatenate(([True], row[hits][1:] != row[hits][:-1]))]
        return entry[lowest], least


def _matrix(column: pa.Array, parts: int, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), parts, width)


def _sums(codebooks: np.ndarray, cell: int):
    """Sums of the parts that choose each entry: one row for each task, entry and position."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(book, cell) for book in codebooks]
        total = np.zeros((parts, entries, width), np.int64)
        count = np.zeros((parts, entries), np.int64)
        for batch in batches:
            values = _matrix(batch.column(0), parts, width)
            for p in range(parts):
                chosen, _ = cells[p].nearest(values[:, p])
                np.add.at(total[p], chosen, values[:, p])
                count[p] += np.bincount(chosen, minlength=entries)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(part, width).astype(np.int32)),
                pa.array(np.repeat(entry, width).astype(np.int32)),
                pa.array(np.tile(np.arange(width, dtype=np.int32), len(part))),
                pa.array(np.repeat(count[part, entry], width)),
                pa.array(total[part, entry].ravel()),
            ],
            ["part", "entry", "position", "n", "total"],
        )

    return run


def fit_codebooks(
    vectors: DataFrame, vector: str, order: list[str], parts: int = 8, entries: int = 16, rounds: int = 6, cell: int = CELL
) -> np.ndarray:
    """Codebooks as an array (part, entry, position), from all rows of ``whole_vectors``.

    The first entries are the parts of the least rows by ``order`` (nulls last; rows
    alike there by their vector); there are fewer if the table has fewer rows.  Every
    round is one pass whose result has a row for each entry and position.
    """
    first = vectors.orderBy(*[F.col(c).asc_nulls_last() for c in order], vector).select(vector).limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    books = np.array([row[0] for row in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = vectors.select(vector).mapInArrow(_sums(books, cell), "part int, entry int, position int, n bigint, total bigint")
        merged = sums.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        for row in merged.collect():
            books[row["part"], row["entry"], row["position"]] = row["total"] // row["n"]
    return books


def encode(vectors: DataFrame, vector: str, keep: list[str], codebooks: np.ndarray, cell: int = CELL) -> DataFrame:
    """``keep``, ``code`` (a byte for each part) and ``error``, the squared distance to the coded vector."""
    parts, entries, width = codebooks.shape
    if entries > 256:
        raise ValueError("A code has one byte for each part; at most 256 entries fit.")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(book, cell) for book in codebooks]
        for batch in batches:
            values = _matrix(batch.column(0), parts, width)
            code = np.zeros((len(values), parts), np.uint8)
            error = np.zeros(len(values), np.int64)
            for p in range(parts):
                code[:, p], distance = cells[p].nearest(values[:, p])
                error += distance
            offsets = np.arange(len(values) + 1, dtype=np.int32) * parts
            codes = pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(code)])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], codes, pa.array(error)], [*keep, "code", "error"])

    schema = T.StructType(
        [vectors.schema[name] for name in keep] + [T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())]
    )
    return vectors.select(F.col(vector).alias("_v"), *keep).mapInArrow(run, schema)


def decode(codes: DataFrame, codebooks: np.ndarray, scale: int = 4096, code: str = "code", vector: str = "vector") -> DataFrame:
    """The frame with ``vector``, the entries that its codes name, on the scale of the source."""
    parts, _, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(batch.schema.get_field_index(code))
            chosen = np.array([np.frombuffer(c.as_py(), np.uint8) for c in names], np.int64).reshape(len(names), parts)
            values = codebooks[np.arange(parts)[None], chosen].reshape(-1) / scale
            offsets = pa.array(np.arange(len(names) + 1) * parts * width, pa.int32())
            found = pa.ListArray.from_arrays(offsets, pa.array(values))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, vector])

    return codes.mapInArrow(run, T.StructType([*codes.schema, T.StructField(vector, T.ArrayType(T.DoubleType()))]))


def compress_vectors(
    df: DataFrame,
    vector: str = "embedding",
    ident: str = "vec_id",
    label: str = "label",
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
    cell: int = CELL,
) -> tuple[DataFrame, np.ndarray]:
    """(ident, label, code, error, label_error) of every row with a finite vector, and the codebooks.

    Null vectors and vectors with null or infinite components are left out.  Null ids
    are kept and come last in the order of ids, rows with one id in the order of their
    vectors; null labels are one label.  An empty table gives no rows and empty
    codebooks.  All vectors must have one length, a multiple of ``parts``, and
    components of at most 16384 at the scale of 4096: anything else is refused by
    name.  Other columns are left out, whatever their names.

    Vectors are scaled once into a staged table that every round reads.  Errors are
    summed by label with partial sums first; the sums, a row for each label, are staged,
    so Spark knows their size before it joins them.
    """
    vectors = stage(whole_vectors(df, vector, [ident, label], scale), "vectors")
    ends = vectors.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if ends[0] != ends[1] or (ends[0] or 0) % parts:
        raise ValueError(f"Vectors need one length, a multiple of {parts}; found {ends[0]} to {ends[1]}.")
    books = fit_codebooks(vectors, vector, [ident], parts, entries, rounds, cell)
    if books.shape[1] == 0:
        books = np.zeros((parts, 1, 0), np.int64)
    coded = stage(encode(vectors, vector, [ident, label], books, cell), "codes")
    totals = stage(coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error")), "label_errors")
    found = coded.join(totals, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
    return found, books
