"""Shared parts: column checks and word hashes computed on whole Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step looks at; a longer text is a step of its own.
STEP_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []

#: Bytes of one Arrow batch where rows are texts or lists; both sides hold a batch several times.
BATCH_BYTES = 4 << 20

#: Byte classes: 0 ASCII white space, 1 part of a word, 2 other signs.
SPACE_ONLY = np.ones(256, np.uint8)
SPACE_ONLY[[0x20, *range(0x09, 0x0E)]] = 0
LETTERS = np.full(256, 2, np.uint8)
LETTERS[[0x20, *range(0x09, 0x0E)]] = 0
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans run inside hand over batches of ``BATCH_BYTES`` at most, whatever the length of their rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def is_training_row(doc_id: Column) -> Column:
    """Rows whose labels may be learnt from: four of five, by a checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, STEP_BYTES) + 1
        with np.errstate(over="ignore"):
            _powers[:] = [
                np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))))
                for b in (_BASE, _INVERSE)
            ]
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of a run of texts: where they are, what they hash to and whose they are."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # for each text, its first word; one entry more than texts
    _sums: np.ndarray

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges; equal bytes have equal hashes wherever they stand."""
        return mix((self._sums[end] - self._sums[start]) * _power_tables(len(self.data))[1][start])


def hash_words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, lower: bool) -> Words:
    """Runs of bytes of one class, except white space, inside each text.

    ``offsets`` are the bounds of the texts in ``data``.  Hashes are 64-bit
    polynomials of the bytes, read off running sums, so the cost does not depend
    on the number of words.
    """
    n = len(data)
    kind = classes[data]
    turn = np.empty(n + 1, bool)
    turn[0] = turn[n] = True
    np.not_equal(kind[1:], kind[:-1], out=turn[1:n])
    turn[offsets] = True
    at = np.flatnonzero(turn)
    start, end = at[:-1], at[1:]
    word = kind[start] > 0
    start, end = start[word], end[word]
    power, inverse = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    values = (LOWER[data] if lower else data).astype(np.uint64)
    values += np.uint64(1)
    values *= power[:n]
    np.cumsum(values, out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * inverse[start])
    return Words(data, start, end, hashes, np.searchsorted(start, offsets), sums)


def text_runs(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts, about STEP_BYTES each.

    Null texts are empty.  The bytes are views of the Arrow buffer.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + n + 1].astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(bounds, bounds[row] + STEP_BYTES, side="right")) - 1
        stop = min(n, max(row + 1, stop))
        yield row, stop, data[bounds[row] : bounds[stop]], bounds[row : stop + 1] - bounds[row]
        row = stop


def word_runs(texts: pa.Array, classes: np.ndarray, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    for row, stop, data, offsets in text_runs(texts):
        if len(data) == 0:
            none = np.zeros(0, np.int64)
            sums = np.zeros(1, np.uint64)
            yield row, stop, Words(data, none, none, none.astype(np.uint64), np.zeros(stop - row + 1, np.int64), sums)
        else:
            yield row, stop, hash_words(data, offsets, classes, lower)
