"""Document fingerprints by locally consistent parsing.

A text is read as signs.  On each level equal neighbours are joined to powers,
then deterministic coin tossing (the lowest bit in which a sign differs from the
one before, twice more through small tables) labels each sign with one of a few
values, and phrases end where a label is a local maximum.  A phrase is named by a
hash of its signs and becomes a sign of the next level.  Cuts depend on a few
neighbours only, so equal substrings have equal phrases inside, wherever they
stand.  The fingerprint keeps the least name in each of ``SLOTS`` classes of
names of the second and later levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch.llm.common import mix
from millwatch.session import stage

SLOTS = 128
_EMPTY = 0xFFFF
_SALT = np.uint64(0x632BE59BD9B4E019)


def _toss_table(values: int) -> np.ndarray:
    """label(x after y) = 2 * (lowest differing bit) + (that bit of x); x = y is not used."""
    x, y = np.meshgrid(np.arange(values), np.arange(values), indexing="ij")
    low = (x ^ y) & -(x ^ y)
    bit = np.zeros_like(low)
    for b in range(8):
        bit[low == 1 << b] = b
    return (2 * bit + ((x >> bit) & 1)).astype(np.uint8)


_TOSS = _toss_table(128).ravel()


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6 of signs whose neighbours differ; neighbouring labels differ too.  ``first``: where texts begin."""
    low = np.zeros_like(x)
    np.bitwise_xor(x[1:], x[:-1], out=low[1:])
    low &= -low
    low[first] = 1
    bit = np.bitwise_count(low - x.dtype.type(1))
    label = (2 * bit + ((x >> bit.astype(x.dtype)) & x.dtype.type(1)).astype(np.uint8)).astype(np.uint8)
    for _ in range(3):
        code = label.astype(np.int16)
        code <<= 7
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[first] = label[first] ^ 1
        code |= before
        label = _TOSS[code]
    return label


def parse_level(x: np.ndarray, level: int, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases that the signs ``x`` are cut into, and where each text begins among them.

    ``first`` holds where each of several texts, none empty, begins in ``x``; a
    text is parsed as if it stood alone.
    """
    first = np.zeros(1, np.int64) if first is None else first
    tag = np.uint64(level * int(_SALT) % (1 << 64))
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    new[first] = True
    begin = np.flatnonzero(new)
    if len(begin) < len(x):
        length = np.diff(np.append(begin, len(x)))
        x = x[begin].astype(np.uint64)
        power = np.flatnonzero(length > 1)
        x[power] = mix(x[power] * np.uint64(3) + length[power].astype(np.uint64) * _SALT)
        first = np.searchsorted(begin, first)
    n = len(x)
    label = _labels(x, first)
    cut = np.zeros(n, bool)
    np.logical_and(label[1:-1] > label[:-2], label[1:-1] > label[2:], out=cut[1:-1])
    cut[np.append(first[1:], n) - 1] = False
    cut[first] = True
    begin = np.flatnonzero(cut)
    size = np.diff(np.append(begin, n))
    place = np.arange(n, dtype=np.uint64) - np.repeat(begin, size).astype(np.uint64)
    place += np.uint64(1)
    place *= _SALT
    parts = (x.astype(np.uint64) + place) * (place | np.uint64(1))
    parts ^= parts >> np.uint64(29)
    parts *= np.uint64(0xBF58476D1CE4E5B9)
    return mix(np.add.reduceat(parts, begin) + tag + size.astype(np.uint64)), np.searchsorted(begin, first)


def sketches(texts: list[str]) -> np.ndarray:
    """A row for each text: the least name of the second and later levels in each slot, 65535 where there is none."""
    out = np.full((len(texts), SLOTS), _EMPTY, np.uint16)
    flat = out.ravel()
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    doc = np.flatnonzero(length)
    x = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int32)
    first = (np.cumsum(length) - length)[doc]
    level = 0
    while len(doc):
        level += 1
        x, first = parse_level(x, level, first)
        size = np.diff(np.append(first, len(x)))
        own = np.repeat(doc, size)
        done = np.repeat(size == 1, size)
        use = slice(None) if level >= 2 else done
        slot = own[use] * SLOTS + (x[use] & np.uint64(SLOTS - 1)).astype(np.int64)
        np.minimum.at(flat, slot, ((x[use] >> np.uint64(40)) % np.uint64(_EMPTY)).astype(np.uint16))
        x, doc, size = x[~done], doc[size > 1], size[size > 1]
        first = np.cumsum(size) - size
    return out


def sketch(text: str) -> np.ndarray:
    return sketches([text])[0]


def as_bytes(fingerprint: np.ndarray) -> bytes:
    return fingerprint.astype(">u2").tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots among those that either fills: estimates the share of common phrases; 1 for two empty ones."""
    used = (a != _EMPTY) | (b != _EMPTY)
    return float(np.count_nonzero((a == b) & used) / np.count_nonzero(used)) if used.any() else 1.0


def _edited(text: str, after: str) -> str:
    piece = len(text) // 4
    return text[: len(text) - piece] + after[:piece]


def _row(doc_id: int | None, text: str, edited: str, own: np.ndarray, other: np.ndarray, after: np.ndarray) -> tuple:
    digest = hashlib.sha256(edited.encode()).digest()
    return doc_id, len(text), digest, as_bytes(own), as_bytes(other), likeness(own, other), likeness(own, after)


#: Names and digests stay bytes until the end: half the size in the staged table.
_RESULT = "doc_id bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_PLACED = _RESULT + ", _part int, _role int, _text string"
_COLUMNS = [c.split()[0] for c in _PLACED.split(", ")]
_RUN_SIGNS = 400_000


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about _RUN_SIGNS signs."""
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= _RUN_SIGNS:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order: each waits for the next.  The first and last text of a part are handed on."""
    held = None
    part = 0
    for batch in batches:
        ids = [None if pd.isna(d) else int(d) for d in batch["_id"]]
        texts = list(batch["_text"])
        rows = []
        if len(texts):
            part = int(batch["_part"].iloc[0])
        for lo, hi in _runs(texts):
            if held is None:
                rows.append((ids[0], *[None] * 6, part, 0, texts[0]))
            before = ([] if held is None else [held[:2]]) + list(zip(ids[lo:hi], texts[lo:hi], strict=True))
            edited = [_edited(a[1], b[1]) for a, b in zip(before, before[1:], strict=False)]
            found = sketches(texts[lo:hi] + edited)
            own = found[: hi - lo] if held is None else np.concatenate((held[2][None], found[: hi - lo]))
            for i, text in enumerate(edited):
                rows.append((*_row(*before[i], text, own[i], found[hi - lo + i], own[i + 1]), part, 1, None))
            held = (*before[-1], own[-1])
        yield pd.DataFrame(rows, columns=_COLUMNS)
    if held is not None:
        yield pd.DataFrame([(held[0], *[None] * 6, part, 2, held[1])], columns=_COLUMNS)


def _close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text, after in zip(batch["doc_id"], batch["_text"], batch["_after"], strict=True):
            edited = _edited(text, after)
            own, other, last = sketches([text, edited, after])
            rows.append(_row(None if pd.isna(doc_id) else int(doc_id), text, edited, own, other, last))
        yield pd.DataFrame(rows, columns=_COLUMNS[:7])


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """Fingerprint of every row of ``documents``, and of its edited text.

    The edited text has the last quarter of the signs replaced by as many of the
    next row's first; next is by doc_id, nulls first, equal ids by text; after
    the last comes the first.  Null texts are empty.  One row alone is its own
    next.  Texts are shuffled once, by ranges of ids; only the two texts at the
    ends of each range are handed to the neighbouring range.  An empty
    table gives no rows; a very long text is parsed in a run of its own.
    """
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    ordered = rows.repartitionByRange(parts, "_id").sortWithinPartitions("_id", "_text")
    placed = stage(
        ordered.withColumn("_part", F.spark_partition_id()).mapInPandas(_walk, _PLACED), "fingerprints"
    )
    whole = [F.lower(F.hex(c)).alias(c) if i in (2, 3, 4) else F.col(c) for i, c in enumerate(_COLUMNS[:7])]
    ends = placed.where("_role != 1").select("_part", "_role", "doc_id", "_text")
    # one number for each range: which range follows which
    used = sorted(r["_part"] for r in ends.where("_role = 0").select("_part").collect())
    if not used:
        return placed.select(whole)
    follows = spark.createDataFrame(
        [(a, b) for a, b in zip(used, used[1:] + used[:1], strict=True)], "_part int, _next int"
    )
    heads = ends.where("_role = 0").select(F.col("_part").alias("_next"), F.col("_text").alias("_after"))
    last = ends.where("_role = 2").select("_part", "doc_id", "_text").join(follows, "_part").join(heads, "_next")
    closed = last.select("doc_id", "_text", "_after").mapInPandas(_close, _RESULT).select(whole)
    return placed.where("_role = 1").select(whole).unionByName(closed)
