"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

A token is a word or a run of other signs.  It has two rows in a table: one for
itself, one for its shape (capitals, small letters, digits, length of a run of
signs).  Words that make up a stated share of all tokens have a row of their own
(that share bounds their number, at any size of the corpus); rarer ones, of which
little could be learnt, share hashed rows.  Every row has a sparse random index
vector of +1 and -1; the vector of a row is the sum of the index vectors of the
tokens around it over all documents.  A document is pooled to the mean and spread of its tokens'
vectors, the likeness of adjacent tokens and its length.  A small network on a
bounded sample of labelled documents gives a score, calibrated by a temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from millwatch.llm.common import LETTERS, Words, mix, word_runs
from millwatch.llm.toxicity import training_sample
from millwatch.session import stage


@dataclass(frozen=True)
class Settings:
    """Words of at least one in ``words`` tokens (so at most ``words``) that stand ``min_count`` times
    or more have a vector of their own.

    ``rows`` are shared by shapes (a quarter) and rarer words; ``sample_rows`` bounds
    the labelled documents learnt from.
    """

    words: int = 100_000
    min_count: int = 20
    rows: int = 8192
    size: int = 32
    nonzeros: int = 2
    window: int = 2
    sample_rows: int = 20_000
    hidden: int = 24
    epochs: int = 60
    seed: int = 11


@dataclass(frozen=True)
class Vocabulary:
    """Rows: shapes, then rows that rarer words share, then one for each of ``words`` (sorted hashes)."""

    words: np.ndarray
    shared: int

    @property
    def n_rows(self) -> int:
        return self.shared + len(self.words)

    def rows(self, tokens: Words) -> tuple[np.ndarray, np.ndarray]:
        """The rows of each token itself and of its shape."""
        shapes = self.shared // 4
        form = (tokens.hash % np.uint64(self.shared - shapes)).astype(np.int64) + shapes
        if len(self.words):
            at = np.searchsorted(self.words, tokens.hash).clip(max=len(self.words) - 1)
            form = np.where(self.words[at] == tokens.hash, self.shared + at, form)
        shape = (mix(_shapes(tokens).astype(np.uint64) + np.uint64(77)) % np.uint64(shapes)).astype(np.int64)
        return form, shape


@dataclass(frozen=True)
class QualityModel:
    vocabulary: Vocabulary
    vectors: np.ndarray  # vocabulary.n_rows x size, unit length
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float


def _shapes(words: Words) -> np.ndarray:
    """A small code of how a token looks."""
    first = words.data[words.start]
    last = words.data[words.end - 1]
    size = np.minimum(words.end - words.start, 3)
    kind = np.full(256, 4, np.int64)
    kind[0x30:0x3A], kind[0x41:0x5B], kind[0x61:0x7B], kind[0x80:] = 0, 1, 2, 3
    sign = kind[first] == 4
    return np.where(sign, 64 + first.astype(np.int64) * 4 + size, kind[first] * 16 + kind[last] * 4 + size)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, tokens in word_runs(batch.column(0), LETTERS):
            word, n = np.unique(tokens.hash, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])


def vocabulary(documents: DataFrame, s: Settings) -> Vocabulary:
    """The words that make up at least one in ``s.words`` of all tokens, and stand ``s.min_count`` times."""
    counts = stage(documents.select("text").mapInArrow(_count_words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    own = counts.where((F.col("n") * s.words >= total) & (F.col("n") >= s.min_count)).select("word").toPandas()  # at most s.words rows
    return Vocabulary(np.sort(own["word"].to_numpy(np.int64).view(np.uint64)), s.rows)


def index_vectors(known: Vocabulary, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each row's index vector; a word's do not depend on the other words."""
    names = np.concatenate((np.arange(known.shared, dtype=np.uint64), known.words))
    steps = mix(np.arange(s.nonzeros, dtype=np.uint64) + np.uint64(s.seed << 32))
    h = mix(names[:, None] + steps)
    return (h % np.uint64(s.size)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1).astype(np.int64)


def _add_contexts(known: Vocabulary, s: Settings):
    """Each task sums its documents into one table of bounded size and hands on the rows it touched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors(known, s)
        total = np.zeros((known.n_rows, s.size), np.int64)
        short = np.zeros(known.n_rows, np.int64)
        for batch in batches:
            for row, stop, words in word_runs(batch.column(0), LETTERS):
                form, shape = known.rows(words)
                doc = np.repeat(np.arange(stop - row), np.diff(words.first))
                # sums are taken over the rows that occur here, numbered from 0
                here_ = np.unique(np.concatenate((form, shape)))
                short[here_] = np.arange(len(here_))
                sums = np.zeros(len(here_) * s.size, np.int64)
                for step in range(1, s.window + 1):
                    near = np.flatnonzero(doc[step:] == doc[:-step])
                    for here, there in ((near, near + step), (near + step, near)):
                        for own in (form, shape):
                            base = short[own[here]] * s.size
                            for other in (form, shape):
                                for k in range(s.nonzeros):
                                    at = base + place[other[there], k]
                                    sums += np.bincount(at, weights=sign[other[there], k], minlength=len(sums)).astype(np.int64)
                total[here_] += sums.reshape(-1, s.size)
        used = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), *(pa.array(total[used, k]) for k in range(s.size))],
            ["row", *(f"v{k}" for k in range(s.size))],
        )

    return run


def word_vectors(documents: DataFrame, known: Vocabulary, s: Settings) -> np.ndarray:
    """The vector table from all documents: sums of whole numbers, the same however rows are dealt."""
    names = [f"v{k}" for k in range(s.size)]
    schema = ", ".join(["row bigint", *(f"{n} bigint" for n in names)])
    parts = documents.select("text").mapInArrow(_add_contexts(known, s), schema)
    summed = parts.groupBy("row").agg(*(F.sum(n).alias(n) for n in names)).toPandas()  # at most known.n_rows rows
    out = np.zeros((known.n_rows, s.size))
    out[summed["row"].to_numpy(np.int64)] = summed[names].to_numpy(float)
    length = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0).astype(np.float32)


def pooled(texts: pa.Array, known: Vocabulary, vectors: np.ndarray) -> np.ndarray:
    """Features of each text: mean and spread of token vectors, adjacency likeness, length; zeros when empty."""
    size = vectors.shape[1]
    out = np.zeros((len(texts), 2 * size + 3), np.float32)
    for row, stop, words in word_runs(texts, LETTERS):
        form, shape = known.rows(words)
        for i in range(stop - row):
            lo, hi = words.first[i], words.first[i + 1]
            if lo == hi:
                continue
            f = vectors[form[lo:hi]]
            v = f + vectors[shape[lo:hi]]
            one = out[row + i]
            one[:size] = v.mean(axis=0)
            one[size : 2 * size] = v.std(axis=0)
            if hi - lo > 1:
                one[2 * size] = np.einsum("ij,ij->", f[1:], f[:-1]) / (hi - lo - 1)
                one[2 * size + 1] = np.einsum("ij,ij->", v[2:], v[:-2]) / max(1, hi - lo - 2)
            one[2 * size + 2] = np.log1p(hi - lo)
    return out


def logits(model: QualityModel, x: np.ndarray) -> np.ndarray:
    hidden = np.tanh(((x - model.mean) / model.scale) @ model.w1 + model.b1)
    return (hidden @ model.w2 + model.b2) / model.temperature


def train(x: np.ndarray, y: np.ndarray, known: Vocabulary, vectors: np.ndarray, s: Settings) -> QualityModel:
    """Two layers by Adam on four fifths of the rows; the rest fixes the temperature.

    With no rows, or one class, the score is the smoothed share of label 1.
    """
    d = x.shape[1]
    share = float((y.sum() + 0.5) / (len(y) + 1))
    plain = QualityModel(
        known, vectors, np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0
    )
    if len(y) == 0 or y.min() == y.max():
        return plain
    rng = np.random.default_rng(s.seed)
    order = rng.permutation(len(y))
    check, own = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    w1 = rng.normal(0, 1 / np.sqrt(d), (d, s.hidden))
    p = [w1, np.zeros(s.hidden), rng.normal(0, 1 / np.sqrt(s.hidden), s.hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    t = 0
    for _ in range(s.epochs):
        rng.shuffle(own)
        for lo in range(0, len(own), 128):
            pick = own[lo : lo + 128]
            h = np.tanh(z[pick] @ p[0] + p[1])
            e = 1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[pick]
            back = np.outer(e, p[2]) * (1 - h**2)
            grads = [z[pick].T @ back, back.sum(axis=0), h.T @ e, np.array([e.sum()])]
            t += 1
            for k in range(4):
                g = grads[k] / len(pick) + 1e-4 * p[k] * (k % 2 == 0)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.005 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    raw = QualityModel(known, vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    z, target = logits(raw, x[check]), y[check]
    best, heat = np.inf, 1.0
    for candidate in np.exp(np.linspace(np.log(0.25), np.log(8), 60)):
        loss = float(np.mean(np.logaddexp(0, z / candidate) - target * z / candidate)) if len(check) else 0.0
        if loss < best:
            best, heat = loss, float(candidate)
    return QualityModel(known, vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]), heat)


def fit(documents: DataFrame, labels: DataFrame, s: Settings = Settings()) -> QualityModel:
    """Vectors from every document, the network from at most ``sample_rows`` labelled ones."""
    known = vocabulary(documents, s)
    vectors = word_vectors(documents, known, s)

    @arrow_udf("array<float>")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array(list(pooled(texts, known, vectors)), pa.list_(pa.float32()))

    sample = training_sample(documents, labels, "quality", s.sample_rows)
    rows = sample.select("doc_id", "label", features("text").alias("x")).toPandas()
    rows["_first"] = [float(v[0]) for v in rows["x"]]
    rows = rows.sort_values(["doc_id", "_first"])  # the same order however rows arrive
    x = np.array(rows["x"].tolist(), np.float64).reshape(len(rows), 2 * s.size + 3)
    return train(x, rows["label"].to_numpy(np.float64), known, vectors, s)


def quality(model: QualityModel, text: Column) -> Column:
    """Score between 0 and 1 of a text column, higher: label 1 likelier; null and empty texts are scored too."""

    @arrow_udf("double")
    def judge(texts: pa.Array) -> pa.Array:
        z = logits(model, pooled(texts, model.vocabulary, model.vectors).astype(np.float64))
        return pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return judge(text)


def score_quality(documents: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id and score for every row of ``documents``; repeated rows are scored alike.

    An empty table gives no rows; of a long text all words count.
    """
    model = fit(documents, labels, s)
    return documents.select("doc_id", quality(model, F.col("text")).alias("score"))


def drop_poor(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, s: Settings = Settings()) -> DataFrame:
    """The rows of ``documents`` scored at ``threshold`` or more, all columns as they came."""
    model = fit(documents, labels, s)
    return documents.where(quality(model, F.col("text")) >= threshold)
