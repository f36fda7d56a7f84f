"""Toxic passages by maximum-scoring segments of token log-odds.

Tokens are runs of letters (ASCII folded) and their openings of 4, 5 and 6
bytes, so that inflected forms share evidence.  A token's score is its log-odds
between toxic and clean training documents under a Dirichlet prior centred on
its overall frequency; a form with evidence of its own uses it, another one uses
its longest telling opening, all else costs a little.  A linear scan (Ruzzo and
Tompa, 1999) lists every maximal passage of positive score.  The passages of a
document are judged by extreme-value statistics: how often clean text of that
length holds such a score by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.types import LongType

from millwatch.llm.common import LETTERS, is_training_row, mix, word_runs
from millwatch.session import stage

OPENINGS = (6, 5, 4)
_RESULT = pa.struct(
    [
        ("score", pa.float64()),
        ("passages", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))),
    ]
)
RESULT = "struct<score:double,passages:array<struct<start:int,end:int,score:double>>>"


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the labelled documents learnt from, before near copies are thinned.

    A form is telling with a z-score of ``min_z`` and log-odds of ``min_weight``:
    with many documents common words pass the first with hardly any weight, and
    passages of nothing else would grow over whole texts.
    """

    sample_rows: int = 40_000
    prior_docs: float = 10.0
    prior_count: float = 0.5
    min_z: float = 3.0
    min_weight: float = 2.0
    known_docs: int = 8
    gap_cost: float = 0.05


@dataclass(frozen=True)
class ToxicityModel:
    tokens: np.ndarray  # sorted hashes
    weights: np.ndarray  # log-odds, 0 for forms known to be harmless
    gap_cost: float
    rate: float  # lambda of the extreme-value law
    scale: float  # K of that law
    logit: tuple[float, float, float]  # weights of log evidence, of passages, and constant


def _levels(words) -> list[np.ndarray]:
    """Hashes of each word and of its openings; 0 where a word is no longer than the opening."""
    levels = [words.hash | np.uint64(1)]
    size = words.end - words.start
    for n in OPENINGS:
        end = np.minimum(words.start + n, words.end)
        part = mix(words.part(words.start, end) + np.uint64(n)) & ~np.uint64(1)
        levels.append(np.where(size >= n, part, np.uint64(0)))
    return levels


def _letter_words(words):
    keep = LETTERS[words.data[words.start]] == 1
    before = np.concatenate(([0], np.cumsum(keep)))
    words.first = before[words.first]
    words.start, words.end, words.hash = words.start[keep], words.end[keep], words.hash[keep]
    return words


def letter_runs(texts: pa.Array):
    for row, stop, words in word_runs(texts, LETTERS, lower=True):
        yield row, stop, _letter_words(words)


@arrow_udf(LongType())
def likeness_key(texts: pa.Array) -> pa.Array:
    """The least hash of five-word runs: near copies mostly share it."""
    out = np.zeros(len(texts), np.int64)
    for row, stop, words in letter_runs(texts):
        h = words.hash
        if len(h) == 0:
            continue
        run = h.copy()
        for k in range(1, 5):
            run[: len(h) - k] = mix(run[: len(h) - k] + h[k:] * np.uint64(2 * k + 1))
        for i in range(row, stop):
            lo, hi = words.first[i - row], words.first[i - row + 1]
            if hi > lo:
                out[i] = np.int64(run[lo : max(lo + 1, hi - 4)].min().view(np.int64))
    return pa.array(out)


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = np.asarray(batch.column("label").to_numpy(zero_copy_only=False), np.int64)
        for row, stop, words in letter_runs(batch.column("text")):
            doc = np.repeat(np.arange(row, stop), np.diff(words.first))
            pairs = []
            for level in _levels(words):
                own = level != 0
                pairs.append(np.stack((level[own], doc[own].astype(np.uint64))))
            pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
            token, toxic = pairs[0], label[pairs[1].astype(np.int64)]
            token, at = np.unique(token, return_inverse=True)
            ones = np.bincount(at, weights=toxic, minlength=len(token)).astype(np.int64)
            all_ = np.bincount(at, minlength=len(token)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token.view(np.int64)), pa.array(ones), pa.array(all_ - ones)], ["token", "toxic", "clean"]
            )


def training_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents that may be learnt from.

    The rows with the least hash of the id.  Ids with contradicting labels are left out.
    """
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & is_training_row(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("_max"))
        .where("label = _max")
        .select("doc_id", "label")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # at most ``rows`` rows of two numbers
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> ToxicityModel:
    """Learn tokens from three quarters of the sample and the calibration from the rest.

    Near copies (an equal ``likeness_key``) count once.  Without both classes the
    model has no tokens and gives every text the share of toxic rows.
    """
    sample = training_sample(documents, labels, "toxic", settings.sample_rows)
    sample = stage(sample.withColumn("_key", likeness_key("text")), "toxicity_sample")
    first = sample.groupBy("_key").agg(F.min("doc_id").alias("doc_id"))
    sample = sample.join(F.broadcast(first.select("doc_id")), "doc_id").select("doc_id", "text", "label", "_key")
    counting = F.pmod(F.xxhash64("_key", F.lit(1)), F.lit(4)) > 0
    sizes = {
        r["label"]: r["n"]
        for r in sample.where(counting).groupBy("label").agg(F.count("*").alias("n")).collect()
    }
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        share = (n1 + 0.5) / (n1 + n0 + 1)
        return ToxicityModel(
            np.zeros(0, np.uint64), np.zeros(0), settings.gap_cost, 1.0, 1.0, (0.0, 0.0, float(np.log(share / (1 - share))))
        )
    counts = (
        sample.where(counting)
        .select("text", F.col("label").cast("bigint").alias("label"))
        .mapInArrow(_count_tokens, "token bigint, toxic bigint, clean bigint")
        .groupBy("token")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    prior = F.lit(settings.prior_count) + F.lit(settings.prior_docs) * (F.col("toxic") + F.col("clean")) / F.lit(n1 + n0)
    y1, y0 = F.col("toxic") + F.col("_prior"), F.col("clean") + F.col("_prior")
    rest = 2 * settings.prior_count + settings.prior_docs
    scored = (
        counts.withColumn("_prior", prior)
        .withColumn("weight", F.log(y1 / (n1 + rest - y1)) - F.log(y0 / (n0 + rest - y0)))
        .withColumn("_z", F.col("weight") / F.sqrt(1 / y1 + 1 / y0))
    )
    # bounded by the sample: only forms seen in several of its documents
    telling = (F.col("_z") >= settings.min_z) & (F.col("weight") >= settings.min_weight)
    kept = scored.where(telling | (F.col("toxic") + F.col("clean") >= settings.known_docs))
    rows = kept.select("token", F.when(telling, F.col("weight")).otherwise(0.0).alias("weight")).toPandas()
    tokens = rows["token"].to_numpy(np.int64).view(np.uint64)
    weights = rows["weight"].to_numpy(np.float64)
    # a harmless opening says nothing, a harmless whole word does
    keep = (weights > 0) | (tokens & np.uint64(1) == 1)
    tokens, weights = tokens[keep], weights[keep]
    order = np.argsort(tokens)
    model = ToxicityModel(tokens[order], weights[order], settings.gap_cost, 1.0, 1.0, (0.0, 0.0, 0.0))
    held = sample.where(~counting).select("label", passages_of(model)(F.col("text")).alias("p"))
    held = held.select("label", "p.n_words", F.expr("transform(p.passages, x -> x.score)").alias("scores")).toPandas()
    return calibrate(model, held)


def calibrate(model: ToxicityModel, held: pd.DataFrame) -> ToxicityModel:
    """Extreme-value law from clean documents, then a logit over the evidence; held: label, n_words, scores."""
    toxic = held["label"].to_numpy(np.int64) == 1
    clean_scores = np.concatenate([np.zeros(0), *[np.asarray(s, float) for s in held["scores"][~toxic]]])
    words = float(held["n_words"][~toxic].sum()) + 1.0
    start = float(np.median(clean_scores)) if len(clean_scores) else 1.0
    over = clean_scores[clean_scores >= start] - start
    # one imaginary excess of size 1 keeps the law proper where clean text holds no passage
    rate = (len(over) + 1.0) / (float(over.sum()) + 1.0)
    scale = (len(over) + 0.5) / words * float(np.exp(rate * start))
    x = np.array([evidence(np.asarray(s, float), n, rate, scale) for s, n in zip(held["scores"], held["n_words"], strict=True)])
    x = np.column_stack((x.reshape(-1, 2), np.ones(len(held))))
    w = np.zeros(3)
    ridge = np.array([0.05, 0.05, 0.001])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - toxic) + ridge * w)
        size = float(np.abs(step).max())
        w = w - step * min(1.0, 2.0 / max(size, 1e-9))
        if size < 1e-6:
            break
    return ToxicityModel(
        model.tokens, model.weights, model.gap_cost, rate, scale, (float(w[0]), float(w[1]), float(w[2]))
    )


def evidence(scores: np.ndarray, n_words: float, rate: float, scale: float) -> tuple[float, float]:
    """Minus the log chance that clean text of this length holds the best passage, and the log count of passages.

    The chance is 1 - exp(-K n exp(-lambda s)); passages that are likely by chance count as none.
    """
    if len(scores) == 0:
        return 0.0, 0.0
    expected = scale * max(n_words, 1.0) * np.exp(-rate * np.clip(scores, 0, 200))
    chance = -np.expm1(-np.maximum(expected, 1e-30))
    telling = float(np.sum(-np.log(np.maximum(chance, 1e-30))))
    return min(-float(np.log(max(chance.min(), 1e-30))), 30.0), float(np.log1p(telling))


def maximal_segments(at: np.ndarray, gain: np.ndarray, gap_cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence that is ``-gap_cost`` but for ``gain`` at places ``at``.

    One pass with a list of candidates, each with the running sums before and after it.
    """
    found: list[list[float]] = []  # start, end, sum before, sum after
    total, last = 0.0, -1
    for place, value in zip(at.tolist(), gain.tolist(), strict=True):
        total -= gap_cost * (place - last - 1)
        new = [place, place + 1, total, total + value]
        total += value
        last = place
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(int(s), int(e), after - before) for s, e, before, after in found]


def _scan(model: ToxicityModel, texts: pa.Array):
    """(row, words, segments) of every text."""
    for row, stop, words in letter_runs(texts):
        weight = np.full(len(words.hash), np.nan)
        for level in _levels(words) if len(model.tokens) else []:
            at = np.searchsorted(model.tokens, level).clip(max=len(model.tokens) - 1)
            found = (model.tokens[at] == level) & np.isnan(weight)
            weight[found] = model.weights[at[found]]
        hits = np.flatnonzero(weight > 0)
        bounds = np.searchsorted(hits, words.first)
        for i in range(stop - row):
            lo, hi = bounds[i], bounds[i + 1]
            own = hits[lo:hi]
            segments = maximal_segments(own - words.first[i], weight[own], model.gap_cost) if hi > lo else []
            yield row + i, int(words.first[i + 1] - words.first[i]), segments


def passages_of(model: ToxicityModel):
    kind = "struct<n_words:int,passages:array<struct<start:int,end:int,score:double>>>"

    @arrow_udf(kind)
    def passages(texts: pa.Array) -> pa.Array:
        rows = [
            {"n_words": n, "passages": [{"start": s, "end": e, "score": v} for s, e, v in found]}
            for _, n, found in _scan(model, texts)
        ]
        return pa.array(rows, pa.struct([("n_words", pa.int32()), _RESULT[1]]))

    return passages


def toxicity(model: ToxicityModel, text: Column) -> Column:
    """struct(score, passages) of a text column; passages hold word places and scores.

    Null and empty texts have no passage and get the score of a text without evidence.
    """

    @arrow_udf(RESULT)
    def judge(texts: pa.Array) -> pa.Array:
        rows = []
        for _, n, found in _scan(model, texts):
            a, b = evidence(np.array([v for _, _, v in found]), n, model.rate, model.scale)
            z = model.logit[0] * a + model.logit[1] * b + model.logit[2]
            rows.append(
                {
                    "score": float(1 / (1 + np.exp(-np.clip(z, -500, 500)))),
                    "passages": [{"start": s, "end": e, "score": v} for s, e, v in found],
                }
            )
        return pa.array(rows, _RESULT)

    return judge(text)


def score_toxicity(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, score, passages for every row of ``documents``; repeated rows are scored alike.

    An empty table gives no rows; a long text is scanned whole.
    """
    model = fit(documents, labels, settings)
    return documents.select("doc_id", toxicity(model, F.col("text")).alias("_t")).select("doc_id", "_t.score", "_t.passages")


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``documents`` scored below ``threshold``, all columns as they came."""
    model = fit(documents, labels, settings)
    return documents.where(toxicity(model, F.col("text"))["score"] < threshold)
