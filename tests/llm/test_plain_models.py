"""Learnt models against versions in plain Python: vectors, pooling and network, covering, token weights."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millwatch.llm import classifier, rules
from millwatch.llm.common import LETTERS, word_runs

TOKEN = re.compile("[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0D]+")


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall(text or "")


@pytest.fixture(scope="module")
def texts() -> list[str | None]:
    rng = random.Random(8)
    common = ["the", "Of", "and", "1999", "été", "x"]
    rows = [
        " ".join(rng.choice(common) if rng.random() < 0.6 else "".join(rng.choices("abcdeXYZ09", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 90)))
        for _ in range(70)
    ]
    return [*rows, "", None, "  \n", "one", "!?..(a)--b", "same same same", rows[0]]


# 4 classifier


def token_hashes(tokens: set[str]) -> dict[str, int]:
    """Only the hash is taken from the library; what is done with it is written anew below."""
    names = sorted(tokens)
    out: dict[str, int] = {}
    for row, stop, words in word_runs(pa.array(names), LETTERS):
        assert len(words.hash) == stop - row
        out |= dict(zip(names[row:stop], words.hash.tolist(), strict=True))
    assert len(set(out.values())) == len(out)
    return out


def plain_shape(token: str) -> int:
    data = token.encode()

    def kind(byte: int) -> int:
        c = chr(byte)
        return 3 if byte >= 128 else 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 4

    size = min(len(data), 3)
    if kind(data[0]) == 4:
        return 64 + data[0] * 4 + size
    return kind(data[0]) * 16 + kind(data[-1]) * 4 + size


def plain_mixed(x: int) -> int:
    full = (1 << 64) - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & full
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & full
    return x ^ (x >> 31)


def plain_vectors(texts, s: classifier.Settings):
    """Row of each token and shape, and the vector of each row, by dictionaries of names."""
    lists = [tokens_of(t) for t in texts]
    counts = Counter(w for ws in lists for w in ws)
    total = sum(counts.values())
    hashes = token_hashes(set(counts))
    own = {w for w, n in counts.items() if n * s.words >= total and n >= s.min_count}
    shapes = s.rows // 4

    def name(word: str) -> tuple[str, int]:
        return ("word", hashes[word]) if word in own else ("shared", shapes + hashes[word] % (s.rows - shapes))

    def shape(word: str) -> tuple[str, int]:
        return "shared", plain_mixed(plain_shape(word) + 77) % shapes

    def index(row: tuple[str, int]) -> np.ndarray:
        v = np.zeros(s.size)
        for k in range(s.nonzeros):
            h = plain_mixed(row[1] + plain_mixed(k + (s.seed << 32)) & (1 << 64) - 1)
            v[h % s.size] += 1 if h >> 63 else -1
        return v

    sums: dict = defaultdict(lambda: np.zeros(s.size))
    for words in lists:
        for i, word in enumerate(words):
            for j in range(max(0, i - s.window), min(len(words), i + s.window + 1)):
                if i != j:
                    for row in (name(word), shape(word)):
                        sums[row] = sums[row] + index(name(words[j])) + index(shape(words[j]))
    unit = {row: v / math.sqrt(v @ v) if v @ v else v for row, v in sums.items()}
    return own, hashes, lambda w: unit.get(name(w), np.zeros(s.size)), lambda w: unit.get(shape(w), np.zeros(s.size))


def test_vectors_and_pooling(spark, texts):
    s = classifier.Settings(words=60, min_count=3, rows=64, size=8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    own, hashes, form, shape = plain_vectors(texts, s)
    known = classifier.vocabulary(docs, s)
    assert known.words.tolist() == sorted(hashes[w] for w in own) and 3 <= len(own) < len(hashes)
    vectors = classifier.word_vectors(docs, known, s)
    got = classifier.pooled(pa.array(texts), known, vectors)
    for text, row in zip(texts, got, strict=True):
        words = tokens_of(text)
        want = np.zeros(2 * s.size + 3)
        if words:
            f = [form(w) for w in words]
            v = [a + shape(w) for a, w in zip(f, words, strict=True)]
            want[: s.size], want[s.size : 2 * s.size] = np.mean(v, axis=0), np.std(v, axis=0)
            if len(words) > 1:
                want[2 * s.size] = sum(a @ b for a, b in zip(f, f[1:])) / (len(f) - 1)
                want[2 * s.size + 1] = sum(a @ b for a, b in zip(v, v[2:])) / max(1, len(v) - 2)
            want[-1] = math.log1p(len(words))
        assert np.allclose(row, want, atol=2e-5)


def test_network_and_temperature():
    """The network tells two curved classes apart; its temperature is the best of a fine search on held-back rows."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 5))
    chance = 1 / (1 + np.exp(-3 * (x[:, 0] * x[:, 1] + 0.3)))
    y = (rng.random(1500) < chance).astype(float)
    s = classifier.Settings()
    none = classifier.Vocabulary(np.zeros(0, np.uint64), 8)
    model = classifier.train(x, y, none, np.zeros((8, 4), np.float32), s)
    for row, z in zip(x[:20], classifier.logits(model, x[:20]), strict=True):
        hidden = [
            math.tanh(sum((row[i] - model.mean[i]) / model.scale[i] * model.w1[i, j] for i in range(5)) + model.b1[j])
            for j in range(s.hidden)
        ]
        assert math.isclose(z, (sum(h * w for h, w in zip(hidden, model.w2)) + model.b2) / model.temperature, rel_tol=1e-9)
    fresh = rng.normal(size=(2000, 5))
    sure = np.abs(fresh[:, 0] * fresh[:, 1] + 0.3) > 0.5
    said = classifier.logits(model, fresh) > 0
    assert np.mean((said == (fresh[:, 0] * fresh[:, 1] + 0.3 > 0))[sure]) > 0.9
    held = np.random.default_rng(s.seed).permutation(len(y))[: len(y) // 5]
    raw, target = classifier.logits(model, x[held]) * model.temperature, y[held]

    def loss(heat: float) -> float:
        p = 1 / (1 + np.exp(-raw / heat))
        return -float(np.mean(target * np.log(p) + (1 - target) * np.log(1 - p)))

    assert loss(model.temperature) <= min(loss(t) for t in np.geomspace(0.25, 8, 200)) + 1e-3


# 2 quality rules


def plain_covering(rows: list[dict], thresholds: dict[str, list[float]], s: rules.Settings):
    """Sequential covering over lists of rows, condition by condition; each list names which rows a rule leaves."""

    def holds(row: dict, rule) -> bool:
        return all((row[f] >= v) if up else (row[f] < v) for f, up, v in rule)

    found = []
    left = rows
    while len(found) < s.max_rules:
        rule: list = []
        while len(rule) < s.max_conditions:
            mine = [r for r in left if r["_grow"] and holds(r, rule)]
            p0 = sum(r["_bad"] for r in mine)
            n0 = len(mine) - p0
            best = (1e-9, None)
            for f, values in thresholds.items() if p0 and n0 else ():
                for v in values:
                    for up in (True, False):
                        p = sum(r["_bad"] for r in mine if holds(r, [(f, up, v)]))
                        n = sum(not r["_bad"] for r in mine if holds(r, [(f, up, v)]))
                        gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0
                        if p >= s.min_rows and gain > best[0]:
                            best = (gain, (f, up, v))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        pruning = [r for r in left if not r["_grow"]]
        worth = []
        for k in range(1, len(rule) + 1):
            p = sum(r["_bad"] for r in pruning if holds(r, rule[:k]))
            n = sum(not r["_bad"] for r in pruning if holds(r, rule[:k]))
            worth.append(((p - n) / max(1, p + n), -k, p, n))
        _, k, p, n = max(worth)
        if p + n == 0 or p / (p + n) < s.min_precision:
            break
        found.append(rule[:-k])
        left = [r for r in left if not holds(r, found[-1])]
    return found


def test_learnt_list_is_that_of_a_plain_covering(spark):
    rng = random.Random(4)
    features = (*rules.BASE, *rules.SHARES)
    rows = []
    for i in range(700):
        row = {f: float(rng.randint(0, 12)) for f in features}
        row["_bad"] = row["n_words"] >= 9 and row["mean_length"] < 7 or row["capital_share"] >= 11
        if rng.random() < 0.02:
            row["_bad"] = not row["_bad"]
        row["_grow"] = i % 3 > 0
        rows.append(row)
    schema = ", ".join([*(f"{f} double" for f in features), "_bad boolean", "_grow boolean"])
    sample = spark.createDataFrame([tuple(r[c] for c in (*features, "_bad", "_grow")) for r in rows], schema)
    s = rules.Settings()
    steps = [i / (s.cuts + 1) for i in range(1, s.cuts + 1)]
    thresholds = {
        f: sorted({float(v) for bad in (True, False) for v in np.quantile([r[f] for r in rows if r["_bad"] == bad], steps)}) for f in features
    }
    want = plain_covering(rows, thresholds, s)
    got = [[(c.feature, c.at_least, c.value) for c in rule] for rule in rules.learn(sample, s)]
    assert len(got) >= 2 and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert [(f, up) for f, up, _ in a] == [(f, up) for f, up, _ in b]
        assert np.allclose([v for *_, v in a], [v for *_, v in b])
    # the list as a CASE expression names the first rule that holds
    judged = sample.select(*features, rules.verdict([tuple(rules.Condition(*c) for c in rule) for rule in got]).alias("rule"))
    for r in judged.collect():
        first = next((i for i, rule in enumerate(got, 1) if all((r[f] >= v) if up else (r[f] < v) for f, up, v in rule)), 0)
        assert r["rule"] == first
    assert judged.where(F.col("rule") > 0).count() > 100
