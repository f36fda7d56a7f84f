"""Every operator against a plain version, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from millwatch.llm.common import BATCH_BYTES, small_batches
from millwatch.llm import classifier, components, fingerprints, packing, pieces, rules, shards, simhash, substring, toxicity, urls

WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, _row string, _key bigint"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    shared = sentence(rng, 80)
    base = sentence(rng, 120)
    words = base.split()
    edited = words[:40] + ["changed"] + words[41:90] + ["new", "words"] + words[90:]
    rows: list[tuple[int | None, str | None]] = [
        (1, base),
        (2, base),
        (3, " ".join(edited)),
        (4, sentence(rng, 60) + "\n" + shared + "\n" + sentence(rng, 70)),
        (5, sentence(rng, 30) + " " + shared + " " + sentence(rng, 20)),
        (6, ""),
        (7, None),
        (8, " \t\n "),
        (9, "one"),
        (10, "same same same " * 40),
        (11, "line a b c\nline a b c\n \nx y z\n"),
        (12, "Été 世界 ▁   x\x0by  #$%& <a|b>\r\nz " + "q" * 300),
        (13, sentence(rng, 20_000)),
        (13, "another text under the same number"),
        (14, base),
        (14, base),
        (None, base),
        (None, None),
    ]
    rows += [(100 + i, sentence(rng, rng.randint(1, 200))) for i in range(60)]
    return rows


@pytest.fixture(scope="module")
def documents(spark, texts):
    rows = [(d, t, "en", "s", None if t is None else len(t), 0.5, "r", 7) for d, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(900):
        kind = i % 3
        words = sentence(rng, rng.randint(60, 120)).split()
        if kind == 1:
            words = [f"{w.upper()}!!" for w in words]
        if kind == 2:
            for k in rng.sample(range(len(words)), 3):
                words[k] = rng.choice(("vilewret", "vilewreten", "vilewretich", "scoundrel"))
        docs.append((i, " ".join(words), "en", "s", 1, 0.5, "r", 7))
        labels.append((i, int(kind != 1), int(kind == 2)))
    return spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(
        labels, "doc_id bigint, quality int, toxic int"
    )


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


# 1 repeated passages


def test_repeated_passages_cover_exact_runs(documents, texts):
    found = substring.repeated_passages(documents).collect()
    held = {}
    for r in found:
        held.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    first, needed = {}, {}
    for d, t in sorted((d, t) for d, t in texts if d is not None and t):
        w = WORD.findall(t)
        for i in range(len(w) - 49):
            run = tuple(w[i : i + 50])
            if first.setdefault(run, d) != d:
                needed.setdefault(d, set()).update(range(i, i + 50))
    assert needed.keys() == {2, 5, 14}
    for d, places in needed.items():
        assert places <= held[d]
    assert {r.other_id for r in found if r.doc_id == 3} == {1}  # fuzzy: one word changed, two added
    assert held[3] == set(range(122))
    assert held.keys() == {2, 3, 5, 14}


def uncovered_words(spark, rows):
    """Places in exact 50-word repeats of an earlier document that are not listed."""
    found = substring.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    held, first, needed = {}, {}, {}
    for r in found:
        held.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    for d, t in sorted(rows):
        w = WORD.findall(t)
        for i in range(len(w) - 49):
            run = tuple(w[i : i + 50])
            if first.setdefault(run, d) != d:
                needed.setdefault(d, set()).update(range(i, i + 50))
    assert needed
    return {d: places - held.get(d, set()) for d, places in needed.items() if not places <= held.get(d, set())}


def test_passages_of_lines_first_seen_elsewhere(spark):
    rng = random.Random(31)
    rows = []
    for g, sizes in enumerate([(40, 40), (26, 26), (20, 20, 20), (25, 25, 25, 25)] * 4):
        lines = [sentence(rng, n) for n in sizes]
        rows += [(100 * g + i, sentence(rng, 30) + " " + line + " " + sentence(rng, 30)) for i, line in enumerate(lines)]
        rows += [(100 * g + 50 + i, sentence(rng, 35) + " " + " ".join(lines) + " " + sentence(rng, 25)) for i in range(3)]
    assert uncovered_words(spark, rows) == {}


def test_passages_repeated_inside_the_later_document(spark):
    rng = random.Random(32)
    rows = []
    for g in range(6):
        p = sentence(rng, 60 + 5 * g)
        rows.append((10 * g, sentence(rng, 30) + " " + p + " " + sentence(rng, 30)))
        rows.append((10 * g + 1, p + " " + sentence(rng, 40) + " " + p + " " + sentence(rng, 30) + " " + p))
    rows += [(5000, "same " * 60), (5001, "same " * 100)]
    assert uncovered_words(spark, rows) == {}


def test_runs_covered_by_passages_of_others_keep_their_link():
    """A run is first held whole by 4; passages of 1 and 2 cover its words, but are no link to 4."""
    rows = [(9, 0, 0, 100, 1, 0), (9, 0, 100, 200, 2, 0), (9, 0, 300, 400, 4, 500)]
    rows += [(9, 1, a, 0, 4, a + 7) for a in range(60, 90)]
    rows += [(9, 1, a, 0, 4, a + 200) for a in range(310, 330)]  # inside a passage of 4: known
    rows += [(10, 1, 5, 0, 4, 0)]
    rows.sort(key=lambda r: (r[0], r[4], r[1], r[2]))
    for size in (1, 7, 100):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*p, strict=True)], list("abcdef")) for p in parts]
        found = [r for b in substring._uncovered(substring.Settings())(iter(batches)) for r in zip(*b.to_pydict().values(), strict=True)]
        assert sorted(found) == [(9, 4, 60, 139, 67, 146, 79), (10, 4, 5, 55, 0, 50, 50)]


def test_links_of_runs_that_others_cover(spark):
    rng = random.Random(33)
    p = sentence(rng, 200).split()
    texts = [" ".join(w) for w in (p[:100], p[100:], p, p)]
    rows = [(i, sentence(rng, 30) + " " + t + " " + sentence(rng, 30)) for i, t in enumerate(texts)]
    found = substring.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.other_id) for r in found} == {(2, 0), (2, 1), (3, 0), (3, 1), (3, 2)}


def changed(rng: random.Random, words: list[str], every: int) -> str:
    at = rng.randrange(every)
    return " ".join(sentence(rng, 1) if i % every == at else w for i, w in enumerate(words))


@pytest.mark.parametrize("holders", [1, 24])
def test_fuzzy_links_of_seeds_first_seen_elsewhere(spark, holders):
    """Parts of a passage stand in other documents first; two documents hold all of it, each with words changed.

    With 24 holders each part but one is a frequent one.
    """
    rng = random.Random(34)
    rows, pairs, least = [], set(), {}
    for g in range(8):
        passage = sentence(rng, 120).split()
        parts = [passage[i : i + 24] for i in range(0, 120, 24)]
        for i, part in enumerate(parts):
            for _ in range(holders if i else 1):
                rows.append((len(rows), " ".join([sentence(rng, 20), *part, sentence(rng, 20)])))
        for _ in range(2):
            rows.append((len(rows), " ".join([sentence(rng, 40), changed(rng, passage, 18), sentence(rng, 40)])))
        pairs.add((len(rows) - 1, len(rows) - 2))
        least[len(rows) - 1] = 96
    found = substring.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    held = {}
    for r in found:
        if (r.doc_id, r.other_id) in pairs:
            held.setdefault(r.doc_id, set()).update(range(max(40, r.start_word), min(160, r.end_word)))
    assert {d for d in least if len(held.get(d, ())) < least[d]} == set()


def test_fuzzy_links_of_frequent_seeds_only(spark):
    """Every part of a passage stands in 24 documents of its own; the two that hold all of it share no rarer seed."""
    rng = random.Random(37)
    rows, pairs, least = [], set(), {}
    for g in range(8):
        passage = sentence(rng, 120).split()
        for i in range(0, 120, 24):
            rows += [(len(rows) + j, " ".join([sentence(rng, 20), *passage[i : i + 24], sentence(rng, 20)])) for j in range(24)]
        for _ in range(2):
            rows.append((len(rows), " ".join([sentence(rng, 40), changed(rng, passage, 18), sentence(rng, 40)])))
        pairs.add((len(rows) - 1, len(rows) - 2))
        least[len(rows) - 1] = 90
    found = substring.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len({tuple(r) for r in found}) == len(found)
    held = {}
    for r in found:
        if (r.doc_id, r.other_id) in pairs:
            held.setdefault(r.doc_id, set()).update(range(max(40, r.start_word), min(160, r.end_word)))
    assert {d for d in least if len(held.get(d, ())) < least[d]} == set()


def test_passages_of_frequent_seeds_only_are_cut(spark):
    rng = random.Random(39)
    passage, rows = sentence(rng, 120).split(), []
    for i in range(0, 120, 24):
        rows += [(len(rows) + j, " ".join([sentence(rng, 20), *passage[i : i + 24], sentence(rng, 20)])) for j in range(24)]
    for i in range(2):  # another word where two parts meet, so no seed lies across
        own = [sentence(rng, 1) if j % 24 == 23 else w for j, w in enumerate(passage)]
        rows.append((1000 + i, " ".join([sentence(rng, 40), *own, sentence(rng, 40)])))
    cut = dict(substring.cut_repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert len(cut[1001].split()) <= 110
    assert {i: t for i, t in rows if i != 1001} == {i: t for i, t in cut.items() if i != 1001}


def test_bare_seeds_and_their_pairs_equal_plain_ones():
    rng = random.Random(38)
    s = substring.Settings(near=3, far=9)

    def given(kernel, rows, names):
        size = rng.choice([1, 2, 7, 100])
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*p, strict=True)], names) for p in parts]
        return [r for b in kernel(iter(batches)) for r in zip(*b.to_pydict().values(), strict=True)]

    for _ in range(150):
        seeds = {(rng.randint(0, 3), rng.randint(0, 60), rng.randint(0, 5)) for _ in range(rng.randint(1, 40))}
        spans = [(rng.randint(0, 3), a := rng.randint(0, 60), a + rng.randint(1, 20)) for _ in range(rng.randint(0, 6))]
        rows = sorted([(d, 0, a, b, 0) for d, a, b in spans] + [(d, 1, p, 0, x) for d, p, x in seeds])
        covered = {(d, p, x) for d, p, x in seeds for e, a, b in spans if d == e and a <= p and p + s.k <= b}
        bare = seeds - covered
        plain = {(d, p, x, (d, p, x) in bare) for d, p, x in seeds if any(d == e and abs(p - q) <= s.far for e, q, _ in bare)}
        found = given(substring._bare_seeds(s), rows, ["doc", "role", "place", "end", "seed"])
        assert len(found) == len(plain) and set(found) == plain
        if not found:
            continue
        found = sorted(found)
        both = Counter(d for i, (d, p, _, b) in enumerate(found) for e, q, _, c in found[i + 1 :] if d == e and s.near <= q - p <= s.far and (b or c))
        assert Counter(d for _, d in given(substring._seed_pairs(s), found, ["doc", "place", "seed", "bare"])) == both


def test_matches_equal_plain_ones():
    rng = random.Random(35)
    s = substring.Settings(holders=3)
    for _ in range(100):
        rows = sorted((rng.randint(0, 8), rng.randint(0, rng.choice([3, 9])), rng.randint(0, 30)) for _ in range(rng.randint(1, 80)))
        plain = set()
        for seed in {r[0] for r in rows}:
            places = {}
            for _, doc, place in [r for r in rows if r[0] == seed]:
                places.setdefault(doc, []).append(place)
            first = min(places)
            if len(places) < 2:
                continue
            hot = len(places) > s.holders
            for doc, own in places.items():
                others = [first] if hot or doc == first else [o for o in places if o < doc]
                plain |= {(doc, o, place, places[o][0], o == (first if hot else max(others)), seed if hot else None) for o in others for place in own}
        size = rng.choice([1, 2, 7, 100])
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*p, strict=True)], ["seed", "doc", "place"]) for p in parts]
        found = [r for b in substring._matches(s)(iter(batches)) for r in zip(*b.to_pydict().values(), strict=True)]
        assert set(found) == plain


def test_copies_are_linked_to_the_least(spark):
    """Forty copies and a text alike: a row for each copy, and the one text is held against one of them."""
    rng = random.Random(36)
    words = sentence(rng, 90).split()
    rows = [(i, " ".join(words)) for i in range(40)] + [(50, changed(rng, words, 15)), (60, "few words"), (61, "few words")]
    found = substring.repeated_passages(spark.createDataFrame(rows * 2, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.other_id) for r in found) == [(i, 0) for i in [*range(1, 40), 50]]
    assert {tuple(r)[2:] for r in found if r.doc_id < 50} == {(0, 90, 0, 90, 90)}


def test_whole_runs_are_hashed_in_steps(monkeypatch):
    rng = np.random.default_rng(4)
    words = [rng.integers(0, 99, n).astype(np.uint64) for n in rng.integers(0, 200, 60)]
    columns = [pa.array(range(60), pa.int64()), pa.array([3] * 60, pa.int32()), pa.array([w.tobytes() for w in words], pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, ["_id", "_begin", "_words"])
    sizes, whole = [], substring.whole_runs
    monkeypatch.setattr(substring, "STEP_WORDS", 500)
    monkeypatch.setattr(substring, "whole_runs", lambda w, size: sizes.append(len(w)) or whole(w, size))
    got = [r for b in substring._whole_runs(substring.Settings())(iter([batch.slice(7)])) for r in b.to_pylist()]
    assert max(sizes) <= 500 and len(sizes) > 5
    wanted = [
        {"run": int(h), "doc": d, "place": 3 + i} for d in range(7, 60) for i, h in enumerate(whole(words[d], 50).view(np.int64))
    ]
    assert got == wanted


def test_batches_of_long_rows_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    rows = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("word "), 10_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    with small_batches(spark):
        found = [r["n"] for r in rows.mapInArrow(sizes, "n bigint").collect()]
    assert len(found) > 3 and max(found) < 2 * BATCH_BYTES and spark.conf.get(name) == before


def test_whole_runs_are_equal_where_words_are():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 3, 400).astype(np.uint64)
    for size in (1, 2, 5, 7, 50):
        runs = substring.whole_runs(words, size)
        plain = {}
        assert len(runs) == len(words) - size + 1
        for i, r in enumerate(runs.tolist()):
            plain.setdefault(tuple(words[i : i + size].tolist()), set()).add(r)
        assert all(len(x) == 1 for x in plain.values()) and len(set(runs.tolist())) == len(plain)
    assert len(substring.whole_runs(words[:5], 6)) == 0


def test_recall_of_fuzzy_passages(spark):
    """Passages with every n-th word changed, by length: found if 80 % of their words are listed with their source."""
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(5_000)]

    def some(n: int) -> list[str]:
        return [rng.choice(vocabulary) for _ in range(n)]

    rows, cases = [], {}
    for every in (10, 14, 20):
        for length in (60, 100, 200):
            for _ in range(30):
                passage = some(length)
                changed = list(passage)
                for i in range(rng.randrange(every), length, every):
                    changed[i] = rng.choice(vocabulary)
                number = len(rows)
                rows += [(number, " ".join(some(80) + passage + some(80))), (number + 1, " ".join(some(80) + changed + some(80)))]
                cases[number + 1] = (every, length)
    listed: dict[int, set[int]] = {}
    for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        if r.other_id == r.doc_id - 1 and r.doc_id in cases:
            listed.setdefault(r.doc_id, set()).update(range(max(r.start_word, 80), min(r.end_word, 80 + cases[r.doc_id][1])))
    found = Counter(cases[doc] for doc, words in listed.items() if len(words) >= 0.8 * cases[doc][1])
    for (every, length), least in {
        (10, 60): 0.55, (10, 100): 0.85, (10, 200): 0.85, (14, 60): 0.8, (14, 100): 0.9, (14, 200): 0.9,
        (20, 60): 0.9, (20, 100): 0.95, (20, 200): 0.95,
    }.items():
        assert found[every, length] >= least * 30, (every, length, found[every, length])


def test_two_texts_under_one_id_are_cut_apart(spark):
    rng = random.Random(21)
    passage, clean, start = sentence(rng, 120), sentence(rng, 200), sentence(rng, 30)
    rows = [(1, passage), (2, start + " " + passage), (2, clean), (None, passage), (3, clean), (3, clean)]
    for seed in range(3):
        rng.shuffle(rows)
        table = spark.createDataFrame(rows, "doc_id bigint, text string")
        out = sorted((r.doc_id or 0, r.text) for r in substring.cut_repeated_passages(table).collect())
        left = {(2, clean), (3, "")} if (2, clean) in out else {(2, ""), (3, clean)}
        assert set(out) == {(0, passage), (1, passage), (2, start)} | left
        found = substring.repeated_passages(table).collect()
        assert {(r.doc_id, r.other_id) for r in found} == {(2, 1), (3, 2) if (3, "") in out else (2, 3)}


def test_passages_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, n_chars int, _id int")
    assert substring.repeated_passages(none).count() == 0
    out = substring.cut_repeated_passages(none)
    assert out.columns == none.columns and out.count() == 0


def test_bare_runs_equal_plain_ones():
    rng = random.Random(13)
    for _ in range(200):
        size, rows = 5, []
        for doc in range(rng.randint(1, 4)):
            spans = sorted((a, a + rng.randint(1, 12)) for a in rng.sample(range(60), rng.randint(0, 4)))
            rows += [(doc, 0, a, b, 9, 0) for a, b in spans]
            runs = sorted((a, rng.choice([7, 8]), a + rng.choice([0, 0, 0, 30])) for a in rng.sample(range(60), rng.randint(0, 30)))
            rows += [(doc, 1, a, 0, o, t) for a, o, t in runs]
        if not rows:
            continue
        plain = []
        for doc in sorted({r[0] for r in rows}):
            covered = {w for r in rows if r[:2] == (doc, 0) for w in range(r[2], r[3])}
            group = []
            for r in [r for r in rows if r[:2] == (doc, 1)] + [None]:
                if group and (r is None or (r[2], r[4], r[5]) != (group[-1][2] + 1, group[-1][4], group[-1][5] + 1)):
                    a, b = group[0][2], group[-1][2] + size
                    if not set(range(a, b)) <= covered:
                        plain.append((doc, group[0][4], a, b, group[0][5], group[0][5] + b - a, b - a))
                    group = []
                group.append(r)
        found = substring.bare_runs([np.array(c, np.int64) for c in zip(*rows, strict=True)], size)
        assert list(zip(*[c.tolist() for c in found], strict=True)) == plain


def test_cut_passages_keeps_rows_and_columns(documents, texts):
    out = substring.cut_repeated_passages(documents)
    assert out.columns == documents.columns and out.dtypes == documents.dtypes
    rows = out.collect()
    assert len(rows) == len(texts)
    by_id = {r.doc_id: r.text for r in rows if r.doc_id not in (None, 13, 14)}
    source = dict(texts)
    assert by_id[2] == "" and by_id[1] == source[1] and by_id[4] == source[4] and by_id[7] is None
    shared = " ".join(source[4].split("\n")[1].split())
    assert shared not in by_id[5] and by_id[5].split()[:29] == source[5].split()[:29]
    assert all(r.n_chars == len(r.text or "") for r in rows)


def test_chains_match_quadratic_search():
    rng = np.random.default_rng(1)
    s = substring.Settings()
    for _ in range(30):
        n = int(rng.integers(1, 40))
        mine, theirs = np.sort(rng.integers(0, 300, n)), rng.integers(0, 300, n)
        order = np.lexsort((-theirs, mine))
        best = np.zeros(n)
        for j in order:
            options = [
                best[i] - s.gap_cost * (mine[j] - mine[i] + theirs[j] - theirs[i] - 2 * s.k)
                for i in range(n)
                if mine[i] < mine[j] and theirs[i] < theirs[j]
            ]
            best[j] = s.k + max([0.0, *options])
        chains = substring.chain(mine, theirs, s)
        assert sorted(np.concatenate(chains).tolist()) == list(range(n))
        top = chains[0]
        assert best.max() == pytest.approx(best[top[-1]])
        assert all(np.diff(mine[c]).min(initial=1) > 0 and np.diff(theirs[c]).min(initial=1) > 0 for c in chains)


def test_quick_chains_and_alignments_equal_general_ones():
    rng = random.Random(37)
    s = substring.Settings()
    for _ in range(300):
        n = rng.randint(1, 30)
        mine = np.cumsum([rng.choice([1, 3, 9, 13, 60, 90]) for _ in range(n)])
        shift = np.cumsum([rng.choice([0, 0, 0, 0, 1, 2]) for _ in range(n)]) * rng.choice([0, 1])
        theirs = mine + 7 + shift
        last = int(theirs[-1]) + 40
        y = np.array([rng.randint(0, 9) for _ in range(last)], np.uint64)
        x = y[7:].copy()
        for i in rng.sample(range(len(x)), len(x) // 6):
            x[i] = 99
        for m in mine.tolist():
            x[m : m + s.k] = y[m + 7 : m + 7 + s.k]
        quick = [c.tolist() for c in substring.chain(mine, theirs, s)]
        # a match far off its place sends the others through the tree, and is a chain of its own
        general = substring.chain(np.append(mine, mine[-1] + 1000), np.append(theirs, 0), s)
        assert sorted(quick) == sorted(c.tolist() for c in general if c.tolist() != [n])
        if not shift.any():
            equal, a = 0, int(mine[0])
            for p in mine.tolist():
                size = s.k - max(0, a - p)
                if size > 0:
                    p = max(a, p)
                    equal += substring._common(x[a:p], y[a + 7 : p + 7]) + size
                    a = p + size
            ahead, more = substring._extend(x[a:], y[a + 7 :])
            back, less = substring._extend(x[: mine[0]][::-1], y[: mine[0] + 7][::-1])
            expected = (int(mine[0]) - back, a + ahead, int(mine[0]) + 7 - back, a + 7 + ahead, equal + more + less)
            assert substring.align(x, y, mine, theirs, s) == expected


def test_winnowing_guarantees_a_seed():
    rng = np.random.default_rng(3)
    for n in (1, 5, 16, 17, 300):
        v = rng.integers(0, 12, n).astype(np.uint64)
        at = substring.winnow(v, 16)
        w = min(16, n)
        expected = {i + w - 1 - int(np.argmin(v[i : i + w][::-1])) for i in range(n - w + 1)}
        assert set(at.tolist()) == expected


# 2 quality rules


def test_text_counts(documents, texts):
    got = Counter(tuple(r) for r in rules.text_counts(documents).select("doc_id", *rules.BASE).collect())
    expected = Counter()
    for d, t in texts:
        w = WORD.findall(t or "")
        runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = Counter(runs)
        covered = {i + k for i, r in enumerate(runs) if often[r] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        signs = len(re.findall(r"[#*$%&|<>]", t or ""))
        expected[d, len(w), sum(map(len, w)), signs, len(lines) - len(set(lines)), len(covered)] += 1
    assert got == expected


def test_rules_find_shouting(labelled, no_labels, documents, nothing):
    docs, labels = labelled
    judged, found = rules.quality_rules(docs, labels)
    assert found
    for r in judged.collect():
        assert r.kept == (r.doc_id % 3 != 1)
    judged, found = rules.quality_rules(documents, no_labels)
    assert not found and all(r.kept == (not r.base_failed) for r in judged.collect())
    assert rules.quality_rules(nothing, labels)[0].count() == 0


def test_rules_run_no_python(labelled):
    plan = rules.text_counts(labelled[0])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 3 fingerprints


def test_fingerprints(documents, texts, nothing):
    rows = fingerprints.fingerprint_documents(documents).collect()
    ordered = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(rows) == len(ordered)
    expected = Counter()
    for i, (d, t) in enumerate(ordered):
        t, after = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        cut = len(t) // 4
        expected[d, len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == expected
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert prints[1] == prints[2] == prints[14] and prints[6] == prints[7] != prints[8]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprints.fingerprint_documents(nothing).count() == 0


def test_one_row_is_its_own_next(spark):
    rows = fingerprints.fingerprint_documents(spark.createDataFrame([(1, "abcdefgh")], "doc_id bigint, text string")).collect()
    assert rows[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and rows[0].near_next == 1.0


def test_equal_substrings_share_inner_phrases():
    rng = random.Random(9)
    body = sentence(rng, 300)
    for lead in ("", "x", "some other opening "):
        a, b = (np.frombuffer((s + body).encode("utf-32-le"), np.uint32).astype(np.int32) for s in ("", lead))
        for level in (1, 2):
            a, b = fingerprints.parse_level(a, level)[0], fingerprints.parse_level(b, level)[0]
            assert len(set(a.tolist()) & set(b.tolist())) >= len(set(a.tolist())) - 12
    many = ["", "a", body, "", "aaaa", body[7:], "ab" * 50]
    assert np.array_equal(fingerprints.sketches(many), np.stack([fingerprints.sketch(t) for t in many]))
    other = fingerprints.sketch(sentence(rng, 300))
    changed = fingerprints.sketch(body[:1000] + "!" + body[1000:])
    assert fingerprints.likeness(fingerprints.sketch(body), changed) > 0.85
    assert fingerprints.likeness(fingerprints.sketch(body), other) < 0.1


# 4 classifier


def test_classifier(labelled, no_labels, documents, nothing, texts):
    docs, labels = labelled
    for r in classifier.score_quality(docs, labels).collect():
        assert (r.score >= 0.3) == (r.doc_id % 3 != 1)
    scored = classifier.score_quality(documents, no_labels)
    assert scored.count() == len(texts) and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert classifier.score_quality(nothing, labels).count() == 0
    kept = classifier.drop_poor(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 600


def test_vectors_do_not_depend_on_layout(labelled):
    s = classifier.Settings(words=3000, min_count=2, rows=512, size=8)
    one, many = (labelled[0].repartition(n) for n in (1, 7))
    known = classifier.vocabulary(one, s)
    assert 0 < len(known.words) <= s.words
    assert np.array_equal(known.words, classifier.vocabulary(many, s).words)
    assert np.array_equal(classifier.word_vectors(one, known, s), classifier.word_vectors(many, known, s))


# 5 URL filters


def test_url_lists(spark):
    days = [f"2024-01-{d:02d}" for d in range(1, 9)]
    entries = [
        ("Example.com", days[1], "block"), ("a.example.com", days[2], "allow"), ("example.com", days[4], "remove"),
        ("a.example.com", days[5], "block"), ("a.example.com", days[5], "allow"), ("com", days[6], "block"),
        (None, days[0], "block"), ("x.org", None, "block"), ("x.org", days[0], "other"), ("x.org", days[0], None),
    ]
    hosts = ["http://a.EXAMPLE.com/p?q", "https://u:p@example.com:80", "http://b.a.example.com.#t", "http://x.org/", "no url", "", None]
    captures = [(i, u, d) for i, (u, d) in enumerate(itertools.product(hosts, [*days, None]))]
    captures.append(captures[0])
    asked = spark.createDataFrame(captures, "page_id int, url string, day string").withColumn("day", F.col("day").cast("date"))
    listed = spark.createDataFrame(entries, "pattern string, day string, action string").withColumn("day", F.col("day").cast("date"))
    asked = asked.withColumn("_entry", F.lit(1)).withColumn("pattern", F.lit("p"))

    def judge(host, day):
        if not host or not day:
            return None
        parts = host.split(".")
        for k in range(len(parts)):
            name = ".".join(parts[k:])
            past = [(d, {"block": 2, "allow": 1, "remove": 0}[a]) for p, d, a in entries if p and d and p.lower() == name and a in ("block", "allow", "remove") and d <= day]
            if past and max(past)[1]:
                return name, "block" if max(past)[1] == 2 else "allow"
        return None

    rows = urls.judge_captures(asked, listed, ["page_id"]).collect()
    assert len(rows) == len(captures)
    names = ["a.example.com", "example.com", "b.a.example.com", "x.org", None, None, None]
    for r in rows:
        host, day = names[r.page_id // 9], [*days, None][r.page_id % 9]
        found = judge(host, day)
        assert (r.host, r.pattern, r.action) == (host, *(found or (None, None)))
        assert r.kept == (not found or found[1] != "block")
    assert urls.judge_captures(asked, listed.limit(0), ["page_id"]).where("not kept").count() == 0
    assert urls.judge_captures(asked.limit(0), listed, ["page_id"]).count() == 0


# 6 pieces


def test_pieces_match_the_library(documents, texts, nothing):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("piece_bpe_32k.model")
    model = pieces.model_of(path)
    rows = pieces.encode_documents(documents, path, size=40, with_ids=True).collect()
    expected = Counter()
    for d, t in texts:
        ids = model.encode(t or "", add_eos=True)
        expected[d, len(ids), " ".join(map(str, ids)), model.decode(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in rows) == expected
    assert all(r.ids_sha256 == hashlib.sha256(r.ids.encode()).hexdigest() for r in rows)
    assert pieces.encode_documents(nothing, path).count() == 0
    for t in ("x ", " ", "  ", "▁", "a▁ b", "\x00�", " \n a\tb  "):
        found = [pieces.segment(model, w) for w in pieces.marked_words(t)]
        assert " ".join(x[1] for x in found) == " ".join(map(str, model.encode(t)))
        assert "".join(x[2] for x in found)[1:] == model.decode(model.encode(t))


# 7 SimHash


def plain_fingerprint(t):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
    runs = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(documents, texts, nothing):
    rows = simhash.simhash_components(documents).collect()
    prints = [(d, plain_fingerprint(t)) for d, t in texts]
    assert Counter((r.doc_id, r.fingerprint) for r in rows) == Counter((d, f"{f:016x}") for d, f in prints)
    group = list(range(len(prints)))
    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
            a, b = group[i], group[j]
            group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for (d, f), g in zip(prints, group, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    expected = Counter((d, least.get(g)) for (d, _), g in zip(prints, group, strict=True))
    assert Counter((r.doc_id, r.component_id) for r in rows) == expected
    assert simhash.simhash_components(nothing).count() == 0


def test_tiles_and_blocks_lose_no_component(spark):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.int64)
    flips = (1 << rng.integers(0, 62, (30, 40, 2), dtype=np.int64))
    prints = np.unique(np.concatenate((rng.integers(-(1 << 63), 1 << 63, 400, dtype=np.int64), (centres[:, None] ^ flips[..., 0] ^ flips[..., 1]).ravel())))
    frame = spark.createDataFrame([(int(p), int(p), 1) for p in prints], "id bigint, lane bigint, size int")
    u = prints.view(np.uint64)
    pairs = {(int(prints[i]), int(prints[j])) for i in range(len(u)) for j in (np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 2) + i + 1)}

    def parts(edges):
        group = {int(p): int(p) for p in prints}

        def root(x):
            while group[x] != x:
                x = group[x]
            return x

        for a, b in edges:
            group[max(root(a), root(b))] = min(root(a), root(b))
        return {p: root(p) for p in group}

    for options in ({"block": 16}, {"block": 7, "parts": 2}, {"parts": 0, "size": "size", "block": 50}):
        got = [(r.a, r.b, r.distance) for r in simhash.near_links(frame, ["lane"], 2, **options).collect()]
        assert all((a ^ b).bit_count() >= 0 and (min(a, b), max(a, b)) in pairs for a, b, _ in got)
        assert parts((a, b) for a, b, _ in got) == parts(pairs)


def test_near_copies_keep_one(documents, texts, nothing):
    kept = simhash.drop_near_copies(documents)
    assert kept.columns == documents.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and not ids[2] and not ids[3] and not ids[14] and ids[None] == 2
    assert all(ids[d] == 1 for d in (6, 7, 8, 9, *range(100, 160))) and ids[13] == 2
    assert simhash.drop_near_copies(nothing).count() == 0


def test_near_copies_of_one_text_are_one_group(spark):
    rng = random.Random(8)
    base = sentence(rng, 200).split()
    rows = [(1, " ".join(base))]
    for i in range(60):  # 0.86 like the first, 0.73 like each other, so only links to the first pass
        copy = list(base)
        for place in rng.sample(range(10, 190, 6), 3):
            copy[place] = f"new{i}at{place}"
        rows.append((i + 2, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.group for r in simhash.near_copies(frame).collect()} == {1}


def test_alike_links_lose_no_pair(spark):
    rng = np.random.default_rng(6)
    sets = {}
    for g in range(12):
        base = rng.integers(0, 1 << 62, int(rng.integers(1, 90)), dtype=np.uint64)
        for _ in range(20):
            own = base[rng.random(len(base)) < 0.93]
            sets[len(sets)] = (g % 3, np.unique(np.concatenate((own, rng.integers(0, 1 << 62, int(rng.integers(0, 4)), dtype=np.uint64)))))
    members = spark.createDataFrame([(i, g, len(x)) for i, (g, x) in sets.items()], "id bigint, group bigint, size bigint")
    held = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, (_, x) in sets.items()], "id bigint, _set binary")
    pairs = set()
    for (i, (g, x)), (j, (h, y)) in itertools.combinations(sets.items(), 2):
        common = len(np.intersect1d(x, y))
        if g == h and common and common / (len(x) + len(y) - common) >= 0.8:
            pairs.add((i, j))

    def parts(edges):
        group = list(range(len(sets)))
        for a, b in edges:
            a, b = group[a], group[b]
            group = [min(a, b) if x in (a, b) else x for x in group]
        return group

    for most in (1 << 21, 3000, 500):
        got = [(r.a, r.b) for r in simhash.alike_links(members, held, 0.8, most).collect()]
        assert {(min(p), max(p)) for p in got} <= pairs
        assert parts(got) == parts(pairs)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, None)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    group = {n: n for e in edges if None not in e for n in e if e[0] != e[1]}
    for _ in range(400):
        for a, b in edges:
            if b is not None and a != b:
                group[a] = group[b] = min(group[a], group[b])
    assert got == group


# 8 packing


def test_packing(documents, texts, nothing):
    rows = packing.pack_documents(documents, (64, 256, 1024), group_pieces=20).collect()
    lengths = Counter()
    for r in rows:
        lengths[r.doc_id] += r.length
        assert r.length <= 1024 and r.start == r.piece * 1024 and r.filled <= r.capacity
    expected = Counter()
    for d, t in texts:
        expected[d] += len(WORD.findall(t or "")) + 1
    assert lengths == expected
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *itertools.accumulate(r.length for r in own)][:-1]
        total = sum(r.length for r in own)
        assert own[0].capacity == min(c for c in (64, 256, 1024) if c >= total) and own[0].filled == total
    assert packing.pack_documents(nothing).count() == 0


def test_best_fit_takes_the_tightest_bin():
    rng = random.Random(3)
    pieces_ = sorted((rng.randint(1, 256) for _ in range(400)), reverse=True)
    fast, rooms, to_come = packing.BestFit((64, 128, 256)), [], sum(pieces_)
    for n in pieces_:
        to_come -= n
        chosen, _ = fast.place(n, to_come)
        open_ = [r for r in rooms if r >= n]
        if open_:
            assert rooms[chosen] == min(open_)
        else:
            assert chosen == len(rooms)
            rooms.append(packing.least_cost_size(n, to_come, (64, 128, 256)))
        rooms[chosen] -= n


# 9 toxicity


def test_toxicity(labelled, no_labels, documents, nothing, texts):
    docs, labels = labelled
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 3 == 2) for r in rows)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 600
    scored = toxicity.score_toxicity(documents, no_labels)
    assert scored.count() == len(texts) and scored.where("score is null").count() == 0
    assert toxicity.score_toxicity(nothing, labels).count() == 0


def test_segments_match_the_definition():
    """Maximal segments by recursion: the best one, then the same left and right of it."""

    def plain(values, shift):
        best, at = 0.0, None
        for i in range(len(values)):
            for j in range(i + 1, len(values) + 1):
                if sum(values[i:j]) > best + 1e-9:
                    best, at = sum(values[i:j]), (i, j)
        if at is None:
            return []
        return plain(values[: at[0]], shift) + [(at[0] + shift, at[1] + shift, best)] + plain(values[at[1] :], shift + at[1])

    rng = random.Random(8)
    for _ in range(60):
        n = rng.randint(1, 25)
        values = [rng.choice((1.37, 2.71, 0.53)) if rng.random() < 0.3 else -0.4 for _ in range(n)]
        at = np.array([i for i, v in enumerate(values) if v > 0], np.int64)
        got = toxicity.maximal_segments(at, np.array([values[i] for i in at]), 0.4)
        expected = plain(values, 0)
        assert [x[:2] for x in got] == [x[:2] for x in expected]
        assert [x[2] for x in got] == pytest.approx([x[2] for x in expected])


# 10 shards


def test_shards(documents, texts, nothing):
    rows = shards.shard_documents(documents, 4, block_groups=6, block_partitions=3).collect()
    crc = Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    assert crc == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    where = {}
    for r in rows:
        where.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(v) == 1 for k, v in where.items() if k[0] > 1)
    assert shards.shard_documents(nothing).count() == 0


def test_differencing_beats_greedy():
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 10_000, 500)
    sums = np.zeros((500, 8), np.int64)
    sums[:, -1] = sizes
    total, went = shards.difference(sums)
    assert np.array_equal(np.bincount(went[:, -1], weights=sizes, minlength=8).astype(np.int64), total)
    greedy = np.zeros(8, np.int64)
    for n in sorted(sizes, reverse=True):
        greedy[greedy.argmin()] += n
    assert np.ptp(total) <= np.ptp(greedy) and np.ptp(total) < 50


def test_hashes_do_not_depend_on_place():
    from millwatch.llm.common import SPACE_ONLY, word_runs

    rows = ["a bb  ccc", None, "", "bb", " é\tbb\x0bccc ", "x" * 3_000_000, "bb ccc"]
    got = []
    for _, _, w in word_runs(pa.array(rows), SPACE_ONLY):
        got += [w.hash[w.first[i] : w.first[i + 1]].tolist() for i in range(len(w.first) - 1)]
    names = {}
    for text, hashes in zip(rows, got, strict=True):
        words = WORD.findall(text or "")
        assert len(words) == len(hashes)
        for word, h in zip(words, hashes, strict=True):
            assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)
