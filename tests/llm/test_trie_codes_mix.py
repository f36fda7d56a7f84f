"""Prefix trie, vector codes and source mix against plain versions, on small awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from contextlib import contextmanager
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwatch.llm import codes, mixing, trie

WORD = re.compile("[^\x20\x09-\x0D]+")


@contextmanager
def settings(spark, **values):
    """Small batches and many partitions, so that every boundary is met."""
    names = {"batch": "spark.sql.execution.arrow.maxRecordsPerBatch", "parts": "spark.sql.shuffle.partitions", "adaptive": "spark.sql.adaptive.enabled"}
    before = {names[k]: spark.conf.get(names[k]) for k in values}
    for k, v in values.items():
        spark.conf.set(names[k], str(v).lower())
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


# ---- prefix trie ----------------------------------------------------------

TALK = "conv_id bigint, turn int, role string, text string, path string, key string, words int, kind int"


def plain_paths(rows, family=20):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), (role or "", text or "")))
    turns = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    paths = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(turns.get(c - c % family, [])[:h] + mine[h:])
    return paths


def plain_trie(paths):
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, found in members.items():
        words = len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(found) - 1) * words
            leaves[p[:d]] += children[p] == 0
    rows = []
    for p, found in members.items():
        ends = ",".join(str(c) for c in sorted(found) if paths[c] == p)
        rows.append(
            (min(found), len(p), min(members[p[:-1]]) if p else None, len(found), children[p], leaves[p], saved[p],
             hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(rows, key=str)


def talk_rows(seed: int, conversations: int = 150):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        if rng.random() < 0.05:
            continue
        for turn in range(rng.choice([1, 1, 2, 3, 4, 6])):
            text = " ".join(rng.choice("ab") for _ in range(rng.randint(0, 2))) if rng.random() < 0.9 else None
            rows.append((c, turn if turn or rng.random() < 0.8 else None, rng.choice(["u", "u", "u", None, ""]), text))
    # a large group of conversations that are alike, one very long, one with long texts
    for c in range(1000, 1100):
        rows += [(c, 0, "s", "one two"), (c, 1, "u", "three")]
    rows += [(2000, t, "u", "w" if t % 2 else "x y") for t in range(300)]
    rows += [(3000, 0, "u", "long " * 20_000), (None, 0, "u", "nobody")]
    rows.append((5041, 0, "u", "gone"))  # base 5040 is absent; a checksum of 5041 takes away what there is, or not
    rng.shuffle(rows)
    return rows


def got(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("seed,batch,parts", [(1, 7, 9), (2, 1, 3), (3, 10_000, 1)])
def test_trie_equals_plain_trie_across_chunks_and_tasks(spark, seed, batch, parts):
    rows = talk_rows(seed)
    table = spark.createDataFrame([(*r, "p", "k", 5, 7) for r in rows], TALK).repartition(3)
    with settings(spark, batch=batch, parts=parts, adaptive=False):
        found = got(trie.prefix_trie(trie.with_shared_openings(trie.turn_paths(table))))
    assert found == plain_trie(plain_paths(rows))


def test_trie_of_own_turns_and_of_conversations_without_turns(spark):
    rows = [(c, 0, "u", "same") for c in range(1, 8)]
    table = spark.createDataFrame([(*r, "p", "k", 5, 7) for r in rows], TALK)
    own = got(trie.prefix_trie(trie.turn_paths(table)))
    assert own == plain_trie({c: (("u", "same"),) for c, *_ in rows})
    # none of them has a base, so those with a checksum that is no multiple of four have no turns at all
    rebuilt = plain_paths(rows)
    assert any(not p for p in rebuilt.values())
    assert got(trie.prefix_trie(trie.with_shared_openings(trie.turn_paths(table)))) == plain_trie(rebuilt)


def test_trie_of_an_empty_table_has_no_rows(spark):
    table = spark.createDataFrame([], TALK)
    assert got(trie.prefix_trie(trie.with_shared_openings(trie.turn_paths(table)))) == []


def test_repeated_turns_have_one_order_on_every_layout(spark):
    rows = [(1, 0, "u", "a"), (1, 0, "u", "b"), (1, 0, "u", "a"), (1, None, "s", "first"), (2, 0, "u", "b"), (2, 0, "u", "a")]
    table = spark.createDataFrame([(*r, "p", "k", 5, 7) for r in rows], TALK)
    results = {tuple(got(trie.prefix_trie(trie.turn_paths(table.repartition(n))))) for n in (1, 2, 5)}
    assert len(results) == 1


# ---- vector codes ---------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, code string, error double, part int, _v int"


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = []
    for ident, vector, label in rows:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((ident, [math.floor(4096 * float(np.float32(x))) for x in vector], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(cut[e][p]) for e in range(min(entries, len(kept)))] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            chosen = defaultdict(list)
            for one in cut:
                chosen[nearest(one[p], books[p])[1]].append(one[p])
            for e, found in chosen.items():
                books[p][e] = [sum(x) // len(found) for x in zip(*found)]
    out = []
    for (ident, _, label), one in zip(kept, cut):
        best = [nearest(one[p], books[p]) for p in range(parts)]
        out.append((ident, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
    totals = Counter()
    for _, _, error, label in out:
        totals[label] += error
    return sorted(((i, c, e, totals[label]) for i, c, e, label in out), key=str), books


def vector_rows(n=300, width=16, seed=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 0.3, (9, width)).astype(np.float32)
    rows = [(i, [float(x) for x in base[i % 9] + np.round(rng.normal(0, 0.05, width), 2).astype(np.float32)], int(i % 4)) for i in range(n)]
    rows += [(i, rows[0][1], None) for i in range(400, 520)]  # one common vector without a label
    rows += [(7, rows[3][1], 2), (7, rows[3][1], 2), (None, rows[5][1], 1), (None, rows[6][1], 1)]
    rows += [(600, None, 1), (601, [None] + rows[0][1][1:], 1), (602, [float("nan")] + rows[0][1][1:], 1), (603, [float("inf")] + rows[0][1][1:], None)]
    return rows


@pytest.mark.parametrize("cell", [16, 256, 100_000])
def test_codes_equal_plain_codes_at_every_cell_width(spark, cell):
    rows = vector_rows()
    table = spark.createDataFrame([(i, v, label, "c", 0.5, 3, 4) for i, v, label in rows], VECTORS).repartition(5)
    found, books = codes.compress_vectors(table, cell=cell)
    expected, plain_books = plain_codes(rows)
    assert books.tolist() == plain_books
    mine = [(r[0], r[1].hex(), r[2], r[3]) for r in found.select("vec_id", "code", "error", "label_error").collect()]
    assert sorted(mine, key=str) == expected
    back = codes.decode(found, books).collect()
    width = len(rows[0][1]) // 8
    for r in back[:20]:
        assert r["vector"] == [x / 4096 for p in range(8) for x in plain_books[p][r["code"][p]]] and len(r["vector"]) == 8 * width


def test_cells_forget_and_still_find_the_nearest():
    rng = np.random.default_rng(1)
    book, parts = rng.integers(-900, 900, (16, 8)), rng.integers(-2000, 2000, (3000, 8))
    parts[::7] = book[rng.integers(0, 16, len(parts[::7]))]
    distances = ((parts[:, None] - book[None]) ** 2).sum(2)
    cells = codes.Cells(book, 300, most=5)
    for _ in range(2):
        entry, least = cells.nearest(parts)
        assert (entry == distances.argmin(1)).all() and (least == distances.min(1)).all()
    assert len(codes.Cells(book, 300, most=5).slots) == 0
    few = codes.Cells(book, 3_000, most=5)
    assert (few.nearest(parts)[0] == distances.argmin(1)).all()
    colliding = codes.Cells(book, 300)
    colliding.factors[:] = 0  # every cell under one hash
    assert (colliding.nearest(parts)[0] == distances.argmin(1)).all()
    twice = codes.Cells(np.concatenate((book, book)), 300)
    assert (twice.nearest(parts)[0] == distances.argmin(1)).all()  # ties go to the lower entry


def test_few_no_and_unfit_vectors(spark):
    few = spark.createDataFrame([(i, [float(i)] * 8, None, "c", 0.5, 3, 4) for i in range(3)], VECTORS)
    found, books = codes.compress_vectors(few)
    assert books.shape == (8, 3, 1) and {r["error"] for r in found.collect()} == {0}
    none, books = codes.compress_vectors(spark.createDataFrame([], VECTORS))
    assert none.columns == ["vec_id", "label", "code", "error", "label_error"] and none.count() == 0 and books.size == 0
    uneven = spark.createDataFrame([(1, [0.5] * 8, 1, "c", 0.5, 3, 4), (2, [0.5] * 16, 1, "c", 0.5, 3, 4)], VECTORS)
    with pytest.raises(ValueError, match="one length"):
        codes.compress_vectors(uneven)


# ---- source mix -----------------------------------------------------------

DOCS = "doc_id bigint, text string, source string, size string, taken string, target string, shard string, _rank int, quota int"


def mix_rows(seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        source = rng.choice(["a", "a", "a", "b", "c", "ä", None, "", "Z"])
        rows.append((i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 30, 80]))), source))
    rows += [(1000, "w " * 9_000, "a"), (1001, None, "nothing"), (1002, " \n", "nothing"), (1003, "w", "tiny")]
    rows += [(1004, "w x y", "b")] * 5 + [(None, "w x", "c"), (None, None, "c")]
    return rows


def plain_targets(rows, ceiling=3):
    words = defaultdict(int)
    for _, text, source in rows:
        words[source] += len(WORD.findall(text or ""))
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(words.values()), set()
    while True:
        open_ = [s for s in order if s not in capped]
        rest = total - sum(ceiling * words[s] for s in capped)
        level = Fraction(rest, sum(weight[s] for s in open_)) if open_ else Fraction(0)
        over = {s for s in open_ if level * weight[s] > ceiling * words[s]}
        if not over:
            return {s: ceiling * words[s] if s in capped else level * weight[s] for s in order}, words
        capped |= over


def plain_seats(votes, caps, seats):
    bids = [(-Fraction(v) / (2 * k - 1), key) for key, v in votes.items() if v > 0 for k in range(1, caps[key] + 1)]
    return Counter(key for _, key in sorted(bids)[:seats])


@pytest.mark.parametrize("block,units", [(16, 300), (64, 1 << 18), (7, 50)])
def test_mix_comes_near_its_targets(spark, block, units):
    rows = mix_rows()
    table = spark.createDataFrame([(*r, "s", "t", "g", "h", 1, 2) for r in rows], DOCS).repartition(4)
    mixed = mixing.mix_documents(table, block_words=block, shard_units=units).toPandas()
    targets, words = plain_targets(rows)
    assert len(mixed) == len(rows)
    expected = Counter((None if i is None else i, len(WORD.findall(t or ""))) for i, t, _ in rows)
    assert Counter((None if np.isnan(i) else int(i), s) for i, s in zip(mixed.doc_id, mixed["size"])) == expected
    assert (mixed.taken <= 3 * mixed["size"]).all() and (mixed.taken >= 0).all()
    shards = mixed.groupby(mixed.source.fillna("no source"))["shard"].nunique()
    for source, group in mixed.groupby(mixed.source.fillna("no source")):
        key = None if source == "no source" else source
        assert set(group.source_size) == {words[key]} and set(group.target) == {float(targets[key])}
        # each shard's blocks differ from the average by the rounding of its own number of blocks
        assert abs(group.taken.sum() - float(targets[key])) <= 2 * block + 3 * block * shards[source]
    assert abs(mixed.taken.sum() - sum(words.values())) <= 3 * block * shards.sum()
    again = mixing.mix_documents(table.repartition(7), block_words=block, shard_units=units).toPandas()
    order = ["doc_id", "source", "size", "taken", "shard"]
    assert sorted(map(str, mixed[order].to_numpy().tolist())) == sorted(map(str, again[order].to_numpy().tolist()))


def test_seats_go_by_highest_quotients_within_their_caps(spark):
    rng = random.Random(8)
    for most, ranked in ((5, 1_000), (400, 1_000), (5_000, 1_000)):
        votes = {i: rng.choice([0.0, 0.01, 0.5, rng.random() * most, float(most)]) for i in range(40)}
        caps = {i: max(1, math.ceil(v * rng.choice([1, 3]))) for i, v in votes.items()}
        seats = round(sum(votes.values()))
        table = spark.createDataFrame([(i, votes[i], caps[i]) for i in votes], "k bigint, _votes double, _cap bigint")
        found = {r["k"]: r["_seats"] for r in mixing.apportion(table, "k", seats).collect()}
        plain = plain_seats(votes, caps, seats)
        assert found == {i: plain[i] for i in votes}


def test_mix_without_words_or_rows(spark):
    none = spark.createDataFrame([(1, None, "a", "s", "t", "g", "h", 1, 2), (2, "  ", None, "s", "t", "g", "h", 1, 2)], DOCS)
    assert {(r["size"], r["target"], r["taken"]) for r in mixing.mix_documents(none).collect()} == {(0, 0.0, 0)}
    assert mixing.mix_documents(none.limit(0)).count() == 0


def test_long_texts_give_blocks_of_their_own(spark):
    rows = [(1, "w " * 500_000, "a"), (2, "w " * 1_000, "b")]
    table = spark.createDataFrame([(*r, "s", "t", "g", "h", 1, 2) for r in rows], DOCS)
    found = {r["doc_id"]: r for r in mixing.mix_documents(table).collect()}
    assert found[2]["taken"] == 3_000 and abs(found[1]["taken"] - 498_000) < 300
