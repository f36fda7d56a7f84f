"""SimHash fingerprints and exact comparison of all of them in tiles.

Fingerprints are dealt into tiles by their population counts: the bits set in
each of a few parts of the fingerprint, and, where a size is given, the band of
the size.  Two fingerprints within the radius differ by no more than the radius
in these counts, so only tiles whose counts differ by no more are compared.
Tiles are cut into blocks of bounded size.  A task holds one block; the rows of
the block and of the visiting tiles pass by in batches and are compared by
exclusive-or and bit counts in numpy.  Of the links found in a batch it hands on
a spanning forest of least distance: no component is lost, and a group of n near
copies gives no n * n rows.  Where links must pass a further check (``near_copies``)
the forest only tells which texts may be linked at all; all their pairs are checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from millwatch.llm.common import SPACE_ONLY, mix, word_runs
from millwatch.llm.components import connected_components
from millwatch.session import stage

BLOCK = 32_768
_ROWS = 4096
_SPAN = 32  # room for a part's count in a tile number
_FOLD = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def _majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes."""
    n = len(hashes)
    if n == 0:
        return 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        own = hashes[lo : lo + (1 << 16)]
        ones += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def shingle_fingerprint(text: str, words: int = 3) -> int:
    """SimHash of the XXH64 (seed 42) of all runs of ``words`` words, ASCII capitals folded; 0 without words."""
    found = text.encode().translate(_FOLD).split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    runs = map(b" ".join, zip(*(found[k : k + n] for k in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    return _majority(np.fromiter((digest(r, 42) for r in runs), np.uint64, n))


def fingerprint(text: Column, words: int = 3) -> Column:
    """The fingerprint as a signed 64-bit number; null is an empty text, whose fingerprint is 0."""

    @arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        values = np.fromiter((shingle_fingerprint(t or "", words) for t in texts.to_pylist()), np.uint64, len(texts))
        return pa.array(values.view(np.int64))

    return run(text)


def wide_fingerprint(text: Column, words: int = 5, lanes: int = 4) -> Column:
    """array<bigint>: ``lanes`` fingerprints from independent hashes of the distinct word runs, then their count.

    For links of a given similarity, where 64 bits are too coarse.
    """

    @arrow_udf("array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), lanes + 1), np.uint64)
        for row, stop, w in word_runs(texts, SPACE_ONLY, lower=True):
            for i in range(stop - row):
                shingles = shingle_set(w.hash[w.first[i] : w.first[i + 1]], words)
                for k in range(lanes):
                    out[row + i, k] = _majority(mix(shingles + np.uint64(k)))
                out[row + i, lanes] = len(shingles)
        flat = pa.array(out.view(np.int64).ravel())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * (lanes + 1)), flat)

    return run(text)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of runs of ``size`` words; of the whole where it is shorter."""
    n = len(words)
    if n == 0:
        return words
    k = min(size, n)
    run = words[: n - k + 1].copy()
    for j in range(1, k):
        run = mix(run + words[j : n - k + 1 + j] * np.uint64(2 * j + 1))
    return np.unique(run)


def spanning_forest(a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Places of edges of a minimum spanning forest (Boruvka), for nodes given by any numbers."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    order = np.lexsort((b, a, distance))
    rank = np.empty(len(a), np.int64)
    rank[order] = np.arange(len(a))
    root = np.arange(len(nodes))
    chosen = np.zeros(len(a), bool)
    live = np.arange(len(a))
    while True:
        live = live[root[a[live]] != root[b[live]]]
        if len(live) == 0:
            return np.flatnonzero(chosen)
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, root[a[live]], rank[live])
        np.minimum.at(best, root[b[live]], rank[live])
        pick = order[np.unique(best[best < len(a)])]
        chosen[pick] = True
        # hook each picked edge; ranks are distinct, so these edges close no circle
        before = None
        while before is None or not np.array_equal(before, root):
            before = root.copy()
            low = np.minimum(root[a[pick]], root[b[pick]])
            np.minimum.at(root, root[a[pick]], low)
            np.minimum.at(root, root[b[pick]], low)
            root = root[root]


def _close_pairs(home: np.ndarray, other: np.ndarray, radius: int, screen: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows within the radius; the first lane alone is compared for all pairs."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(home), 512):
        near = np.bitwise_count(home[lo : lo + 512, 0][:, None] ^ other[:, 0][None]) <= screen
        i, j = np.nonzero(near)
        if len(i):
            i += lo
            d = np.bitwise_count(home[i] ^ other[j]).sum(axis=1, dtype=np.int64)
            ok = d <= radius
            found.append((i[ok], j[ok], d[ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def _compare(lanes: int, radius: int, screen: int):
    """Rows come by tile and block, the block's own before the visitors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ids, closed = None, [], [], True

        def links(prints, names, visitors, visitor_names, same):
            out = []
            for lo in range(0, len(visitors), _ROWS):
                part, part_names = visitors[lo : lo + _ROWS], visitor_names[lo : lo + _ROWS]
                own = prints[: lo + _ROWS] if same else prints
                i, j, d = _close_pairs(own, part, radius, screen)
                if same:
                    ok = i < j + lo
                    i, j, d = i[ok], j[ok], d[ok]
                if len(i):
                    a, b = names[i], part_names[j]
                    keep = spanning_forest(a, b, d)
                    out.append((a[keep], b[keep], d[keep]))
            for a, b, d in out:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], ["a", "b", "distance"])

        for batch in batches:
            cells = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4 + lanes)]
            tile, block, role, ident = cells[:4]
            prints = np.stack([c.astype(np.int64).view(np.uint64) for c in cells[4:]], axis=1)
            turn = np.flatnonzero((np.diff(tile) != 0) | (np.diff(block) != 0) | (np.diff(role) != 0)) + 1
            bounds = [0, *turn.tolist(), len(tile)]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if lo == hi:
                    continue
                now = (tile[lo], block[lo])
                if now != key:
                    if not closed:
                        own, names = np.concatenate(held), np.concatenate(ids)
                        yield from links(own, names, own, names, True)
                    key, held, ids, closed = now, [], [], False
                if role[lo] == 0:
                    held.append(prints[lo:hi])
                    ids.append(ident[lo:hi])
                    continue
                if not held:
                    continue
                if len(held) > 1:
                    held, ids = [np.concatenate(held)], [np.concatenate(ids)]
                if not closed:
                    yield from links(held[0], ids[0], held[0], ids[0], True)
                    closed = True
                yield from links(held[0], ids[0], prints[lo:hi], ident[lo:hi], False)
        if not closed and held:
            own, names = np.concatenate(held), np.concatenate(ids)
            yield from links(own, names, own, names, True)

    return run


def near_links(
    prints: DataFrame, lanes: list[str], radius: int, screen: int | None = None, parts: int = 4, size: str | None = None,
    ratio: float = 0.8, block: int = BLOCK,
) -> DataFrame:
    """(a, b, distance): links within ``radius`` bits between rows of ``prints`` (id, lanes, size), as spanning forests.

    ``id`` is unique.  ``parts`` is the number of parts of the first lane whose
    population counts make the tile, 0 for a wide radius, where counts say little.
    ``screen`` is the radius of the first lane alone (the whole radius by
    default).  With ``size``, pairs whose sizes have a smaller ratio than
    ``ratio`` are skipped in whole bands, because their sets cannot be alike
    enough; a pair of neighbouring bands is still compared by its bits only.
    """
    width = 64 // max(1, parts)
    counts = [
        F.bit_count(F.col(lanes[0]).bitwiseAND(F.lit(_signed(((1 << width) - 1) << (width * k))))).cast("bigint")
        for k in range(parts)
    ]
    tile = F.lit(0).cast("bigint")
    for c in counts:
        tile = tile * _SPAN + c + radius
    steps = [0]
    if parts:
        moves = [m for m in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, m)) <= radius and m > (0,) * parts]
        steps += [sum(d * _SPAN ** (parts - 1 - k) for k, d in enumerate(m)) for m in moves]
    if size:
        band = F.floor(F.log(F.greatest(F.col(size), F.lit(1)).cast("double")) / float(-np.log(ratio)) + 1e-9)
        tile = tile * 4096 + band
        # up: the same counts or any near ones, in the next band; both directions of counts then
        steps = [0] + [s * 4096 for s in steps[1:]] + [s * 4096 * sign + 1 for s in steps for sign in ((1, -1) if s else (1,))]
    home = prints.select(F.col("id").alias("_id"), *lanes, tile.alias("_tile"))
    filled = home.groupBy("_tile").agg(F.count("*").alias("_n"))
    # the number of tiles is bounded by the counts that fingerprints can have, not by the rows
    filled = filled.select("_tile", F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    own = home.join(filled, "_tile").withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int"))
    owners = own.select("_tile", "_block", F.lit(0).alias("_role"), "_id", *lanes)
    later = own.where("_blocks > _block + 1").select(
        "_tile", F.explode(F.expr("sequence(_block + 1, _blocks - 1)")).alias("_block"), F.lit(1).alias("_role"), "_id", *lanes
    )
    dealt = owners.unionByName(later)
    if steps[1:]:
        moved = home.select(F.explode(F.array(*(F.col("_tile") + F.lit(s) for s in steps[1:]))).alias("_tile"), "_id", *lanes)
        visits = moved.join(filled, "_tile").select(
            "_tile", F.explode(F.expr("sequence(0, _blocks - 1)")).alias("_block"), F.lit(1).alias("_role"), "_id", *lanes
        )
        dealt = dealt.unionByName(visits)
    dealt = dealt.repartition("_tile", "_block").sortWithinPartitions("_tile", "_block", "_role", "_id")
    found = dealt.mapInArrow(
        _compare(len(lanes), radius, radius if screen is None else screen), "a bigint, b bigint, distance bigint"
    )
    return found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def simhash_components(documents: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id for every row of ``documents``.

    Texts link at ``radius`` or fewer differing bits of 64; component_id is the
    least doc_id that links reach.  Equal fingerprints are one node.  Null and
    empty texts have fingerprint 0 and link like any other; rows without doc_id
    get a component only from rows that have one.  An empty table
    gives no rows; of a long text all runs count.
    """
    prints = stage(documents.select("doc_id", fingerprint(F.col("text"), words).alias("_f")), "fingerprints")
    nodes = stage(prints.groupBy("_f").agg(F.min("doc_id").alias("_first")), "nodes")
    links = near_links(nodes.select(F.col("_f").alias("id"), F.col("_f").alias("lane")), ["lane"], radius)
    groups = connected_components(links.select("a", "b"))
    least = nodes.join(groups, nodes["_f"] == groups["node"], "left").select(
        "_f", "_first", F.coalesce("component", "_f").alias("_group")
    )
    smallest = least.groupBy("_group").agg(F.min("_first").alias("component_id"))
    named = least.join(smallest, "_group").select("_f", "component_id")
    return prints.join(named, "_f").select(
        "doc_id", F.lower(F.lpad(F.hex("_f"), 16, "0")).alias("fingerprint"), "component_id"
    )


def alike_forest(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of all pairs of sets (of distinct numbers) with a Jaccard index of ``similarity`` or more.

    A breadth-first search: the sets that hold each number are listed, so one pass over the lists of
    a set's numbers counts what it has in common with every set not reached yet.  No pair is left out.
    """
    size = np.array([len(x) for x in sets], np.int64)
    first = np.concatenate(([0], np.cumsum(size)))
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    holder, held = np.repeat(np.arange(len(sets)), size)[order], token[order]
    tokens = int(token.max()) + 1 if len(token) else 0
    free, listed = np.ones(len(sets), bool), 2 * len(sets) + 1
    a, b = [], []
    for start in np.argsort(-size, kind="stable").tolist():
        if not free[start]:
            continue
        free[start] = False
        left, queue = int(free.sum()), [start]
        while queue and left:
            if 2 * left < listed:  # sets already reached leave the lists
                keep = free[holder]
                holder, held, listed = holder[keep], held[keep], left
                count = np.bincount(held, minlength=tokens)
                begin = np.cumsum(count) - count
            i = queue.pop()
            own = token[first[i] : first[i + 1]]
            many = count[own]
            at = np.repeat(begin[own] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            common = np.bincount(holder[at], minlength=len(sets))
            near = np.flatnonzero(free & (common > 0))
            near = near[common[near] / (size[i] + size[near] - common[near]) >= similarity]
            free[near] = False
            left -= len(near)
            queue += near.tolist()
            a += [i] * len(near)
            b += near.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _verify(similarity: float, most: int):
    """Rows come by tile and block, the block's own before the visitors, which are taken in parts of ``most`` runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, names, parts, part_names, weight = None, [], [], [], [], 0

        def links():
            nodes = np.array(names + part_names, np.int64)
            if len(nodes) < 2:
                return []
            a, b = alike_forest(own + parts, similarity)
            return [pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])]

        for batch in batches:
            tile, band, block, role, ident = (batch.column(i).to_pylist() for i in range(5))
            for i, (now, visits) in enumerate(zip(zip(tile, band, block, strict=True), role, strict=True)):
                value = np.frombuffer(batch.column(5)[i].as_buffer(), np.uint64).copy()
                if now != key:
                    if key is not None:
                        yield from links()
                    key, own, names, parts, part_names, weight = now, [], [], [], [], 0
                if visits:
                    if parts and weight + len(value) > most:
                        yield from links()
                        parts, part_names, weight = [], [], 0
                    parts.append(value)
                    part_names.append(ident[i])
                    weight += len(value)
                else:
                    own.append(value)
                    names.append(ident[i])
        if key is not None:
            yield from links()

    return run


def alike_links(members: DataFrame, sets: DataFrame, similarity: float, most: int = 1 << 21) -> DataFrame:
    """(a, b): spanning forests of all pairs with a Jaccard index of ``similarity`` or more inside each group.

    ``members`` (id, group, size) are the nodes with their candidate group and number of runs, ``sets``
    (id, _set) their runs.  A group of more than ``most`` runs is cut into bands of the size and those into
    blocks; a block meets every other of its band and of the next one, so every pair that can be alike meets.
    """
    weight = F.col("size") + 64  # so that a block is bounded in rows too
    whole = members.groupBy("group").agg(F.sum(weight).alias("_all"))
    band = F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) / float(-np.log(similarity)) + 1e-9)
    home = members.join(whole, "group").select(
        "id", "group", F.when(F.col("_all") <= most, F.lit(0).cast("bigint")).otherwise(band + 1).alias("_band"), weight.alias("_weight")
    )
    filled = home.groupBy("group", "_band").agg(F.ceil(F.sum("_weight") / most).cast("int").alias("_blocks"))
    own = home.join(filled, ["group", "_band"]).withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    owners = own.select("group", "_band", "_block", F.lit(0).alias("_role"), "id")
    later = own.where("_blocks > _block + 1").select(
        "group", "_band", F.explode(F.expr("sequence(_block + 1, _blocks - 1)")).alias("_block"), F.lit(1).alias("_role"), "id"
    )
    up = home.where("_band > 0").select("group", (F.col("_band") + 1).alias("_band"), "id").join(filled, ["group", "_band"])
    up = up.select("group", "_band", F.explode(F.expr("sequence(0, _blocks - 1)")).alias("_block"), F.lit(1).alias("_role"), "id")
    dealt = owners.unionByName(later).unionByName(up).join(sets, "id").select("group", "_band", "_block", "_role", "id", "_set")
    dealt = dealt.repartition("group", "_band", "_block").sortWithinPartitions("group", "_band", "_block", "_role", "id")
    return dealt.mapInArrow(_verify(similarity, most), "a bigint, b bigint")


def _shingle_bytes(words: int):
    @arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for row, stop, w in word_runs(texts, SPACE_ONLY, lower=True):
            out += [shingle_set(w.hash[w.first[i] : w.first[i + 1]], words).tobytes() for i in range(stop - row)]
        return pa.array(out, pa.binary())

    return run


def near_copies(
    documents: DataFrame, words: int = 5, similarity: float = 0.8, lanes: int = 4, radius: int = 58, screen: int = 22
) -> DataFrame:
    """(doc_id, text key, group) of every row; texts link at ``similarity`` or more of their word runs.

    Candidates come from exact comparison of 256-bit fingerprints within
    ``radius``: at similarity 0.8 about 39 bits of 256 differ (deviation 6), and 10
    of the first 64.  What candidates reach is one group; inside a group every pair is
    held against the Jaccard index of the runs themselves, and only links that pass are
    thinned.  Equal texts are one node, named by the least id.
    """
    key = F.xxhash64("text")
    seen = stage(
        documents.select("doc_id", key.alias("_key"), wide_fingerprint(F.col("text"), words, lanes).alias("_w")).select(
            "doc_id", "_key", *(F.col("_w")[k].alias(f"_l{k}") for k in range(lanes)), F.col("_w")[lanes].alias("_size")
        ),
        "wide",
    )
    names = [f"_l{k}" for k in range(lanes)]
    nodes = stage(
        seen.where("doc_id is not null and _size > 0").groupBy("_key", *names, "_size").agg(F.min("doc_id").alias("id")).groupBy("id")
        .agg(F.min_by(F.struct("_key", *names, "_size"), "_key").alias("_s")).select("id", "_s.*"),
        "wide_nodes",
    )
    links = near_links(nodes, names, radius, screen, parts=0, size="_size", ratio=similarity).select("a", "b")
    candidates = connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("group"))
    members = stage(nodes.select("id", "_key", F.col("_size").alias("size")).join(candidates, "id"), "members")
    sets = (
        documents.select(F.col("doc_id").cast("bigint").alias("id"), key.alias("_key"), "text")
        .join(members.select("id", "_key"), ["id", "_key"], "left_semi")
        .dropDuplicates(["id", "_key"]).select("id", _shingle_bytes(words)("text").alias("_set"))
    )
    groups = connected_components(alike_links(members.select("id", "group", "size"), stage(sets, "sets"), similarity))
    named = nodes.select("_key", "id").join(groups, nodes["id"] == groups["node"], "left")
    named = named.select("_key", F.coalesce("component", "id").alias("group"))
    return seen.select("doc_id", "_key").join(named, "_key", "left")


def drop_near_copies(documents: DataFrame, **options) -> DataFrame:
    """One row of each group of near copies: the one with the least doc_id.

    Rows without id, and texts without words, are in no group and all stay.  Of
    rows that repeat id and text one stays.
    """
    groups = near_copies(documents, **options)
    first = groups.where("group is not null and doc_id is not null").groupBy("group").agg(F.min("doc_id").alias("_least"))
    kept = groups.join(first, "group", "left").where("_least is null or doc_id = _least").select("doc_id", "_key").distinct()
    kept = kept.select(F.col("doc_id").alias("_kept_id"), F.col("_key").alias("_kept_key"))
    columns = documents.columns
    marked = documents.select(F.struct("*").alias("_row"), F.xxhash64("text").alias("_key"))
    free = F.col("_row.doc_id").isNull() | F.col("_row.text").isNull() | ~F.col("_row.text").rlike(r"[^\x20\x09-\x0D]")
    grouped = marked.where(~free)
    kept_rows = grouped.join(
        kept, (F.col("_row.doc_id") == F.col("_kept_id")) & (F.col("_key") == F.col("_kept_key")), "left_semi"
    )
    kept_rows = kept_rows.groupBy(F.col("_row.doc_id").alias("_a"), "_key").agg(F.first("_row").alias("_row"))
    rows = kept_rows.select("_row").unionByName(marked.where(free).select("_row"))
    return rows.select(*(F.col("_row")[c].alias(c) for c in columns))
