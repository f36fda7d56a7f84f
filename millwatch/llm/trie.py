"""Prefix trie of conversations: union-find over the common prefixes of sorted neighbours.

A conversation is a path of turn hashes.  Paths are sorted over the cluster; in sorted
order the members of a node are neighbours, and two neighbours part at the length of
their longest common prefix.  Inside a chunk of rows these lengths are edges, taken in
descending order: an edge unites two components, and the united component is a
branching node at the depth of the edge.  The nodes between a component and its parent
have the same members, so they follow from the two depths.

Nodes that the first or last path of a chunk may share with a neighbouring chunk stay
open: they are handed on as partial sums, named by a hash of their prefix, and merged.
All sums over subtrees are sums over members (the words a member adds to its
predecessor in sorted order), so merging needs no walk through the tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwatch.session import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Ids in one piece of the list of members that end at an open node.
PIECE = 512
_TOKEN = 16
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_FOUND = (
    "kind int, pid int, chunk bigint, piece bigint, key binary, parent_key binary, conv_id bigint, depth bigint, "
    "parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, turn binary, "
    "words bigint, before bigint, fresh bigint, at_start boolean, at_end boolean, "
    "first_path binary, last_path binary, first_words array<bigint>"
)
_NODE, _OPEN, _EDGE, _ENDS = range(4)


def turn_key(role: Column, text: Column) -> Column:
    """128-bit name of a turn; null role or text is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def turn_paths(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns, (key, words) in the order of ``turn``, null first; equal turns by their keys.

    Rows without conv_id belong to no conversation and are left out.  A conversation
    is one row of 20 bytes a turn; its texts stay where they are.
    """
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("int")
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct("turn", turn_key(F.col("role"), F.col("text")).alias("key"), words.alias("words")).alias("_turn"),
    )
    return rows.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list("_turn")), lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns")
    )


def with_shared_openings(paths: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Every conversation with its first h turns taken from the first of its family, h a checksum of its id.

    The first of the family is conv_id - conv_id % family; where it is missing or
    shorter, there are fewer such turns.
    """
    paths = stage(paths, "paths")
    base = F.col("conv_id") - F.col("conv_id") % family
    heads = paths.where(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("_base"), F.slice("turns", 1, most - 1).alias("_head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    opening = F.coalesce(F.slice("_head", F.lit(1), h), F.slice("turns", 1, 0))
    return paths.join(heads, base == F.col("_base"), "left").select("conv_id", F.concat(opening, own).alias("turns"))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Turns that two paths (rows of two words) share at their start."""
    n = min(len(a), len(b))
    apart = np.flatnonzero((a[:n] != b[:n]).any(1))
    return int(apart[0]) if len(apart) else n


def _neighbour_prefixes(tokens: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the row before it."""
    least = np.minimum(size[1:], size[:-1])
    shared = np.zeros(len(least), np.int64)
    alive = np.flatnonzero(least > 0)
    while len(alive):
        depth = shared[alive[0]]
        same = (tokens[start[alive] + depth] == tokens[start[alive + 1] + depth]).all(1)
        alive = alive[same]
        shared[alive] += 1
        alive = alive[shared[alive] < least[alive]]
    return shared


class Forest:
    """Branching nodes of sorted rows by union-find over their edges in descending depth.

    A node has a depth, its rows [left, right], its number of children and its parent
    (-1 for the root).  A row starts as a node of its own at its full length; nodes
    that turn out to be equal are united.
    """

    def __init__(self, shared: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        n = len(size)
        self.depth, self.left, self.right = size.tolist(), list(range(n)), list(range(n))
        self.children, self.parent, self.least = [0] * n, [-1] * n, ids.tolist()
        self.alive = [True] * n
        leader, top = list(range(n)), list(range(n))

        def find(x: int) -> int:
            while leader[x] != x:
                leader[x] = leader[leader[x]]
                x = leader[x]
            return x

        depths = shared.tolist()
        for edge in np.argsort(-shared, kind="stable").tolist():
            a, b = find(edge), find(edge + 1)
            leader[b] = a
            top[a] = self._unite(top[a], top[b], depths[edge])
        self.root = top[find(0)]
        if self.depth[self.root] > 0:
            self.root = self._add(0, 0, n - 1, 1, self.least[self.root], self.root)

    def _add(self, depth: int, left: int, right: int, children: int, least: int, *below: int) -> int:
        node = len(self.depth)
        for values, value in (
            (self.depth, depth), (self.left, left), (self.right, right), (self.children, children),
            (self.parent, -1), (self.least, least), (self.alive, True),
        ):
            values.append(value)
        for child in below:
            self.parent[child] = node
        return node

    def _unite(self, a: int, b: int, depth: int) -> int:
        """The node at ``depth`` over two neighbouring components whose tops are ``a`` and ``b``."""
        right, least = self.right[b], min(self.least[a], self.least[b])
        at_a, at_b = self.depth[a] == depth, self.depth[b] == depth
        if not at_a and not at_b:
            return self._add(depth, self.left[a], right, 2, least, a, b)
        if at_a and at_b:
            self.children[a] += self.children[b]
            self.alive[b] = False
            # children of b are told by the forward link
            self.parent[b] = a
            node = a
        elif at_a:
            self.children[a] += 1
            self.parent[b], node = a, a
        else:
            self.children[b] += 1
            self.parent[a], node = b, b
        self.left[node], self.right[node], self.least[node] = self.left[a], right, least
        return node

    def arrays(self) -> dict[str, np.ndarray]:
        parent = np.array(self.parent, np.int64)
        alive = np.array(self.alive)
        # a parent that was united with another node is that node
        while True:
            gone = (parent >= 0) & ~alive[np.maximum(parent, 0)]
            if not gone.any():
                break
            parent[gone] = parent[parent[gone]]
        names = ("depth", "left", "right", "children", "least")
        return {name: np.array(getattr(self, name), np.int64) for name in names} | {"parent": parent, "alive": alive}


class _Chunk:
    """Sorted rows of one batch."""

    def __init__(self, number: int, batch: pa.RecordBatch) -> None:
        path, words = batch.column(1), batch.column(2)
        self.number = number
        self.ids = np.asarray(batch.column(0)).astype(np.int64)
        bounds = np.frombuffer(path.buffers()[1], np.int32)[path.offset : path.offset + len(path) + 1].astype(np.int64)
        data = path.buffers()[2]
        self.bytes = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[bounds[0] : bounds[-1]].copy()
        self.tokens = self.bytes.view(np.uint64).reshape(-1, 2)
        self.start = (bounds[:-1] - bounds[0]) // _TOKEN
        self.size = np.diff(bounds) // _TOKEN
        self.sums = np.concatenate(([0], np.cumsum(np.asarray(words.flatten()).astype(np.int64))))
        self.shared = _neighbour_prefixes(self.tokens, self.start, self.size)

    def path(self, row: int) -> np.ndarray:
        return self.tokens[self.start[row] : self.start[row] + self.size[row]]

    def prefix_words(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return self.sums[self.start[row] + depth] - self.sums[self.start[row]]

    def keys(self, row: int, depth: int) -> list[bytes]:
        """Names of the prefixes of a row up to a depth."""
        whole, found = hashlib.md5(), []
        raw = self.bytes[self.start[row] * _TOKEN : (self.start[row] + depth) * _TOKEN].tobytes()
        found.append(whole.digest())
        for d in range(depth):
            whole.update(raw[d * _TOKEN : (d + 1) * _TOKEN])
            found.append(whole.digest())
        return found

    def nodes(self, pid: int, before: int | None, after: int | None) -> Iterator[dict[str, list]]:
        """Rows of the result; ``before`` and ``after`` are the turns shared with the neighbouring rows.

        None where the neighbour is in another task: then no member is taken to be
        shared, and the rows say that they stand at the edge.
        """
        n = len(self.ids)
        rows = np.arange(n)
        tree = Forest(self.shared, self.size, self.ids).arrays()
        index = np.flatnonzero(tree["alive"])
        up = tree["parent"][index]
        floor = np.where(up >= 0, tree["depth"][np.maximum(up, 0)], -1)
        times = tree["depth"][index] - floor
        node = np.repeat(index, times)
        depth = np.arange(len(node)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(floor, times) + 1
        left, right = tree["left"][node], tree["right"][node]
        own = depth == tree["depth"][node]

        # per row: all its words, those that are not in the row before, whether it ends a path
        size, whole = self.size, self.prefix_words(rows, self.size)
        fresh = np.concatenate(([0], (whole - self.prefix_words(rows, np.concatenate(([0], self.shared))))[1:]))
        following = np.concatenate((self.shared, [-1 if after is None else after]))
        leaves = np.concatenate(([0], np.cumsum(following < size)))
        sums, added = np.concatenate(([0], np.cumsum(whole))), np.concatenate(([0], np.cumsum(fresh)))
        above = np.maximum(depth - 1, 0)
        earlier = self.prefix_words(left, above)
        known = -1 if before is None else before
        handed = (left == 0) & (known >= depth)
        known_words = self.sums[self.start[0] + max(known, 0)] - self.sums[self.start[0]]
        words = sums[right + 1] - sums[left]
        new = added[right + 1] - added[left + 1] + whole[left] - np.where(handed, known_words, earlier)
        children = np.where(own, tree["children"][node], 1) - ((left == 0) & (known > depth))
        members = right - left + 1

        def is_open(left: np.ndarray, right: np.ndarray, depth: np.ndarray) -> np.ndarray:
            at_first = (left == 0) & (True if before is None else depth <= before)
            at_last = (right == n - 1) & (True if after is None else depth <= after)
            return at_first | at_last

        open_ = is_open(left, right, depth)
        # the parent is one turn up on the same node, or the node's parent
        same = depth - 1 > np.repeat(floor, times)
        over = np.maximum(np.where(same, node, np.repeat(up, times)), 0)
        parent_open = is_open(tree["left"][over], tree["right"][over], depth - 1)
        keys = {
            end: self.keys(row, int(size[row] if limit is None else min(limit, size[row])))
            for end, row, limit in (("first", 0, before), ("last", n - 1, after))
        }

        def key(left: int, right: int, depth: int) -> bytes:
            at_first = left == 0 and depth < len(keys["first"])
            return keys["first"][depth] if at_first else keys["last"][depth]

        same_next = np.flatnonzero(np.concatenate((self.shared < np.maximum(size[1:], size[:-1]), [True])))
        run_end = same_next[np.searchsorted(same_next, rows)]  # last of the rows equal to each row
        least, turn_at = tree["least"], self.start[left] + depth - 1
        ids = self.ids.astype(str)
        out = {name: [] for name in _NAMES}
        pieces = []
        for i in range(len(node)):
            d, l, r = int(depth[i]), int(left[i]), int(right[i])
            ends = ids[l : run_end[l] + 1] if size[l] == d else ids[:0]
            turn = self.bytes[turn_at[i] * _TOKEN : (turn_at[i] + 1) * _TOKEN].tobytes() if d else None
            row = {
                "pid": pid, "chunk": self.number, "conv_id": int(least[node[i]]), "depth": d, "n_convs": int(members[i]),
                "n_children": int(children[i]), "n_leaves": int(leaves[r + 1] - leaves[l]), "turn": turn,
            }
            if d and parent_open[i]:
                row["parent_key"] = key(int(tree["left"][over[i]]), int(tree["right"][over[i]]), d - 1)
            if open_[i]:
                row |= {
                    "kind": _OPEN, "key": key(l, r, d), "words": int(words[i]), "before": int(earlier[i]), "fresh": int(new[i]),
                    "at_start": before is None and l == 0, "at_end": after is None and r == n - 1,
                }
                for piece in range(0, len(ends), PIECE):
                    pieces.append((row["key"], piece, ",".join(ends[piece : piece + PIECE])))
            else:
                row |= {
                    "kind": _NODE, "saved_tokens": int(words[i] - members[i] * earlier[i] - new[i]),
                    "ends": hashlib.sha256(",".join(ends).encode()).hexdigest() if len(ends) else _NO_ENDS,
                }
                if not parent_open[i]:
                    row["parent_conv_id"] = int(least[over[i]])
            for name, values in out.items():
                values.append(row.get(name))
        yield out
        for place in range(0, len(pieces), 1024):
            some = pieces[place : place + 1024]
            k = len(some)
            yield {
                **{name: [None] * k for name in _NAMES}, "kind": [_ENDS] * k, "pid": [pid] * k, "chunk": [self.number] * k,
                "key": [s[0] for s in some], "piece": [s[1] for s in some], "ends": [s[2] for s in some],
            }


def _schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    kinds["array<bigint>"] = pa.list_(pa.int64())
    return pa.schema([(n, kinds[t]) for n, t in (field.split() for field in _FOUND.split(", "))])


_SCHEMA = _schema()
_NAMES = _SCHEMA.names


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each chunk of a task's sorted rows, and the task's first and last path."""
    pid, number = TaskContext.get().partitionId(), 0
    held: _Chunk | None = None
    before: int | None = None
    first = None

    def rows(values: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(values, schema=_SCHEMA)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        chunk = _Chunk(number, batch)
        number += 1
        if held is None:
            first = chunk.path(0).tobytes(), np.cumsum(np.diff(chunk.sums[: chunk.size[0] + 1])).tolist()
        else:
            between = _common(held.path(-1), chunk.path(0))
            yield from map(rows, held.nodes(pid, before, between))
            before = between
        held = chunk
    if held is not None:
        yield from map(rows, held.nodes(pid, before, None))
        edge = {name: [None] for name in _NAMES} | {
            "kind": [_EDGE], "pid": [pid], "first_path": [first[0]], "first_words": [first[1]], "last_path": [held.path(-1).tobytes()],
        }
        yield rows(edge)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each task's first and last path share with their neighbours in other tasks."""
    for batch in batches:
        found = {"_pid": [], "_before": [], "_before_words": [], "_after": [], "_last": []}
        for row in batch.to_pylist():
            first, last = (np.frombuffer(row[c], np.uint64).reshape(-1, 2) for c in ("first_path", "last_path"))
            previous, following = (
                None if row[c] is None else np.frombuffer(row[c], np.uint64).reshape(-1, 2) for c in ("_previous", "_following")
            )
            before = -1 if previous is None else _common(previous, first)
            found["_pid"].append(row["pid"])
            found["_before"].append(before)
            found["_before_words"].append(row["first_words"][before - 1] if before > 0 else 0)
            found["_after"].append(-1 if following is None else _common(last, following))
            found["_last"].append(len(last))
        yield pa.RecordBatch.from_pydict(
            found, pa.schema([("_pid", pa.int32())] + [(n, pa.int64()) for n in ("_before", "_before_words", "_after", "_last")])
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each key, which come in order; a key may run over many batches."""
    key, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"_key": [key], "_ends": [digest.hexdigest()]}, pa.schema([("_key", pa.binary()), ("_ends", pa.string())]))

    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name == key:
                digest.update(b"," + text.encode())
                continue
            if key is not None:
                yield done()
            key, digest = name, hashlib.sha256(text.encode())
    if key is not None:
        yield done()


def prefix_trie(paths: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the paths (conv_id, turns of (key, words)), the empty one included.

    conv_id is the smallest member, parent_conv_id that of the parent (null for the
    root), ``turn`` the key of the last turn (see ``turn_key``; null for the root),
    n_convs the members, n_children and n_leaves the children and the childless nodes
    of the subtree, saved_tokens the words that the subtree's nodes hold once instead
    of once for each member, ends_sha256 a digest of the members that end here.
    conv_id must be unique; a conversation without turns is a member of the root only.
    An empty table gives no rows, not even a root.

    Conversations that are alike are neighbours in sorted order, split over tasks by
    their ids like any others; of an open node one partial row for each chunk is merged.
    The table of task edges has a row for each task.
    """
    turns = F.col("turns")
    flat = paths.select(
        "conv_id",
        F.unhex(F.array_join(F.transform(turns, lambda t: F.hex(t["key"])), "")).alias("path"),
        F.transform(turns, lambda t: t["words"]).alias("words"),
    )
    ordered = flat.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    found = stage(ordered.mapInArrow(_chunks, _FOUND), "trie")

    by_task = Window.orderBy("pid")
    edges = stage(
        found.where(F.col("kind") == _EDGE)
        .select(
            "pid", "first_path", "last_path", "first_words",
            F.lag("last_path").over(by_task).alias("_previous"), F.lead("first_path").over(by_task).alias("_following"),
        )
        .mapInArrow(_edges, "_pid int, _before bigint, _before_words bigint, _after bigint, _last bigint"),
        "edges",
    )
    # what the neighbouring task holds already is taken off the rows at the edges of a task
    partial = found.where(F.col("kind") == _OPEN).join(edges, F.col("pid") == F.col("_pid"))
    depth, zero = F.col("depth"), F.lit(0)
    handed = F.col("at_start") & (F.col("_before") >= depth)
    corrected = partial.withColumns(
        {
            "fresh": F.col("fresh") - F.when(handed, F.col("_before_words") - F.col("before")).otherwise(zero),
            "n_children": F.col("n_children") - F.when(F.col("at_start") & (F.col("_before") > depth), 1).otherwise(zero),
            "n_leaves": F.col("n_leaves") - F.when(F.col("at_end") & (F.col("_after") >= F.col("_last")), 1).otherwise(zero),
        }
    )
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "words", "fresh")]
    ends = [F.max(c).alias(c) for c in ("depth", "parent_key", "turn", "before")]
    merged = stage(corrected.groupBy("key").agg(F.min("conv_id").alias("conv_id"), *sums, *ends), "open")
    digests = (
        found.where(F.col("kind") == _ENDS)
        .repartition("key")
        .sortWithinPartitions("key", "pid", "chunk", "piece")
        .select("key", "ends")
        .mapInArrow(_digests, "_key binary, _ends string")
    )
    parents = merged.select(F.col("key").alias("_parent"), F.col("conv_id").alias("_parent_conv"))
    saved = F.col("words") - F.col("n_convs") * F.col("before") - F.col("fresh")
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn")
    shared = (
        merged.join(parents, F.col("parent_key") == F.col("_parent"), "left")
        .join(digests, F.col("key") == F.col("_key"), "left")
        .withColumns(
            {
                "parent_conv_id": F.col("_parent_conv"), "saved_tokens": saved,
                "ends_sha256": F.coalesce("_ends", F.lit(_NO_ENDS)),
            }
        )
        .select(*columns)
    )
    closed = found.where(F.col("kind") == _NODE).withColumn("ends_sha256", F.col("ends"))
    inside = closed.where("parent_key is null").select(*columns)
    # an open parent's smallest member is known after merging; each chunk looks it up in its own rows of it
    of_chunk = (
        found.where(F.col("kind") == _OPEN)
        .select(F.col("pid").alias("_pid"), F.col("chunk").alias("_chunk"), F.col("key").alias("_open"))
        .join(parents, F.col("_open") == F.col("_parent"))
    )
    below = (
        closed.where("parent_key is not null")
        .join(
            of_chunk,
            (F.col("pid") == F.col("_pid")) & (F.col("chunk") == F.col("_chunk")) & (F.col("parent_key") == F.col("_open")),
        )
        .withColumn("parent_conv_id", F.col("_parent_conv"))
        .select(*columns)
    )
    return shared.unionByName(inside).unionByName(below)
