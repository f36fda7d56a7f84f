"""Isolation forest (Liu, Ting and Zhou, 2008) grown and applied by Spark.

Spark draws each tree's rows and shuffles them to the tree's group; a group
holds one sub-sample (256 rows), so growing a tree is a small task.  The grown
trees are a table of at most 200 x 511 nodes, small enough for every worker.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millwatch import fixed
from millwatch.functions.scalar import clamp_threshold, min_max

NODE_SCHEMA = "tree int, node int, feature int, cut double, path double, rows int"


def average_path(rows: float) -> float:
    """Mean depth of an unsuccessful search among that many rows."""
    if rows <= 1:
        return 0.0
    if rows == 2:
        return 1.0
    return 2.0 * (math.log(rows - 1.0) + np.euler_gamma) - 2.0 * (rows - 1.0) / rows


def tree_depth(sample: int) -> int:
    return math.ceil(math.log2(max(sample, 2)))


def _unit(*columns: Column | str) -> Column:
    """A repeatable number in [0, 1) from a row's id: the same in any layout."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def _candidates(sample: int) -> float:
    """Mean number of candidates of a tree: fewer than ``sample`` come with a chance below 1e-14."""
    return sample + 8.0 * math.sqrt(sample) + 64.0


def draw_samples(
    df: DataFrame, features: Sequence[str], rows: int, trees: int, sample: int, seed: int
) -> DataFrame:
    """``sample`` rows for every tree, drawn from all rows by hashing row ids.

    Every pair of row and tree is a candidate with the same chance, independent of
    all others.  One number of the row decides its first tree, as the wait for a
    first success does; most rows of a large table have none and go at once, only
    the rest are tried on the trees that follow.  A tree keeps the candidates
    with the smallest numbers.
    """
    chance = _candidates(sample) / max(rows, 1)
    numbers = F.sequence(F.lit(0), F.lit(trees - 1))
    offered = df.select("sample_id", *features)
    if chance < 1.0:
        wait = F.log1p(-_unit("sample_id", F.lit(seed))) / F.lit(math.log1p(-chance))
        offered = offered.withColumn("first", F.floor(wait)).where(F.col("first") < trees)

        def joins(tree: Column) -> Column:
            later = (tree > F.col("first")) & (_unit("sample_id", F.lit(seed + 1), tree) < chance)
            return (tree == F.col("first")) | later

        numbers = F.filter(numbers, joins)
    smallest = Window.partitionBy("tree").orderBy("draw", "sample_id")
    return (
        offered.select("sample_id", *features, F.explode(numbers).alias("tree"))
        .withColumn("draw", _unit("sample_id", F.lit(seed + 2), F.col("tree")))
        .withColumn("place", F.row_number().over(smallest))
        .where(F.col("place") <= sample)
    )


def _grow(values: np.ndarray, rng: np.random.Generator, depth: int) -> list[tuple]:
    """Nodes of one tree as (node, feature, cut, path, rows); children of i: 2i+1, 2i+2."""
    nodes = []
    pending = [(0, 0, values)]
    while pending:
        node, level, part = pending.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        varied = np.flatnonzero(high > low)
        if level == depth or len(part) < 2 or not len(varied):
            nodes.append((node, -1, math.nan, level + average_path(len(part)), len(part)))
            continue
        feature = int(rng.choice(varied))
        cut = float(rng.uniform(low[feature], high[feature]))
        right = part[:, feature] > cut
        nodes.append((node, feature, cut, math.nan, len(part)))
        pending.append((2 * node + 2, level + 1, part[right]))
        pending.append((2 * node + 1, level + 1, part[~right]))
    return nodes


def grow_trees(
    samples: DataFrame, features: Sequence[str], depth: int, seed: int
) -> DataFrame:
    """Node table of all trees; one group per tree."""
    columns = list(features)

    def one_tree(drawn: pd.DataFrame) -> pd.DataFrame:
        drawn = drawn.sort_values("place")
        tree = int(drawn["tree"].iloc[0])
        nodes = _grow(
            drawn[columns].to_numpy(dtype=float), np.random.default_rng([seed, tree]), depth
        )
        table = pd.DataFrame(nodes, columns=["node", "feature", "cut", "path", "rows"])
        table.insert(0, "tree", tree)
        return table

    return (
        samples.select("tree", "place", *columns).groupBy("tree").applyInPandas(one_tree, NODE_SCHEMA)
    )


#: Most boxes of one tree's lookup table; a tree cut into more is walked down node by node.
_BOXES = 1 << 17


def _boxes(feature: np.ndarray, cut: np.ndarray, path: np.ndarray, cuts: Sequence[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray] | None:
    """One tree as a table: path lengths by how many of its cuts lie below each sensor's value.

    A sensor's value is known by the number of cuts of the whole forest below it; the
    first arrays lead from there to the place of the tree's own box, the last holds what
    the box's leaf holds.  Nothing if the tree has too many boxes.
    """
    inner = np.isfinite(cut)
    own = [np.unique(cut[inner & (feature == i)]) for i in range(len(cuts))]
    shape = [len(values) + 1 for values in own]
    if math.prod(shape) > _BOXES:
        return None
    table = np.empty(shape)
    pending = [(0, [(0, size) for size in shape])]
    while pending:
        node, box = pending.pop()
        if node < len(cut) and inner[node]:
            i, (low, high) = feature[node], box[feature[node]]
            at = int(np.searchsorted(own[i], cut[node])) + 1
            pending.append((2 * node + 1, [*box[:i], (low, min(high, at)), *box[i + 1 :]]))
            pending.append((2 * node + 2, [*box[:i], (max(low, at), high), *box[i + 1 :]]))
            continue
        while node < len(cut):
            node = 2 * node + 1
        table[tuple(slice(*ends) for ends in box)] = path[node - len(cut)]
    places = []
    for i, values in enumerate(own):
        steps = np.zeros(len(cuts[i]) + 1, np.int32)
        steps[np.searchsorted(cuts[i], values) + 1] = math.prod(shape[i + 1 :])
        places.append(np.cumsum(steps, dtype=np.int32))
    return places, table.ravel()


def _path_sums(features: np.ndarray, cuts: np.ndarray, paths: np.ndarray, size: int) -> Callable[[Sequence[np.ndarray]], np.ndarray]:
    """Sums of path lengths over all trees, for values of ``size`` sensors."""
    used = [np.unique(cuts[(features == i) & np.isfinite(cuts)]) for i in range(size)]
    trees = [_boxes(*tree, used) for tree in zip(features, cuts, paths)]
    width = paths.shape[1]

    def walk(table: np.ndarray, f: np.ndarray, c: np.ndarray, p: np.ndarray) -> np.ndarray:
        start = np.arange(len(table) // size) * size
        place = np.zeros(len(start), dtype=np.intp)
        for _ in range(width.bit_length() - 1):
            place = 2 * place + 1 + (table[start + f[place]] > c[place])
        return p[place - (width - 1)]

    def sums(values: Sequence[np.ndarray]) -> np.ndarray:
        total = np.zeros(len(values[0]))
        # a value that is no number lies above no cut
        below = [np.where(np.isnan(column), 0, np.searchsorted(used[i], column)) for i, column in enumerate(values)]
        flat = None if None not in trees else np.column_stack(values).ravel()
        for tree, f, c, p in zip(trees, features, cuts, paths):
            if tree is None:
                total += walk(flat, f, c, p)
                continue
            places, table = tree
            place = places[0][below[0]]
            for steps, ranks in zip(places[1:], below[1:]):
                place += steps[ranks]
            total += table[place]
        return total

    return sums


@dataclass(frozen=True)
class ForestModel:
    features: tuple[str, ...]  # scaled columns
    nodes: pd.DataFrame
    sample: int
    contamination: float
    low: float = 0.0
    high: float = 1.0
    limit: float = 0.5  # raw score from which a row is flagged
    offset: float = 0.0  # raw score that counts as zero in the reported threshold

    def raw(self, spark: SparkSession) -> Column:
        """Raw score 2^(-mean depth / expected depth) of the scaled columns."""
        depth = tree_depth(self.sample)
        width, trees = 2**depth, int(self.nodes["tree"].max()) + 1
        feature = np.zeros((trees, width - 1), dtype=np.intp)
        cut = np.full((trees, width - 1), np.inf)
        path = np.zeros((trees, width))
        for tree, node, index, value, length, _ in self.nodes.itertuples(index=False):
            if index >= 0:
                feature[tree, node], cut[tree, node] = index, value
                continue
            # A leaf above the bottom is reached through its leftmost path.
            while node < width - 1:
                node = 2 * node + 1
            path[tree, node - (width - 1)] = length
        shared = spark.sparkContext.broadcast((feature, cut, path))
        expected = average_path(self.sample) or 1.0

        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            sums = None
            for batch in batches:
                if sums is None:
                    sums = _path_sums(*shared.value, len(batch))
                total = sums([s.to_numpy(dtype=float) for s in batch])
                yield pd.Series(np.exp2(-total / trees / expected))

        # The iterator form is recognised by its type hints.
        score.__annotations__ = {
            "batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series],
        }
        return F.pandas_udf(score, "double")(*self.features)

    def score(self, raw: Column) -> Column:
        return min_max(raw, self.low, self.high)

    def predict(self, raw: Column) -> Column:
        return (raw >= F.lit(self.limit)).cast("int")

    @property
    def threshold(self) -> float:
        """Flagging limit above the outlier offset, clamped to [0, 1]."""
        return clamp_threshold(self.limit - self.offset)

    @property
    def quantiles(self) -> tuple[float, float]:
        """Shares of the train scores at the flagging limit and the offset."""
        limit = min(fixed.FOREST_QUANTILE_CAP, 1.0 - self.contamination / 2)
        return limit, 1.0 - self.contamination


def grow_forest(
    normal: DataFrame,
    features: Sequence[str],
    rows: int,
    contamination: float,
    trees: int = fixed.FOREST_TREES,
    sample: int = fixed.FOREST_SAMPLE,
    seed: int = fixed.SEED,
) -> ForestModel:
    """Grow the trees on normal scaled rows; calibration follows separately."""
    sample = min(sample, rows)

    drawn = draw_samples(normal, features, rows, trees, sample, seed)
    nodes = grow_trees(drawn, features, tree_depth(sample), seed).toPandas()
    return ForestModel(tuple(features), nodes.sort_values(["tree", "node"]), sample, contamination)
