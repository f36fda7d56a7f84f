"""Statistics of a table that grows by batches, from a kept state that merges.

The state has a row for each batch and sensor: counts, moments of all and of normal
readings, range, and a sketch of the values.  A new batch is read once, to be summed
up.  Means and deviations of all batches come from the state alone.  Medians are exact:
merged sketches bracket them, and one pass over the readings counts what lies below.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch import fixed
from millwatch.operators.quantiles import GATHERED_VALUES, exact_quantiles, merged_sketch, sketch
from millwatch.operators.stats import TrainStats, is_normal, scale_of, statistics_table
from millwatch.sources.published import PublishedTables

_STATE = (
    "feature string, rows bigint, normal_rows bigint, failures double, n bigint, mean double, m2 double, "
    "low double, high double, normal_n bigint, normal_mean double, normal_m2 double, sketch binary"
)


def _moments(value: Column, prefix: str) -> list[Column]:
    count = F.count(value)
    return [
        count.alias(f"{prefix}n"), F.coalesce(F.avg(value), F.lit(0.0)).alias(f"{prefix}mean"),
        F.coalesce(F.var_pop(value) * count, F.lit(0.0)).alias(f"{prefix}m2"),
    ]


def summarise(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """The state of one batch, a row for each sensor, in one pass."""
    wide = rows.agg(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                F.count(F.lit(1)).alias("rows"),
                F.count_if(is_normal()).alias("normal_rows"),
                F.coalesce(F.sum(F.col("failure_label").cast("double")), F.lit(0.0)).alias("failures"),
                *_moments(F.col(name), ""),
                F.min(name).alias("low"),
                F.max(name).alias("high"),
                *_moments(F.when(is_normal(), F.col(name)), "normal_"),
                sketch(F.col(name)).alias("sketch"),
            ).alias(f"s{i}")
            for i, name in enumerate(features)
        ]
    )
    return wide.select(F.inline(F.array(*[f"s{i}" for i in range(len(features))])))


def _filled(n: int, mean: float, m2: float, gaps: int, value: float) -> tuple[float, float]:
    """Mean and population deviation when ``gaps`` further values equal ``value``."""
    total = n + gaps
    if not total:
        return 0.0, 0.0
    centre = mean + (value - mean) * gaps / total
    spread = m2 + (value - mean) ** 2 * n * gaps / total
    return centre, (max(spread, 0.0) / total) ** 0.5


class RunningStatistics:
    """Medians and train statistics of all batches added so far.

    A batch is added once for each key, however often that is tried.
    """

    def __init__(self, spark: SparkSession, root: str, features: Sequence[str]) -> None:
        self.features = tuple(features)
        self.tables = PublishedTables(spark, root, {"state": _STATE})

    def add(self, rows: DataFrame, key: str) -> bool:
        """Sum up a batch of canonical readings; False if its key has been added before."""
        return self.tables.append("state", summarise(rows, self.features).coalesce(1), key)

    def _state(self) -> DataFrame:
        return self.tables.table("state").where(F.col("feature").isin(*self.features))

    def _merged(self) -> dict[str, dict[str, float]]:
        """Counts and moments of all batches: a row for each sensor."""
        state = self._state()
        means = state.groupBy("feature").agg(
            *[(F.sum(F.col(f"{p}mean") * F.col(f"{p}n")) / F.greatest(F.sum(f"{p}n"), F.lit(1))).alias(f"_{p}mean") for p in ("", "normal_")]
        )
        sums = [F.sum(c).alias(c) for c in ("rows", "normal_rows", "failures", "n", "normal_n")]
        spreads = [
            F.sum(F.col(f"{p}m2") + F.col(f"{p}n") * (F.col(f"{p}mean") - F.col(f"_{p}mean")) ** 2).alias(f"{p}m2")
            for p in ("", "normal_")
        ]
        centres = [F.max(f"_{p}mean").alias(f"{p}mean") for p in ("", "normal_")]
        found = state.join(means, "feature").groupBy("feature").agg(
            *sums, *spreads, *centres, F.min("low").alias("low"), F.max("high").alias("high")
        )
        return {row["feature"]: row.asDict() for row in found.collect()}

    def medians(self, rows: DataFrame, gathered_values: int = GATHERED_VALUES) -> dict[str, float]:
        """Exact medians of ``rows``, the readings of all batches; a sensor without values gets 0."""
        sizes = {name: int(found["n"]) for name, found in self._merged().items()}
        kept = self._state().agg(*[merged_sketch(F.when(F.col("feature") == name, F.col("sketch"))).alias(name) for name in self.features])
        found = exact_quantiles(rows, {name: [0.5] for name in self.features}, gathered_values, sizes, kept)
        return {name: 0.0 if values[0] is None else values[0] for name, values in found.items()}

    def stats(self, medians: dict[str, float]) -> TrainStats:
        """What ``fit_train_stats`` gives for all batches with gaps filled; reads the state only."""
        merged = self._merged()
        one = next(iter(merged.values()), None)
        if one is None or not one["rows"]:
            raise ValueError("No batch with rows has been added.")
        rows, normal = int(one["rows"]), int(one["normal_rows"])
        means, stds, minima, maxima, reference = {}, {}, {}, {}, {}
        for name in self.features:
            found, value = merged[name], medians[name]
            gaps = rows - int(found["n"])
            means[name], stds[name] = _filled(found["n"], found["mean"], found["m2"], gaps, value)
            ends = [x for x in (found["low"], found["high"]) if x is not None] + ([value] if gaps else [])
            minima[name], maxima[name] = min(ends), max(ends)
            reference[name] = _filled(
                found["normal_n"], found["normal_mean"], found["normal_m2"], normal - int(found["normal_n"]), value
            )
        if not normal:
            reference = {name: (means[name], stds[name]) for name in self.features}
        return TrainStats(
            features=self.features, rows=rows, normal_rows=normal, failure_share=float(one["failures"]) / rows,
            means=means, stds=stds, scales={name: scale_of(means[name], stds[name], rows) for name in self.features},
            minima=minima, maxima=maxima,
            reference_means={name: pair[0] for name, pair in reference.items()},
            reference_stds={name: max(pair[1], fixed.STD_FLOOR) for name, pair in reference.items()},
        )

    def statistics(self, medians: dict[str, float]) -> DataFrame:
        """Mean, deviation, range and median per sensor over all batches."""
        return statistics_table(self.tables.spark, self.stats(medians), medians)
