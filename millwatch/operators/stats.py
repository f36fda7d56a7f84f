"""Fitted statistics: all from the train split, all population based."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch import fixed
from millwatch.operators.quantiles import GATHERED_VALUES, exact_quantiles

SCALED = "{}__scaled"


@dataclass(frozen=True)
class TrainStats:
    """What one pass over the imputed train split yields."""

    features: tuple[str, ...]
    rows: int
    normal_rows: int
    failure_share: float
    means: dict[str, float]
    stds: dict[str, float]
    scales: dict[str, float]
    minima: dict[str, float]
    maxima: dict[str, float]
    reference_means: dict[str, float]
    reference_stds: dict[str, float]

    @property
    def contamination(self) -> float:
        """Share of outliers to expect, from the label rate."""
        if self.normal_rows == 0:
            return fixed.DEFAULT_CONTAMINATION
        low, high = fixed.CONTAMINATION_BOUNDS
        return min(max(self.failure_share * fixed.CONTAMINATION_FACTOR, low), high)

    @property
    def classes(self) -> int:
        return (self.normal_rows > 0) + (self.normal_rows < self.rows)


def train_medians(
    train: DataFrame,
    features: Sequence[str],
    gathered_values: int = GATHERED_VALUES,
    known_sizes: Mapping[str, int] | None = None,
) -> dict[str, float]:
    """Exact median per sensor; a sensor without any value gets 0."""
    wanted = {name: [0.5] for name in features}
    found = exact_quantiles(train, wanted, gathered_values, known_sizes)
    return {name: 0.0 if values[0] is None else values[0] for name, values in found.items()}


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns(
        {name: F.coalesce(F.col(name), F.lit(value)) for name, value in medians.items()}
    )


def is_normal() -> Column:
    return F.col("failure_label") == 0


def normal_rows(df: DataFrame, stats: TrainStats) -> DataFrame:
    """Rows without failure, or all rows when every train row failed."""
    return df.where(is_normal()) if stats.normal_rows else df


def scale_of(mean: float, std: float, rows: int) -> float:
    """Divisor of the scaler: 1 where the spread is rounding noise."""
    noise = rows * sys.float_info.epsilon
    return 1.0 if std**2 <= noise * std**2 + (noise * mean) ** 2 else std


def fit_train_stats(train: DataFrame, features: Sequence[str]) -> TrainStats:
    """One aggregate over the train split; its result is a single row."""
    wanted = [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(is_normal()).alias("normal"),
        F.avg("failure_label").alias("share"),
    ]
    for i, name in enumerate(features):
        value, normal = F.col(name), F.when(is_normal(), F.col(name))
        wanted += [
            F.avg(value).alias(f"mean{i}"),
            F.stddev_pop(value).alias(f"std{i}"),
            F.min(value).alias(f"min{i}"),
            F.max(value).alias(f"max{i}"),
            F.avg(normal).alias(f"nmean{i}"),
            F.stddev_pop(normal).alias(f"nstd{i}"),
        ]
    row = train.agg(*wanted).first()
    if not row["rows"]:
        raise ValueError("The train split has no rows; more readings are needed.")

    def each(prefix: str) -> dict[str, float]:
        return {name: row[f"{prefix}{i}"] for i, name in enumerate(features)}

    means, stds = each("mean"), each("std")
    reference = ("nmean", "nstd") if row["normal"] else ("mean", "std")
    return TrainStats(
        features=tuple(features),
        rows=row["rows"],
        normal_rows=row["normal"],
        failure_share=float(row["share"]),
        means=means,
        stds=stds,
        scales={name: scale_of(means[name], stds[name], row["rows"]) for name in features},
        minima=each("min"),
        maxima=each("max"),
        reference_means=each(reference[0]),
        reference_stds={
            name: max(std, fixed.STD_FLOOR) for name, std in each(reference[1]).items()
        },
    )


def scale(df: DataFrame, stats: TrainStats) -> DataFrame:
    """Add ``<sensor>__scaled`` columns; the statistics enter as constants."""
    return df.withColumns(
        {
            SCALED.format(name): (F.col(name) - F.lit(stats.means[name])) / F.lit(stats.scales[name])
            for name in stats.features
        }
    )


def feature_statistics(
    train: DataFrame, features: Sequence[str], medians: dict[str, float]
) -> DataFrame:
    """Mean, deviation, range and median per sensor, a row per sensor.

    The median of the imputed column is the imputation median itself, since
    filling gaps with the median cannot move it.
    """
    wide = train.agg(
        *[
            F.struct(
                F.lit(name).alias("feature_name"),
                F.avg(name).alias("mean"),
                F.stddev_pop(name).alias("std"),
                F.min(name).alias("min"),
                F.max(name).alias("max"),
                F.lit(float(medians[name])).alias("median"),
            ).alias(name)
            for name in features
        ]
    )
    return wide.select(F.inline(F.array(*features)))


def reference_table(stats: TrainStats) -> list[tuple[str, float, float]]:
    return [
        (name, float(stats.reference_means[name]), float(stats.reference_stds[name]))
        for name in stats.features
    ]


def statistics_table(spark: SparkSession, stats: TrainStats, medians: Mapping[str, float]) -> DataFrame:
    """The rows of ``feature_statistics`` from values that were fitted before."""
    rows = [
        (n, float(stats.means[n]), float(stats.stds[n]), float(stats.minima[n]), float(stats.maxima[n]), float(medians[n]))
        for n in stats.features
    ]
    return spark.createDataFrame(
        rows, "feature_name string, mean double, std double, min double, max double, median double"
    )
