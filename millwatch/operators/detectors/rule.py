"""Threshold rule on deviations from normal running."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch import fixed
from millwatch.functions.scalar import abs_z, min_max, row_maximum
from millwatch.operators.stats import TrainStats


@dataclass(frozen=True)
class RuleModel:
    features: tuple[str, ...]
    means: dict[str, float]
    stds: dict[str, float]
    sigma: float = fixed.SIGMA
    threshold: float = fixed.SCORE_THRESHOLD

    def excess(self) -> Column:
        """How far the worst sensor of a row lies beyond the sigma limit."""
        beyond = [
            F.greatest(
                abs_z(F.col(name), self.means[name], self.stds[name]) - F.lit(float(self.sigma)),
                F.lit(0.0),
            )
            for name in self.features
        ]
        return row_maximum(beyond)

    def score(self, maximum: float) -> Column:
        return min_max(self.excess(), 0.0, maximum)

    def predict(self, score: Column) -> Column:
        return (score >= F.lit(self.threshold)).cast("int")


def fit_rule(stats: TrainStats, sigma: float = fixed.SIGMA) -> RuleModel:
    """The rule needs only the reference statistics: no further pass."""
    return RuleModel(stats.features, stats.reference_means, stats.reference_stds, sigma)


def batch_maxima(df: DataFrame, models: Mapping[str, RuleModel]) -> dict[str, float]:
    """Largest excess of the batch per rule, at least 1: the unit of its score."""
    row = df.agg(*[F.max(model.excess()).alias(name) for name, model in models.items()]).first()
    return {name: max(float(row[name] or 0.0), 1.0) for name in models}


def score_rules(
    df: DataFrame,
    models: Mapping[str, RuleModel],
    maxima: Mapping[str, float] | None = None,
) -> DataFrame:
    """Add ``<name>_raw`` (unrounded score) and ``<name>_prediction`` per rule.

    Scores are relative to the batch being scored, which takes one pass for all
    rules, unless fixed maxima are given, which makes them row-local.
    """
    units = batch_maxima(df, models) if maxima is None else maxima
    raw = df.withColumns({f"{n}_raw": m.score(units[n]) for n, m in models.items()})
    return raw.withColumns(
        {f"{n}_prediction": m.predict(F.col(f"{n}_raw")) for n, m in models.items()}
    )
