"""Reconstruction error of a linear bottleneck (principal components)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch.functions.scalar import clamp_threshold, min_max


@dataclass(frozen=True)
class ReconModel:
    features: tuple[str, ...]  # scaled columns
    means: tuple[float, ...]
    residual: tuple[tuple[float, ...], ...]  # what the bottleneck cannot carry
    low: float = 0.0
    high: float = 1.0
    limit: float = 0.5

    def raw(self) -> Column:
        """Mean squared reconstruction error, as a plain expression."""
        centred = [F.col(f) - F.lit(m) for f, m in zip(self.features, self.means)]
        squares = []
        for weights in self.residual:
            error = sum((F.lit(w) * c for w, c in zip(weights, centred)), F.lit(0.0))
            squares.append(error * error)
        return sum(squares, F.lit(0.0)) / F.lit(float(len(self.features)))

    def score(self, raw: Column) -> Column:
        return min_max(raw, self.low, self.high)

    def predict(self, raw: Column) -> Column:
        return (raw >= F.lit(self.limit)).cast("int")

    @property
    def threshold(self) -> float:
        return clamp_threshold(self.limit)


def moments(df: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population covariances in one aggregate of a single row."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i + 1)]
    row = df.agg(
        *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.covar_pop(features[i], features[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    means = np.array([row[f"m{i}"] for i in range(len(features))])
    covariance = np.zeros((len(features), len(features)))
    for i, j in pairs:
        covariance[i, j] = covariance[j, i] = row[f"c{i}_{j}"]
    return means, covariance


def fit_recon(
    normal: DataFrame, features: Sequence[str], components: int | None = None
) -> ReconModel:
    """Keep half the components, rounded up, and always drop at least one."""
    size = len(features)
    kept = min(components or math.ceil(size / 2), size - 1)
    means, covariance = moments(normal, features)
    _, vectors = np.linalg.eigh(covariance)
    lost = vectors[:, : size - kept]
    residual = lost @ lost.T
    return ReconModel(
        tuple(features), tuple(map(float, means)), tuple(tuple(map(float, r)) for r in residual)
    )
