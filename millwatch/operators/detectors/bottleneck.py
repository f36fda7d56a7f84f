"""Reconstruction error of a non-linear bottleneck network, trained on all normal rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch import fixed
from millwatch.functions.scalar import clamp_threshold, min_max
from millwatch.operators.detectors.gradient import train
from millwatch.operators.detectors.networks import bottleneck_kernel, bottleneck_shapes, draw, redraw_errors


@dataclass(frozen=True)
class BottleneckModel:
    """Takes the place of ``ReconModel``; ``parameters`` are a few hundred numbers."""

    features: tuple[str, ...]  # scaled columns
    hidden: int
    neck: int
    parameters: tuple[float, ...]
    low: float = 0.0
    high: float = 1.0
    limit: float = 0.5

    def raw(self) -> Column:
        """Mean squared reconstruction error, in Arrow batches."""
        parameters = np.array(self.parameters)
        shapes = bottleneck_shapes(len(self.features), self.hidden, self.neck)

        def errors(*columns: pd.Series) -> pd.Series:
            return pd.Series(redraw_errors(parameters, shapes, np.column_stack(columns).astype(float)))

        # the form is recognised by its type hints
        errors.__annotations__ = {"columns": pd.Series, "return": pd.Series}
        return F.pandas_udf(errors, "double")(*self.features)

    def score(self, raw: Column) -> Column:
        return min_max(raw, self.low, self.high)

    def predict(self, raw: Column) -> Column:
        return (raw >= F.lit(self.limit)).cast("int")

    @property
    def threshold(self) -> float:
        return clamp_threshold(self.limit)


def fit_bottleneck(
    normal: DataFrame,
    features: Sequence[str],
    rows: int,
    neck: int | None = None,
    iterations: int = fixed.NETWORK_ITERATIONS,
    seed: int = fixed.SEED,
    ident: str = "sample_id",
) -> BottleneckModel:
    """Train on all rows; the neck is half the sensors, rounded up, and always narrower than they are.

    Start values come from the seed, sums are of whole numbers: the same table gives
    the same network in every layout.
    """
    size = len(features)
    neck = min(neck or math.ceil(size / 2), max(1, size - 1))
    hidden = max(4, 2 * size)
    shapes = bottleneck_shapes(size, hidden, neck)
    values = F.array(*[F.col(name).cast("double") for name in features])
    found = train(normal, ident, values, F.lit(0.0), rows, bottleneck_kernel(shapes), draw(shapes, seed), iterations)
    return BottleneckModel(tuple(features), hidden, neck, tuple(map(float, found)))
