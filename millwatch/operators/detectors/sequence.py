"""Sequence risk: a classifier over each reading's last eight readings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch import fixed
from millwatch.operators.detectors.gradient import pack_timelines, train as train_network, train_on
from millwatch.operators.detectors.networks import (
    draw, failure_probabilities, perceptron_kernel, perceptron_shapes, recurrent_kernel, recurrent_shapes,
)
from millwatch.operators.ordering import GROUP_ROWS, with_earlier_rows

NEEDS_BOTH_CLASSES = "The sequence detector needs train readings with and without failure."


def with_windows(
    df: DataFrame,
    features: Sequence[str],
    rows: int = fixed.WINDOW_ROWS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Add ``window``: the last ``rows`` feature rows of the machine's split.

    Early readings repeat the first one on the left; every split starts anew.
    """
    payload = F.array(*[F.col(name) for name in features])
    seen, names = with_earlier_rows(df, ["split", "machine_id"], "split_position", payload, rows, group_rows)
    # where there is no earlier row, the earliest there is
    entries = [F.coalesce(*reversed(names[: n + 1])) for n in reversed(range(rows))]
    return seen.withColumn("window", F.array(*entries)).drop(*names)


def _vector() -> Column:
    return array_to_vector(F.flatten("window"))


@dataclass(frozen=True)
class SequenceModel:
    features: tuple[str, ...]  # scaled columns
    classifier: MultilayerPerceptronClassificationModel | None
    rows: int = fixed.WINDOW_ROWS
    threshold: float = fixed.SCORE_THRESHOLD

    @property
    def fitted(self) -> bool:
        return self.classifier is not None

    @property
    def status(self) -> str:
        return "ok" if self.fitted else "skipped"

    @property
    def notes(self) -> str:
        return "" if self.fitted else NEEDS_BOTH_CLASSES

    def with_probability(self, rows: DataFrame, name: str) -> DataFrame:
        """Add the failure probability after each ``window``."""
        scored = self.classifier.transform(rows.withColumn("features", _vector()))
        return scored.withColumn(name, vector_to_array("probability")[1])


@dataclass(frozen=True)
class RecurrentModel:
    """A recurrent cell that reads the window row by row; takes the place of ``SequenceModel``."""

    features: tuple[str, ...]  # scaled columns
    parameters: tuple[float, ...] | None
    hidden: int = fixed.SEQUENCE_HIDDEN
    rows: int = fixed.WINDOW_ROWS
    threshold: float = fixed.SCORE_THRESHOLD

    @property
    def fitted(self) -> bool:
        return self.parameters is not None

    @property
    def status(self) -> str:
        return "ok" if self.fitted else "skipped"

    @property
    def notes(self) -> str:
        return "" if self.fitted else NEEDS_BOTH_CLASSES

    def with_probability(self, rows: DataFrame, name: str) -> DataFrame:
        """Add the failure probability after each ``window``, in Arrow batches."""
        parameters, length = np.array(self.parameters), self.rows
        shapes = recurrent_shapes(len(self.features), self.hidden)

        def probability(windows: pd.Series) -> pd.Series:
            flat = np.stack(windows.to_numpy()) if len(windows) else np.zeros((0, length * shapes[0][0]))
            return pd.Series(failure_probabilities(parameters, shapes, flat.reshape(len(windows), length, -1)))

        probability.__annotations__ = {"windows": pd.Series, "return": pd.Series}
        return rows.withColumn(name, F.pandas_udf(probability, "double")(F.flatten("window")))


def fit_sequence(
    train: DataFrame,
    features: Sequence[str],
    classes: int,
    iterations: int = fixed.SEQUENCE_ITERATIONS,
    hidden: int = fixed.SEQUENCE_HIDDEN,
    seed: int = fixed.SEED,
    group_rows: int = GROUP_ROWS,
) -> SequenceModel:
    """Train on all train readings; with one class only, the model is skipped.

    Steps are taken on timelines, each reading stored once; the weights found are handed to
    Spark's perceptron, which takes no further step and scores, saves and loads itself.
    """
    if classes < 2:
        return SequenceModel(tuple(features), None)
    rows = train.count()
    blocks = pack_timelines(
        train, ["split", "machine_id"], "split_position", features, F.col("failure_label"), rows, fixed.WINDOW_ROWS, group_rows
    )
    size = len(features) * fixed.WINDOW_ROWS
    shapes = perceptron_shapes(size, hidden)
    found = train_on(blocks, rows, perceptron_kernel(shapes, fixed.WINDOW_ROWS), draw(shapes, seed), iterations)
    learner = MultilayerPerceptronClassifier(
        layers=[size, hidden, 2], maxIter=0, initialWeights=Vectors.dense(found)
    )
    one = train.sparkSession.createDataFrame([(Vectors.dense(np.zeros(size)), 0.0)], ["features", "label"])
    return SequenceModel(tuple(features), learner.fit(one))


def fit_recurrent(
    train: DataFrame,
    features: Sequence[str],
    classes: int,
    rows: int,
    iterations: int = fixed.NETWORK_ITERATIONS,
    hidden: int = fixed.SEQUENCE_HIDDEN,
    seed: int = fixed.SEED,
    group_rows: int = GROUP_ROWS,
) -> RecurrentModel:
    """Train the recurrent cell on the windows of all train readings; skipped with one class only."""
    if classes < 2:
        return RecurrentModel(tuple(features), None, hidden)
    shapes = recurrent_shapes(len(features), hidden)
    windows = with_windows(train, features, group_rows=group_rows)
    found = train_network(
        windows, "sample_id", F.flatten("window"), F.col("failure_label"), rows,
        recurrent_kernel(shapes, fixed.WINDOW_ROWS), draw(shapes, seed), iterations, kind="float32",
    )
    return RecurrentModel(tuple(features), tuple(map(float, found)), hidden)


def with_sequence_score(rows: DataFrame, model: SequenceModel | RecurrentModel, name: str = "lstm") -> DataFrame:
    """Add ``<name>_raw`` and ``<name>_prediction`` to rows that have their ``window``; keeps state nowhere."""
    if not model.fitted:
        return rows.withColumns({f"{name}_raw": F.lit(0.0), f"{name}_prediction": F.lit(0)})
    scored = model.with_probability(rows, f"{name}_raw")
    flag = (F.col(f"{name}_raw") >= F.lit(model.threshold)).cast("int")
    return scored.select(*rows.columns, f"{name}_raw", flag.alias(f"{name}_prediction"))


def score_sequence(
    df: DataFrame, model: SequenceModel | RecurrentModel, name: str = "lstm", group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Add ``<name>_raw`` (failure probability) and ``<name>_prediction``."""
    if not model.fitted:
        return with_sequence_score(df, model, name)
    rows = with_windows(df, model.features, model.rows, group_rows)
    return with_sequence_score(rows, model, name).drop("window")
