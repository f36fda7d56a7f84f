"""Prepare: split, fill gaps, scale; everything fitted on train only."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from millwatch.operators.ordering import GROUP_ROWS
from millwatch.operators.quantiles import GATHERED_VALUES
from millwatch.operators.split import check_splits, chronological_split, select_split
from millwatch.operators.stats import (
    TrainStats, feature_statistics, fit_train_stats, impute, scale, statistics_table, train_medians,
)
from millwatch.plans.ingest import Ingested
from millwatch.session import stage
from millwatch.sources.results import load_text, save_text
from millwatch.sources.tables import (
    ResultTables, cleaned_rows, new_id, statistics_rows, utc_now,
)


@dataclass(frozen=True)
class Prepared:
    """Readings of all splits, imputed and scaled, and the fitted values."""

    frame: DataFrame
    features: tuple[str, ...]
    medians: dict[str, float]
    stats: TrainStats
    sizes: dict[str, int]
    run_id: str = ""
    batch_id: str = ""
    missing: tuple[str, ...] = ()
    label_available: bool = True
    notes: tuple[str, ...] = ()
    fitted_here: bool = True  # medians and statistics come from this table's train part

    def split(self, name: str) -> DataFrame:
        return select_split(self.frame, name)

    @property
    def train(self) -> DataFrame:
        return self.split("train")

    @property
    def test(self) -> DataFrame:
        return self.split("test")

    def statistics(self) -> DataFrame:
        """Statistics of the train part that medians and scaler come from."""
        if self.fitted_here:
            return feature_statistics(self.train, self.features, self.medians)
        return statistics_table(self.frame.sparkSession, self.stats, self.medians)


def prepare_readings(
    readings: DataFrame,
    features: Sequence[str],
    allow_overlap: bool = True,
    group_rows: int = GROUP_ROWS,
    gathered_values: int = GATHERED_VALUES,
    saved: tuple[dict[str, float], TrainStats] | None = None,
    **about,
) -> Prepared:
    """Split a canonical table, then fit medians and scaler on its train part.

    The split rows are staged once: the shuffle that makes them runs once,
    however many passes follow, and those read only the columns they need.
    ``saved`` medians and statistics take the place of fitted ones, throughout.
    """
    if len(features) < 2:
        raise ValueError(f"At least two sensor columns are needed. Found: {list(features)}")
    split = stage(chronological_split(readings, allow_overlap, group_rows), "split")
    sizes, values = check_splits(split, features)
    if saved is not None:
        medians, stats = saved
        frame = scale(impute(split, medians), stats)
        return Prepared(frame, tuple(features), medians, stats, sizes, fitted_here=False, **about)
    train = select_split(split, "train")
    medians = train_medians(train, features, gathered_values, values)
    cleaned = impute(split, medians)
    stats = fit_train_stats(select_split(cleaned, "train"), features)
    return Prepared(scale(cleaned, stats), tuple(features), medians, stats, sizes, **about)


def prepare(
    batch: Ingested,
    tables: ResultTables | None = None,
    run_id: str | None = None,
    **options,
) -> Prepared:
    """Prepare an ingested batch and store cleaned rows and statistics."""
    prepared = prepare_readings(
        batch.readings,
        batch.features,
        run_id=run_id or new_id(),
        batch_id=batch.batch_id,
        missing=batch.missing,
        label_available=batch.label_available,
        notes=batch.notes,
        **options,
    )
    if tables is not None:
        stamp = utc_now()
        with tables.commit(f"prepared {batch.batch_id} {prepared.run_id}") as done:
            if done:
                done.append(
                    "cleaned_sensor_records",
                    cleaned_rows(prepared.frame, batch.features, batch.missing, batch.batch_id, stamp),
                )
                done.append(
                    "feature_statistics",
                    statistics_rows(prepared.statistics(), prepared.run_id, batch.batch_id, stamp),
                )
    return prepared


def save_preparation(spark: SparkSession, prepared: Prepared, path: str) -> None:
    """Medians, scaler and run data as one small document."""
    document = {
        "run_id": prepared.run_id,
        "batch_id": prepared.batch_id,
        "feature_columns": list(prepared.features),
        "missing_feature_columns": list(prepared.missing),
        "label_available": prepared.label_available,
        "medians": prepared.medians,
        "means": prepared.stats.means,
        "scales": prepared.stats.scales,
    }
    save_text(spark, path, json.dumps(document))


def load_preparation(spark: SparkSession, path: str) -> dict[str, object]:
    return json.loads(load_text(spark, path))
