"""The six append-only result tables, as partitioned Parquet with published appends."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime, timezone
from functools import reduce
from hashlib import md5
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwatch import fixed
from millwatch.functions.scalar import iso_second, json_object
from millwatch.operators.stats import SCALED
from millwatch.sources.published import PublishedTables

_SENSOR_COLUMNS = ", ".join(f"{name} double" for name in fixed.SENSORS)

# ---- fixed values: table columns -----------------------------------------
SCHEMAS = {
    "raw_sensor_records": (
        "sample_id bigint, source_file string, ingested_at string, machine_id string, "
        f"timestamp timestamp_ntz, {_SENSOR_COLUMNS}, failure_label int, raw_payload string, "
        "batch_id string"
    ),
    "cleaned_sensor_records": (
        "sample_id bigint, created_at string, machine_id string, timestamp timestamp_ntz, "
        f"{_SENSOR_COLUMNS}, failure_label int, scaled_payload string, missing_columns string, "
        "batch_id string, split_name string"
    ),
    "model_predictions": (
        "run_id string, sample_id bigint, split_name string, model_name string, "
        "predicted_label int, health_score double, explanation string, created_at string, "
        "batch_id string"
    ),
    "anomaly_scores": (
        "run_id string, sample_id bigint, split_name string, model_name string, "
        "anomaly_score double, threshold double, rank bigint, created_at string, batch_id string"
    ),
    "evaluation_results": (
        "run_id string, model_name string, accuracy double, precision double, recall double, "
        "f1 double, roc_auc double, support bigint, flagged_count bigint, verdict string, "
        "summary_json string, created_at string, batch_id string"
    ),
    "feature_statistics": (
        "run_id string, split_name string, feature_name string, mean double, std double, "
        "min double, max double, median double, created_at string, batch_id string"
    ),
}
PARTITIONS = {name: ("batch_id",) for name in SCHEMAS} | {"cleaned_sensor_records": ("batch_id", "split_name")}
_SUMMARY = (
    "status", "notes", "accuracy", "precision", "recall", "f1", "roc_auc", "support",
    "flagged_count", "verdict",
)


def utc_now() -> str:
    """Creation time shared by all rows of one write."""
    return datetime.now(timezone.utc).replace(microsecond=0).isoformat()


def new_id() -> str:
    return uuid4().hex[:12]


def _sensor_columns(features: Sequence[str]) -> list[Column]:
    """All sensor columns, null where the batch lacks the sensor."""
    return [
        (F.col(name) if name in features else F.lit(None).cast("double")).alias(name)
        for name in fixed.SENSORS
    ]


def _payload(features: Sequence[str]) -> Column:
    return json_object(
        {
            "sample_id": F.col("sample_id"),
            "machine_id": F.col("machine_id"),
            "timestamp": iso_second(F.col("timestamp")),
            **{name: F.col(name) for name in features},
            "failure_label": F.col("failure_label"),
        }
    )


def raw_rows(
    readings: DataFrame, features: Sequence[str], batch_id: str, source: str, stamp: str
) -> DataFrame:
    return readings.select(
        "sample_id",
        F.lit(source).alias("source_file"),
        F.lit(stamp).alias("ingested_at"),
        "machine_id",
        "timestamp",
        *_sensor_columns(features),
        "failure_label",
        _payload(features).alias("raw_payload"),
        F.lit(batch_id).alias("batch_id"),
    )


def cleaned_rows(
    prepared: DataFrame, features: Sequence[str], missing: Sequence[str], batch_id: str, stamp: str
) -> DataFrame:
    scaled = json_object({name: F.col(SCALED.format(name)) for name in features})
    absent = F.to_json(F.array(*map(F.lit, missing)).cast("array<string>"))
    return prepared.select(
        "sample_id",
        F.lit(stamp).alias("created_at"),
        "machine_id",
        "timestamp",
        *_sensor_columns(features),
        "failure_label",
        scaled.alias("scaled_payload"),
        absent.alias("missing_columns"),
        F.lit(batch_id).alias("batch_id"),
        F.col("split").alias("split_name"),
    )


def _run_columns(run_id: str, batch_id: str, split: str, stamp: str) -> dict[str, Column]:
    return {
        "run_id": F.lit(run_id), "batch_id": F.lit(batch_id),
        "split_name": F.lit(split), "created_at": F.lit(stamp),
    }


def statistics_rows(
    statistics: DataFrame, run_id: str, batch_id: str, stamp: str, split: str = "train"
) -> DataFrame:
    return statistics.withColumns(_run_columns(run_id, batch_id, split, stamp))


def output_rows(
    predictions: DataFrame, run_id: str, batch_id: str, stamp: str, split: str = "test"
) -> DataFrame:
    """Columns of both output tables; each write takes its own."""
    return predictions.withColumns(_run_columns(run_id, batch_id, split, stamp))


def evaluation_rows(
    metric_rows: DataFrame, run_id: str, batch_id: str, stamp: str
) -> DataFrame:
    return metric_rows.withColumn(
        "summary_json", json_object({name: F.col(name) for name in _SUMMARY})
    ).withColumns(
        {"run_id": F.lit(run_id), "batch_id": F.lit(batch_id), "created_at": F.lit(stamp)}
    )


class ResultTables(PublishedTables):
    """The six tables, for appending and for SQL."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        super().__init__(spark, root, SCHEMAS, PARTITIONS)

    def query(self, sql: str, parameters: Sequence[object] | None = None) -> DataFrame:
        """SQL over the six tables with positional ``?`` parameters.

        The tables are named inside the statement, so two roots in one session do not
        meet; their views have names of their own.
        """
        mark = md5(self.root.encode()).hexdigest()[:12]
        for name in self.schemas:
            self.table(name).createOrReplaceTempView(f"{name}_{mark}")
        named = ", ".join(f"{name} AS (SELECT * FROM {name}_{mark})" for name in self.schemas)
        own = re.match(r"\s*WITH\b(?!\s+RECURSIVE\b)", sql, re.IGNORECASE)
        text = f"WITH {named}, {sql[own.end() :]}" if own else f"WITH {named} {sql}"
        return self.spark.sql(text, args=list(parameters or []))

    def counts(self) -> DataFrame:
        """Row count per table."""
        counted = [
            self.table(name).agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("table_name"), "rows"
            )
            for name in self.schemas
        ]
        return reduce(DataFrame.unionByName, counted)
