"""Canonical sensor tables from other machine-generated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch.operators.normalize import zone_free_seconds
from millwatch.operators.ordering import GROUP_ROWS, micros_of, with_global_row_number, with_previous

# Sensors each adapter fills, in canonical order.
EVENT_SENSORS = ("torque", "tool_wear", "vibration")
LINE_SENSORS = ("torque", "tool_wear", "vibration")
SIX_SENSORS = (
    "air_temperature", "process_temperature", "rotational_speed", "torque", "tool_wear", "vibration",
)

_LINE_ORDER = (
    "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
)


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def sensor_events(spark: SparkSession, folder: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Readings per user: event value, pause since the last event, a counter."""
    events = _read(spark, folder, "events").select(
        "event_id", "user_id", "event_type", "value", "ts",
        F.get_json_object("props", "$.k").cast("double").alias("torque"),
    )
    placed = with_previous(events, "user_id", "ts", "event_id", "ts", "last_ts", group_rows)
    pause = (micros_of(F.col("ts")) - micros_of(F.col("last_ts"))) / F.lit(1e6)
    wear = F.coalesce(pause, F.lit(0.0))
    failed = ((F.col("value") >= 110) | (F.col("tool_wear") >= 100_000)) & (
        F.col("event_type") != "view"
    )
    return placed.withColumn("tool_wear", wear).select(
        (F.col("event_id") + 1).alias("sample_id"),
        F.col("user_id").cast("string").alias("machine_id"),
        zone_free_seconds(F.col("ts")).alias("timestamp"),
        "torque",
        "tool_wear",
        F.col("value").alias("vibration"),
        failed.cast("int").alias("failure_label"),
    )


def sensor_events_gappy(spark: SparkSession, folder: str) -> DataFrame:
    """The same with missing readings."""
    event_id = F.col("sample_id") - 1
    return sensor_events(spark, folder).withColumns(
        {
            "vibration": F.when(event_id % 17 != 0, F.col("vibration")),
            "torque": F.when(event_id % 23 != 0, F.col("torque")),
        }
    )


def sensor_events_text(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a text table with other column names."""
    return sensor_events(spark, folder).select(
        F.col("sample_id").alias("row id"),
        F.col("machine_id").alias("Product ID"),
        F.col("timestamp").cast("string").alias("Event Time"),
        F.col("torque").cast("string").alias("Torque [Nm]"),
        F.col("tool_wear").cast("string").alias("Tool wear [min]"),
        F.col("vibration").cast("string").alias("Vibe"),
        F.when(F.col("failure_label") == 1, "Yes").otherwise("no").alias("Machine failure"),
    )


def _line_readings(spark: SparkSession, folder: str, more: dict[str, Column]) -> DataFrame:
    torque = F.col("l_extendedprice") * F.col("l_discount") / 1000
    vibration = F.col("l_extendedprice") * F.col("l_discount") * F.col("l_tax") / 100
    failed = ((vibration >= 1.2) | (torque >= 7.5)) & (F.col("l_returnflag") != "A")
    readings = [
        F.col("l_suppkey").cast("string").alias("machine_id"),
        zone_free_seconds(F.col("l_shipdate")).alias("timestamp"),
        *[reading.alias(name) for name, reading in more.items()],
        torque.alias("torque"),
        F.col("l_quantity").alias("tool_wear"),
        vibration.alias("vibration"),
        failed.cast("int").alias("failure_label"),
    ]
    lines = with_global_row_number(
        _read(spark, folder, "lineitem").select(*_LINE_ORDER), _LINE_ORDER, "sample_id", readings
    )
    return lines.select("sample_id", *[name for name in lines.columns if name != "sample_id"])


def sensor_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Readings per supplier, numbered by date; the table has no id of its own."""
    return _line_readings(spark, folder, {})


def sensor_lines_six(spark: SparkSession, folder: str) -> DataFrame:
    """The same with all six sensors: rates as temperatures, unit price as speed."""
    return _line_readings(
        spark, folder,
        {
            "air_temperature": F.col("l_tax") * 100 + 290,
            "process_temperature": F.col("l_discount") * 100 + 300,
            "rotational_speed": F.col("l_extendedprice") / F.col("l_quantity"),
        },
    )
