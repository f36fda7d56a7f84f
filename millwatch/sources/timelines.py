"""Readings stored by machine, so that work along timelines needs no shuffle.

The files are bucketed by machine and sorted inside each bucket, one file for each.
Split, positions and trailing windows partition by machine, which the buckets already
do.  A machine is in one bucket, whatever its size: tables with a machine beyond
``GROUP_ROWS`` are better left unbucketed, where its timeline is cut into cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from millwatch.operators.ordering import GROUP_ROWS, largest_group

_KEY = "machine_id"
_ORDER = ("machine_id", "timestamp", "sample_id")


def _described(schema: Sequence[tuple[str, str]], buckets: int, path: str, name: str) -> str:
    columns = ", ".join(f"`{column}` {kind}" for column, kind in schema)
    place = path.replace("'", "\\'")
    return (
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({_KEY}) "
        f"SORTED BY ({', '.join(_ORDER)}) INTO {buckets} BUCKETS LOCATION '{place}'"
    )


def store_timelines(readings: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Write canonical readings as the table ``name`` in a folder, in one shuffle; rows without machine are left out."""
    rows = readings.where(f"{_KEY} is not null")
    largest = largest_group(rows, _KEY)
    if largest > GROUP_ROWS:
        raise ValueError(f"One machine has {largest} readings; a bucket would hold them all.")
    (
        rows.repartition(buckets, _KEY)
        .write.format("parquet")
        .bucketBy(buckets, _KEY)
        .sortBy(*_ORDER)
        .option("path", path)
        .saveAsTable(name)
    )
    return readings.sparkSession.table(name)


def open_timelines(spark: SparkSession, name: str, path: str, schema: Sequence[tuple[str, str]], buckets: int) -> DataFrame:
    """The table of an earlier session: the files tell their buckets by name, the catalog has to be told of them."""
    if not spark.catalog.tableExists(name):
        spark.sql(_described(schema, buckets, path, name))
    return spark.table(name)
