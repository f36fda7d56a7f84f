"""Overview of an input table before any processing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch import fixed
from millwatch.operators.normalize import normalize_columns


def preview_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, columns, machines and whether labels are there."""
    named, _ = normalize_columns(df)
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    machines = (
        distinct("machine_id").cast("string")
        if "machine_id" in named.columns
        else F.lit("Unknown")
    )
    labelled = "Yes" if "failure_label" in named.columns else "No"
    return named.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("features"),
        machines.alias("machines"),
        F.lit(labelled).alias("failure_labels"),
    )


def preview_rows(
    df: DataFrame, order: Sequence[Column | str] = (), limit: int = fixed.PREVIEW_ROWS
) -> DataFrame:
    """The first rows, in the table's own or a given order."""
    return (df.orderBy(*order) if order else df).limit(limit)
