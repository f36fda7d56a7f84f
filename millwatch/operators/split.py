"""Chronological train/validation/test split per machine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch import fixed
from millwatch.operators.ordering import GROUP_ROWS, with_positions


def split_ends(size: Column) -> tuple[Column, Column]:
    """Rows up to the end of train and up to the end of validation.

    Sixty and eighty percent, each part with a row where the timeline allows:
    a timeline of two has no validation row, one of one gives it to both train
    and test.
    """
    train = F.greatest(F.lit(1), F.floor(size * fixed.TRAIN_TENTHS / 10))
    upper = F.greatest(
        train + 1, F.floor(size * fixed.TRAIN_AND_VALIDATION_TENTHS / 10)
    )
    upper = F.least(upper, size - 1)
    train = F.when(train >= upper, F.greatest(F.lit(1), upper - 1)).otherwise(train)
    return train, upper


def chronological_split(
    df: DataFrame, allow_overlap: bool = True, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Tag every reading with its split and its place inside that split.

    Adds ``split`` and ``split_position`` (1-based).  ``allow_overlap=False``
    keeps the reading of a single-row machine in train only.
    """
    placed = with_positions(
        df, "machine_id", "timestamp", "sample_id", group_rows, "_place", "_size"
    )
    train, upper = split_ends(F.col("_size"))
    name = (
        F.when(F.col("_place") <= F.col("_train"), "train")
        .when(F.col("_place") <= F.col("_upper"), "validation")
        .otherwise("test")
    )
    start = (
        F.when(F.col("split") == "train", F.lit(0))
        .when(F.col("split") == "validation", F.col("_train"))
        .otherwise(F.col("_upper"))
    )
    names = F.array(name)
    if allow_overlap:
        names = F.when(F.col("_size") == 1, F.array(F.lit("train"), F.lit("test"))).otherwise(names)
    tagged = placed.withColumns({"_train": train, "_upper": upper}).withColumn(
        "split", F.explode(names)
    )
    return tagged.withColumn("split_position", (F.col("_place") - start).cast("long")).drop(
        "_place", "_size", "_train", "_upper"
    )


def split_sizes(split_frame: DataFrame) -> DataFrame:
    return split_frame.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def check_splits(
    split_frame: DataFrame, features: Sequence[str] = ()
) -> tuple[dict[str, int], dict[str, int]]:
    """Rows per split and train values per sensor; raises if a split has no rows."""
    counted = split_frame.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(name).alias(name) for name in features]
    )
    found = {row["split"]: row for row in counted.collect()}
    for name in fixed.SPLITS:
        if name not in found:
            raise ValueError(f"The {name} split has no rows; more readings are needed.")
    sizes = {name: row["rows"] for name, row in found.items()}
    return sizes, {name: found["train"][name] for name in features}


def select_split(split_frame: DataFrame, name: str) -> DataFrame:
    return split_frame.where(F.col("split") == name)
