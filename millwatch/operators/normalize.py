"""From any table of machine readings to the canonical sensor table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwatch import fixed
from millwatch.functions.scalar import nan_to_null
from millwatch.operators.ordering import fraction_of, with_global_row_number

# Texts that read as a number; plain casts would also take Java suffixes.
_NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def slug(name: str) -> str:
    """Lower case, with every run of other characters as one underscore."""
    return "_".join(re.findall(r"[a-z0-9]+", name.lower()))


def canonical_names(columns: Sequence[str]) -> dict[str, str]:
    """Column name -> canonical or slugged name; metadata only."""
    by_alias = {alias: name for name, aliases in fixed.ALIASES.items() for alias in aliases}
    names = {column: by_alias.get(slug(column), slug(column)) for column in columns}
    taken: dict[str, str] = {}
    for column, name in names.items():
        if name in taken and name in fixed.ALIASES:
            raise ValueError(f"Columns {taken[name]!r} and {column!r} both read as {name!r}.")
        taken[name] = column
    return names


def normalize_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Rename known columns to canonical names; also returns the renames made."""
    names = canonical_names(df.columns)
    recognised = {column: name for column, name in names.items() if name in fixed.ALIASES}
    return df.toDF(*[names[column] for column in df.columns]), recognised


def available_sensors(columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Sensors that are there and sensors that are not, in canonical order."""
    present = [sensor for sensor in fixed.SENSORS if sensor in columns]
    absent = [sensor for sensor in fixed.SENSORS if sensor not in columns]
    return present, absent


def column_warnings(df: DataFrame) -> list[str]:
    """Warnings about absent sensors; a missing torque is named alone."""
    _, absent = available_sensors(list(canonical_names(df.columns).values()))
    if "torque" in absent:
        return ["Missing required column: torque"]
    return [f"Missing sensor columns: {', '.join(absent)}"] if absent else []


def null_tokens_to_null(df: DataFrame) -> DataFrame:
    """Read the usual missing-value texts of string columns as null."""
    texts = [field.name for field in df.schema if isinstance(field.dataType, T.StringType)]
    return df.withColumns(
        {
            name: F.when(~F.col(f"`{name}`").isin(*fixed.NULL_TOKENS), F.col(f"`{name}`"))
            for name in texts
        }
    )


def number_of(column: Column, data_type: T.DataType) -> Column:
    """The column as double; texts that are no number, NaN and infinite values become null."""
    if isinstance(data_type, T.StringType):
        column = F.when(column.rlike(_NUMBER), column.try_cast("double"))
        # only a finite number less itself is zero; a test and a branch would read a text twice
        return nan_to_null(column - (column - column))
    column = column.cast("double")
    return F.when(F.abs(column) < float("inf"), column)  # NaN is above all numbers


def zone_free_seconds(column: Column) -> Column:
    """Drop fractions of a second without passing through a time zone."""
    return column - F.expr("INTERVAL '0.000001' SECOND") * fraction_of(column)


def moment_of(column: Column, data_type: T.DataType, pattern: str | None = None) -> Column:
    """The column as zone-free timestamp in whole seconds, null if unreadable.

    A pattern describes texts without a zone; they are read as UTC and counted
    from 1970, so that the session's zone and its clock changes play no part.
    """
    if isinstance(data_type, T.StringType) and pattern is not None:
        instant = F.try_to_timestamp(F.concat(column, F.lit(" UTC")), F.lit(f"{pattern} VV"))
        zero = F.lit(0)
        start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return start + F.make_dt_interval(zero, zero, zero, F.unix_seconds(instant))
    if isinstance(data_type, T.StringType):
        column = column.try_cast("timestamp_ntz")
    else:
        column = column.cast("timestamp_ntz")
    return zone_free_seconds(column)


def epoch_moment(column: Column, data_type: T.DataType, unit: str) -> Column:
    """The moment of a count since 1970 in the given unit, in whole seconds."""
    if unit not in fixed.EPOCH_UNITS:
        raise ValueError(f"Unknown epoch unit {unit!r}; known are {', '.join(fixed.EPOCH_UNITS)}.")
    if isinstance(data_type, T.StringType):
        column = F.when(column.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(column).try_cast("long"))
    seconds = F.floor(column / fixed.EPOCH_UNITS[unit]).cast("decimal(18,6)")
    zero = F.lit(0)
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return start + F.make_dt_interval(zero, zero, zero, seconds)


def time_readings(
    column: Column, data_type: T.DataType, forms: str | Sequence[str] | None = None, unit: str | None = None
) -> list[Column]:
    """Ways to read a time column, in the order they are tried; one of them fits the whole column.

    A unit means counts since 1970.  Texts are read as ISO or by the given forms,
    by default the usual ones, month before day.
    """
    if unit is not None:
        return [epoch_moment(column, data_type, unit)]
    if isinstance(data_type, T.NumericType):
        raise ValueError("The times are numbers; give their unit since 1970 as epoch_unit.")
    if not isinstance(data_type, T.StringType):
        return [moment_of(column, data_type)]
    if isinstance(forms, str):
        return [moment_of(column, data_type, forms)]
    return [moment_of(column, data_type, form) for form in (None, *(forms or fixed.TIME_FORMS))]


def timeline_moment(row_number: Column) -> Column:
    """Moment of the n-th row in a table that has no time column."""
    start = F.lit(fixed.TIMELINE_START).cast("timestamp_ntz")
    minutes = ((row_number - 1) * fixed.TIMELINE_STEP_MINUTES).cast("long")
    return F.timestamp_add("MINUTE", minutes, start)


def is_label_word(df: DataFrame, name: str = "failure_label") -> Column:
    """Whether a label is a text that is no number."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        return F.lit(False)
    return F.col(name).isNotNull() & ~F.col(name).rlike(_NUMBER)


def label_of(df: DataFrame, name: str = "failure_label", words: bool | None = None) -> Column:
    """Label-like values as 0/1, by the rule that fits the whole column.

    Numbers: above zero is a failure.  Texts: the failure words.  Null is 0.
    One word makes it a text column; ``words`` tells so if it is known, which
    otherwise takes a pass over the column.
    """
    column, data_type = F.col(name), df.schema[name].dataType
    if words is None and isinstance(data_type, T.StringType):
        words = df.agg(F.count_if(is_label_word(df, name))).first()[0] > 0
    if isinstance(data_type, T.BooleanType):
        failed = column
    elif words:
        failed = F.lower(F.trim(column)).isin(*fixed.FAILURE_WORDS)
    else:
        failed = number_of(column, data_type) > 0
    return F.coalesce(failed.cast("int"), F.lit(0))


def with_sample_ids(
    df: DataFrame, id_column: str | None = None, order: Sequence[str] | None = None
) -> DataFrame:
    """Give every row its ``sample_id``.

    A named id column is taken as it is; ``ingest`` checks that its values differ.
    Otherwise rows are numbered from 1, in the given order or in the order they are read.
    """
    if id_column is not None:
        return df.withColumn("sample_id", F.col(id_column).cast("long"))
    return with_global_row_number(df, order, "sample_id")


def canonical_select(df: DataFrame, sensors: Sequence[str]) -> DataFrame:
    return df.select("sample_id", "machine_id", "timestamp", *sensors, "failure_label")


def canonical_order(df: DataFrame) -> DataFrame:
    """Sort for output; inner steps order by window instead."""
    return df.orderBy("machine_id", "timestamp", "sample_id")
