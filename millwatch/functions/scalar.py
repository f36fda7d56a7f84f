"""Column functions for scores, labels and display texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millwatch import fixed
from millwatch.functions.rounding import round_exact, round_scaled


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def min_max(value: Column, low: float | Column, high: float | Column) -> Column:
    """Place a value in [0, 1] between two bounds, clipping outside."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    width = F.greatest(high - low, F.lit(fixed.RANGE_FLOOR))
    return clip((value - low) / width, 0.0, 1.0)


def abs_z(value: Column, mean: float, std: float) -> Column:
    return F.abs((value - F.lit(float(mean))) / F.lit(float(std)))


def row_maximum(columns: Sequence[Column]) -> Column:
    """Largest of the columns in a row (``greatest`` wants at least two)."""
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def health(score: Column) -> Column:
    """0-100 health of a 6-digit score, kept at 3 digits."""
    return round_scaled(clip(F.lit(100.0) * (F.lit(1.0) - score), 0.0, 100.0), 3)


def shown_health(health_value: Column) -> Column:
    return round_exact(health_value, 2)


def shown_score(score: Column) -> Column:
    return round_exact(score, 3)


def _banded(value: Column, steps: Sequence[tuple[float, str]], rest: str) -> Column:
    chain = None
    for limit, name in steps:
        test = value >= F.lit(limit)
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain.otherwise(rest)


def health_band(health_value: Column) -> Column:
    return _banded(health_value, fixed.HEALTH_BANDS, fixed.HEALTH_REST)


def risk_level(score: Column) -> Column:
    return _banded(score, fixed.RISK_LEVELS, fixed.RISK_REST)


def verdict(f1: Column) -> Column:
    named = _banded(f1, fixed.VERDICTS, fixed.VERDICT_REST)
    return F.when(f1.isNull(), fixed.VERDICT_MISSING).otherwise(named)


def label_text(label: Column) -> Column:
    return (
        F.when(label.isNull(), "UNKNOWN").when(label == 1, "FAILURE").otherwise("NORMAL")
    )


def nan_to_null(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def clamp_threshold(threshold: float) -> float:
    return float(min(max(threshold, 0.0), 1.0))


def metric_cell(value: Column) -> Column:
    """A metric as text with three digits, or ``n/a``."""
    text = F.format_string("%.3f", round_exact(value, 3))
    return F.when(value.isNull(), F.lit("n/a")).otherwise(text)


def fixed_text(value: Column, digits: int) -> Column:
    """A number with so many digits after the point, rounded as Python does.

    Put together from whole numbers, which costs a fraction of a format; that takes the
    rest (below zero, a billion or more, no number, null).
    """
    rounded, scale = round_exact(value, digits), 10**digits
    whole = F.rint(rounded * F.lit(float(scale))).cast("long")
    last = F.lpad(F.pmod(whole, F.lit(scale)).cast("string"), digits, "0")
    text = F.concat(F.floor(whole / F.lit(scale)).cast("string"), F.lit("."), last)
    usual = (rounded >= 0) & (rounded < 1e9)
    return F.when(usual, text).otherwise(F.format_string(f"%.{digits}f", rounded))


def title(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def iso_second(moment: Column) -> Column:
    """ISO text of a zone-free timestamp in whole seconds, whatever the session zone."""
    return F.replace(moment.cast("string"), F.lit(" "), F.lit("T"))


def json_object(pairs: dict[str, Column]) -> Column:
    """A JSON object in the given key order; nulls are written out."""
    packed = F.struct(*[column.alias(name) for name, column in pairs.items()])
    return F.to_json(packed, {"ignoreNullFields": "false"})
