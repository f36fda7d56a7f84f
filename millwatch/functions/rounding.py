"""Rounding that agrees with NumPy and Python to the last bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Veltkamp constant that splits a double into two 26-bit halves.
_SPLITTER = float(2**27 + 1)


def round_scaled(value: Column, digits: int) -> Column:
    """Round as NumPy does: scale, round half to even, scale back."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def round_exact(value: Column, digits: int) -> Column:
    """Round the exact binary value, as Python's ``round`` does.

    ``value * 10**digits`` is itself rounded, so a product that looks like a
    tie may lie on either side of it.  The lost part of the product is
    recovered with an error-free multiplication and decides the direction.
    """
    scale = F.lit(float(10**digits))
    product = value * scale
    high = value * F.lit(_SPLITTER) - (value * F.lit(_SPLITTER) - value)
    lost = (high * scale - product) + (value - high) * scale
    below = F.floor(product).cast("double")
    looks_tied = (product - below) == F.lit(0.5)
    whole = (
        F.when(looks_tied & (lost > 0), below + F.lit(1.0))
        .when(looks_tied & (lost < 0), below)
        .otherwise(F.rint(product))
    )
    return whole / scale
