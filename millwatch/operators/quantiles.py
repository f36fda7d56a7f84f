"""Exact quantiles that never gather the values in one place."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Up to this many values are gathered to read the wanted ones off.
GATHERED_VALUES = 200_000
_SKETCH_SIZE = 4_096
_SKETCH_GROUPS = 256
# Rank share by which a bracket is widened; well above the sketch's error.
_SLACK = 0.002


@dataclass
class _Search:
    """One order statistic, known to lie in the open interval (low, high)."""

    column: str
    rank: int  # 0-based among the column's values
    below: int  # values at or below ``low``
    inside: int
    low: float | None = None
    high: float | None = None
    answer: float | None = None

    @property
    def interval(self) -> tuple[str, float | None, float | None]:
        return self.column, self.low, self.high


def _within(interval: tuple[str, float | None, float | None]) -> Column:
    """The column's value where it lies in the open interval, else null."""
    column, low, high = interval
    value = F.col(column)
    test = value.isNotNull()
    if low is not None:
        test &= value > F.lit(low)
    if high is not None:
        test &= value < F.lit(high)
    return F.when(test, value)


def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    gathered_values: int = GATHERED_VALUES,
    known_sizes: Mapping[str, int] | None = None,
    sketches: DataFrame | None = None,
) -> dict[str, list[float | None]]:
    """Interpolated quantiles per column; nulls are skipped, no value gives None.

    The wanted values are bracketed with mergeable sketches and counted
    exactly, round by round, until few enough values lie between the bounds to
    be gathered.  The counts decide, so the result is exact.  ``known_sizes``
    gives the values per column where they have been counted before, ``sketches`` a
    row of their merged sketches, one column for each name, where those were kept.
    """
    names = list(wanted)
    sizes = _sizes(df, names, known_sizes)
    places = {
        (name, q): q * (sizes[name] - 1) for name in names if sizes[name] for q in wanted[name]
    }
    searches: dict[tuple[str, int], _Search] = {}
    for (name, _), place in places.items():
        for rank in (math.floor(place), math.ceil(place)):
            searches[name, rank] = _Search(name, rank, 0, sizes[name])
    _resolve(df, list(searches.values()), gathered_values, sketches)

    def value_of(name: str, q: float) -> float | None:
        if (name, q) not in places:
            return None
        place = places[name, q]
        left = searches[name, math.floor(place)].answer
        right = searches[name, math.ceil(place)].answer
        return left + (right - left) * (place - math.floor(place))

    return {name: [value_of(name, q) for q in wanted[name]] for name in names}


def _sizes(
    df: DataFrame, names: Sequence[str], known: Mapping[str, int] | None
) -> Mapping[str, int]:
    if known is not None:
        return known
    return df.agg(*[F.count(name).alias(name) for name in names]).first().asDict()


def sketch(values: Column) -> Column:
    """Mergeable summary of a column, an aggregate."""
    return F.kll_sketch_agg_double(values, F.lit(_SKETCH_SIZE))


def merged_sketch(sketches: Column) -> Column:
    return F.kll_merge_agg_double(sketches, F.lit(_SKETCH_SIZE))


def _resolve(
    df: DataFrame, searches: list[_Search], gathered_values: int, sketches: DataFrame | None
) -> None:
    while pending := [s for s in searches if s.answer is None]:
        wide = [s for s in pending if s.inside > gathered_values]
        if wide:
            _narrow(df, wide, sketches)
            sketches = None  # they tell of whole columns, so only of the first bracket
        else:
            _read_off(df, pending)


def _read_off(df: DataFrame, searches: list[_Search]) -> None:
    """Gather the few values left in each interval and take the wanted ones."""
    intervals = list(dict.fromkeys(s.interval for s in searches))
    lists = {i: f"v{n}" for n, i in enumerate(intervals)}
    gathered = df.agg(
        *[F.sort_array(F.collect_list(_within(i))).alias(name) for i, name in lists.items()]
    )
    found = gathered.select(
        *[
            F.element_at(lists[s.interval], s.rank - s.below + 1).alias(f"s{n}")
            for n, s in enumerate(searches)
        ]
    ).first()
    for search, value in zip(searches, found):
        search.answer = float(value)


def _sketched(df: DataFrame, intervals: Sequence[tuple[str, float | None, float | None]]) -> DataFrame:
    """One row with a merged sketch for each interval."""
    parts = df.groupBy((F.spark_partition_id() % _SKETCH_GROUPS).alias("group")).agg(
        *[sketch(_within(i)).alias(f"k{n}") for n, i in enumerate(intervals)]
    )
    return parts.agg(*[merged_sketch(F.col(f"k{n}")).alias(f"k{n}") for n in range(len(intervals))])


def _narrow(df: DataFrame, searches: list[_Search], sketches: DataFrame | None = None) -> None:
    """One sketch pass, unless sketches are given, and one counting pass for all open searches."""
    intervals = list(dict.fromkeys(s.interval for s in searches))
    if sketches is None:
        merged = _sketched(df, intervals)
        sketch_of = {i: f"k{n}" for n, i in enumerate(intervals)}
    else:
        merged, sketch_of = sketches, {i: i[0] for i in intervals}
    bounds = []
    for n, search in enumerate(searches):
        share = (search.rank - search.below) / search.inside
        pair = F.array(F.lit(max(share - _SLACK, 0.0)), F.lit(min(share + _SLACK, 1.0)))
        bounds.append(
            F.kll_sketch_get_quantile_double(F.col(sketch_of[search.interval]), pair).alias(f"s{n}")
        )
    found = merged.select(*bounds).first()
    tests = []
    for n, search in enumerate(searches):
        value, (low, high) = F.col(search.column), found[n]
        tests += [value < F.lit(low), value <= F.lit(low), value < F.lit(high), value <= F.lit(high)]
    counts = df.agg(*[F.count_if(test).alias(f"c{n}") for n, test in enumerate(tests)]).first()
    for n, search in enumerate(searches):
        low, high = found[n]
        under, up_to_low, before_high, up_to_high = counts[4 * n : 4 * n + 4]
        end = search.below + search.inside
        if search.rank < under:
            search.high, search.inside = low, under - search.below
        elif search.rank < up_to_low:
            search.answer = float(low)
        elif search.rank < before_high:
            search.low, search.high = low, high
            search.below, search.inside = up_to_low, before_high - up_to_low
        elif search.rank < up_to_high:
            search.answer = float(high)
        else:
            search.low, search.below, search.inside = high, up_to_high, end - up_to_high
