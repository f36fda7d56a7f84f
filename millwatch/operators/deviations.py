"""Per-row deviations from normal running and the sentences made of them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millwatch import fixed
from millwatch.functions.rounding import round_exact
from millwatch.functions.scalar import abs_z, fixed_text
from millwatch.operators.stats import TrainStats


def deviations(stats: TrainStats) -> Column:
    """All sensors of a row, largest deviation first.

    An array of ``{order, place, feature, z_score}``, sorted inside the row: no
    shuffle, ties keep the sensor order.
    """
    entries = []
    for i, name in enumerate(stats.features):
        mean, std = stats.reference_means[name], stats.reference_stds[name]
        z = round_exact(abs_z(F.col(name), mean, std), 3)
        entries.append(
            F.struct(
                (-z).alias("order"), F.lit(i).alias("place"),
                F.lit(name).alias("feature"), z.alias("z_score"),
            )
        )
    return F.sort_array(F.array(*entries))


def top_features(
    deviation_list: Column, sensors: int, count: int = fixed.TOP_FEATURES
) -> Column:
    """Names of the sensors that deviate most."""
    return F.array(*[deviation_list[i]["feature"] for i in range(min(count, sensors))])


def explanation(score: Column, prediction: Column, deviation_list: Column, sensors: int) -> Column:
    """Sentence about a row's score and the sensors behind it.

    ``score`` and ``deviation_list`` are read many times over: give them as columns of the frame.
    """
    named = []
    for i in range(min(fixed.TOP_FEATURES, sensors)):
        entry = deviation_list[i]
        named += [F.lit(", " * bool(i)), entry["feature"], F.lit(" ("), fixed_text(entry["z_score"], 1), F.lit("z)")]
    alert, calm = (re.split(r"%\.2f|%s", text) for text in (fixed.ALERT_TEXT, fixed.CALM_TEXT))
    begin, middle, end = (F.when(prediction == 1, F.lit(a)).otherwise(F.lit(c)) for a, c in zip(alert, calm))
    return F.concat(begin, fixed_text(score, 2), middle, *named, end)
