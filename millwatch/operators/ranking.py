"""Ranked readings, error lists, sensor votes and per-reading records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwatch import fixed
from millwatch.functions.scalar import (
    health, health_band, label_text, risk_level, shown_health, shown_score, title,
)
from millwatch.operators.deviations import deviations, explanation, top_features
from millwatch.operators.evaluation import constant_by
from millwatch.operators.ordering import with_rank_by_group
from millwatch.operators.stats import TrainStats

CANONICAL = ("machine_id", "timestamp", "sample_id")
FILTER_MODES = (
    "All samples", "Failures only", "Anomalies only", "False positives", "False negatives",
)


def _map(models: Sequence[str], value) -> Column:
    pairs = [item for name in models for item in (F.lit(name), value(name))]
    return F.create_map(*pairs)


def per_sample(
    scored: DataFrame, stats: TrainStats, best: str, models: Sequence[str]
) -> DataFrame:
    """One nested record per scored reading."""
    best_health = health(F.col(f"{best}_score"))
    flag = F.col(f"{best}_prediction")
    return scored.withColumn("_deviations", deviations(stats)).select(
        "sample_id",
        "machine_id",
        "timestamp",
        label_text(F.col("failure_label")).alias("true_label"),
        _map(models, lambda m: label_text(F.col(f"{m}_prediction"))).alias("predictions"),
        _map(models, lambda m: F.col(f"{m}_prediction")).alias("prediction_flags"),
        _map(models, lambda m: shown_score(F.col(f"{m}_score"))).alias("scores"),
        shown_health(best_health).alias("health_score"),
        health_band(best_health).alias("health_label"),
        explanation(
            shown_score(F.col(f"{best}_score")), flag, F.col("_deviations"), len(stats.features)
        ).alias("explanation"),
        top_features(F.col("_deviations"), len(stats.features)).alias("top_features"),
    )


def flatten_samples(records: DataFrame, models: Sequence[str]) -> DataFrame:
    """Nested records as a wide table, three columns per model."""
    columns = [
        column
        for m in models
        for column in (
            F.col("predictions")[m].alias(f"{m}_prediction"),
            F.col("scores")[m].alias(f"{m}_score"),
            F.col("prediction_flags")[m].alias(f"{m}_flag"),
        )
    ]
    return records.select(
        "sample_id", "machine_id", "timestamp", "true_label", "health_score", "health_label",
        "explanation", *columns,
    )


def filter_samples(wide: DataFrame, best: str, mode: str) -> DataFrame:
    """Rows of the flattened table by display mode."""
    flagged = F.col(f"{best}_flag") == 1
    failed = F.col("true_label") == "FAILURE"
    tests = dict(
        zip(FILTER_MODES, (F.lit(True), failed, flagged, ~failed & flagged, failed & ~flagged))
    )
    return wide.where(tests.get(mode, tests[FILTER_MODES[0]]))


def unique_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Select columns, each name once."""
    return df.select(*dict.fromkeys(names))


def sample_table(
    wide: DataFrame, best: str, models: Sequence[str], with_explanation: bool = True
) -> DataFrame:
    """Columns of the reading-by-reading table."""
    names = [
        "sample_id", "machine_id", "true_label", "health_score",
        f"{best}_prediction", f"{best}_score",
        *[f"{m}_prediction" for m in models],
    ]
    return unique_columns(wide, names + ["explanation"] * with_explanation)


def predictions_wide(scored: DataFrame, models: Sequence[str]) -> DataFrame:
    """The scored readings with prediction, score and health per model."""
    raw = {f"{m}_raw" for m in models}
    kept = [c for c in scored.columns if c not in raw]
    return scored.select(*kept).withColumns(
        {f"{m}_health": health(F.col(f"{m}_score")) for m in models}
    )


def predictions_long(
    scored: DataFrame, stats: TrainStats, models: Sequence[str], thresholds: Mapping[str, float]
) -> DataFrame:
    """One row per reading and model with score, threshold, health and rank.

    Ranks run 1..n per model by score, ties in canonical order.
    """
    entries = [
        F.struct(
            F.lit(m).alias("model_name"),
            F.col(f"{m}_score").alias("anomaly_score"),
            F.col(f"{m}_prediction").alias("predicted_label"),
        )
        for m in models
    ]
    long = scored.select(*CANONICAL, "failure_label", *stats.features, F.inline(F.array(*entries)))
    ranked = with_rank_by_group(
        long, "model_name", [F.col("anomaly_score").desc(), *CANONICAL], "rank"
    )
    return ranked.withColumn("_deviations", deviations(stats)).select(
        "sample_id",
        "machine_id",
        "timestamp",
        "model_name",
        "predicted_label",
        health(F.col("anomaly_score")).alias("health_score"),
        explanation(
            F.col("anomaly_score"), F.col("predicted_label"), F.col("_deviations"),
            len(stats.features),
        ).alias("explanation"),
        "anomaly_score",
        constant_by({m: float(thresholds[m]) for m in models}, F.col("model_name")).alias(
            "threshold"
        ),
        "rank",
    )


def _by_score(best: str) -> list[Column | str]:
    return [shown_score(F.col(f"{best}_score")).desc(), *CANONICAL]


def _leading(rows: DataFrame, best: str, limit: int) -> DataFrame:
    """The first rows by score.

    They are one partition already; saying so keeps later projections from being
    moved below the limit, where they would run for every row and turn the top-k
    into a sort of the whole table.
    """
    return rows.orderBy(*_by_score(best)).limit(limit).coalesce(1)


def anomaly_ranking(
    scored: DataFrame, stats: TrainStats, best: str, models: Sequence[str], limit: int | None = None
) -> DataFrame:
    """Readings by the best model's score; a limit makes it a top-k.

    Scored rows are ordered and cut first, so that texts are made only for rows that stay.
    """
    ordered = scored.orderBy(*_by_score(best)) if limit is None else _leading(scored, best, limit)
    return per_sample(ordered, stats, best, models).select(
        "sample_id",
        "machine_id",
        F.col("scores")[best].alias("score"),
        F.col("predictions")[best].alias("predicted_label"),
        "true_label",
        "health_score",
        "explanation",
    )


def top_anomalies(
    scored: DataFrame, stats: TrainStats, best: str, models: Sequence[str], limit: int = fixed.TOP_ANOMALIES
) -> DataFrame:
    ranked = anomaly_ranking(scored, stats, best, models, limit)
    return ranked.withColumn("risk", risk_level(F.col("score")))


def error_deep_dive(
    scored: DataFrame, stats: TrainStats, best: str, models: Sequence[str], limit: int = fixed.TOP_ERRORS
) -> tuple[DataFrame, DataFrame]:
    """Highest-scored false positives and false negatives of the best model."""
    flagged = F.col(f"{best}_prediction") == 1
    failed = F.coalesce(F.col("failure_label") == 1, F.lit(False))
    return tuple(
        per_sample(_leading(scored.where(test), best, limit), stats, best, models)
        for test in (~failed & flagged, failed & ~flagged)
    )


def signal_rows(scored: DataFrame, best: str) -> DataFrame:
    """Rows that vote on which sensors matter."""
    return scored.where(
        (F.col(f"{best}_prediction") == 1)
        | (F.col("failure_label") == 1)
        | (shown_score(F.col(f"{best}_score")) >= fixed.SIGNAL_SCORE)
    )


def feature_importance(scored: DataFrame, stats: TrainStats, best: str) -> DataFrame:
    """How often each sensor is among a signal row's two largest deviations.

    Ties go to the sensor that is met first in canonical order.
    """
    votes = (
        signal_rows(scored, best)
        .withColumn("_deviations", deviations(stats))
        .select(
            *CANONICAL,
            top_features(
                F.col("_deviations"), len(stats.features), fixed.VOTING_FEATURES
            ).alias("names"),
        )
        .select(*CANONICAL, F.posexplode("names").alias("place", "feature"))
    )
    return (
        votes.groupBy("feature")
        .agg(
            F.count(F.lit(1)).alias("mentions"),
            F.min(F.struct(*CANONICAL, "place")).alias("first_seen"),
        )
        .orderBy(F.col("mentions").desc(), "first_seen")
    )


def feature_report(importance: DataFrame) -> DataFrame:
    """Rank and role per sensor; the table has at most a row per sensor."""
    order = Window.orderBy(F.col("mentions").desc(), "first_seen")
    role = (
        F.when(F.col("rank") == 1, "Primary driver")
        .when(F.col("rank") == 2, "Secondary driver")
        .otherwise("Monitor")
    )
    return (
        importance.withColumn("rank", F.row_number().over(order))
        .select("rank", "feature", "mentions", role.alias("role"))
        .orderBy("rank")
    )


def feature_insight(importance: DataFrame) -> DataFrame:
    """One sentence naming the one or two leading sensors."""
    ranked = feature_report(importance)
    names = ranked.agg(
        F.max(F.when(F.col("rank") == 1, title(F.col("feature")))).alias("first"),
        F.max(F.when(F.col("rank") == 2, title(F.col("feature")))).alias("second"),
    )
    first, second = F.col("first"), F.col("second")
    return names.select(
        F.when(first.isNull(), "No dominant feature pattern was detected in this run.")
        .when(second.isNull(), F.format_string("%s is the primary failure driver.", first))
        .otherwise(F.format_string("%s and %s are primary failure drivers.", first, second))
        .alias("insight")
    )


def risk_overview(scored: DataFrame, best: str) -> DataFrame:
    """Best model, high-risk readings among the top ten, mean health; no texts are made."""
    score = shown_score(F.col(f"{best}_score"))
    top = _leading(scored, best, fixed.TOP_ANOMALIES).agg(
        F.count_if(risk_level(score) == "HIGH RISK").alias("top_high_risk")
    )
    mean = scored.agg(F.avg(shown_health(health(F.col(f"{best}_score")))).alias("average_health"))
    # Two single rows side by side.
    return (
        top.withColumn("_one", F.lit(1))
        .join(mean.withColumn("_one", F.lit(1)), "_one")
        .select(title(F.lit(best)).alias("best_model"), "top_high_risk", "average_health")
    )
