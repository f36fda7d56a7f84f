"""Evaluate: metrics, ranking, explanations and reports of a scored split."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch import fixed
from millwatch.functions.rounding import round_exact
from millwatch.operators import evaluation, ranking
from millwatch.operators.stats import TrainStats, reference_table
from millwatch.sources.results import save_results
from millwatch.sources.tables import ResultTables, evaluation_rows, output_rows, utc_now


@dataclass(frozen=True)
class Results:
    """Everything a run reports, as frames over the scored rows."""

    scored: DataFrame
    stats: TrainStats
    models: Mapping[str, str]
    metrics: DataFrame
    best: str
    thresholds: Mapping[str, float]

    @cached_property
    def per_sample(self) -> DataFrame:
        return ranking.per_sample(self.scored, self.stats, self.best, list(self.models))

    @cached_property
    def importance(self) -> DataFrame:
        return ranking.feature_importance(self.scored, self.stats, self.best)

    @property
    def leaderboard(self) -> DataFrame:
        return evaluation.leaderboard(self.metrics)

    @property
    def ranking(self) -> DataFrame:
        return ranking.anomaly_ranking(self.scored, self.stats, self.best, list(self.models))

    def errors(self, limit: int = fixed.TOP_ERRORS) -> tuple[DataFrame, DataFrame]:
        return ranking.error_deep_dive(self.scored, self.stats, self.best, list(self.models), limit)

    def top(self, limit: int = fixed.TOP_ANOMALIES) -> DataFrame:
        return ranking.top_anomalies(self.scored, self.stats, self.best, list(self.models), limit)

    def predictions(self) -> DataFrame:
        return ranking.predictions_long(
            self.scored, self.stats, list(self.models), self.thresholds
        )

    def samples(self) -> DataFrame:
        return ranking.flatten_samples(self.per_sample, list(self.models))

    def reference_stats(self) -> DataFrame:
        return self.scored.sparkSession.createDataFrame(
            reference_table(self.stats), "feature_name string, mean double, std double"
        )

    def summary(self) -> DataFrame:
        return executive_summary(self.metrics, self.best, self.importance)


def executive_summary(metric_rows: DataFrame, best: str, importance: DataFrame) -> DataFrame:
    """One line: best model, its F1, rows scored, leading sensor."""
    top = ranking.feature_report(importance).agg(
        F.max(F.when(F.col("rank") == 1, F.col("feature"))).alias("top")
    )
    one = metric_rows.where(F.col("model_name") == best).withColumn("_one", F.lit(1))
    return one.join(top.withColumn("_one", F.lit(1)), "_one").select(
        F.format_string(
            fixed.SUMMARY_TEXT,
            F.col("display_name"),
            round_exact(F.col("f1"), 3),
            F.col("support"),
            F.coalesce(F.col("top"), F.lit(fixed.NO_DRIVER)),
        ).alias("executive_summary")
    )


def evaluate_scored(
    scored: DataFrame,
    stats: TrainStats,
    thresholds: Mapping[str, float],
    models: Mapping[str, str] = fixed.MODELS,
    status: Mapping[str, str] | None = None,
    notes: Mapping[str, str] | None = None,
) -> Results:
    """Compare the models; the report frames follow from the result.

    The metric rows, one per model, are computed once and kept as constants,
    since the choice of the best model and most reports read them.
    """
    measured = evaluation.metrics(scored, models, status, notes)
    rows = scored.sparkSession.createDataFrame(measured.collect(), measured.schema)
    best = evaluation.best_model(rows)
    return Results(scored, stats, models, rows, best, thresholds)


def store_results(
    results: Results, tables: ResultTables, run_id: str, batch_id: str, split: str = "test"
) -> None:
    """Append predictions, scores and metrics to their tables, all of them once for each run."""
    stamp = utc_now()
    with tables.commit(f"results {batch_id} {run_id} {split}") as done:
        if done:
            outputs = output_rows(results.predictions(), run_id, batch_id, stamp, split)
            for name in ("model_predictions", "anomaly_scores"):
                done.append(name, outputs)
            done.append("evaluation_results", evaluation_rows(results.metrics, run_id, batch_id, stamp))


def save_document(
    spark: SparkSession, results: Results, path: str, **about: object
) -> None:
    """The whole result as a folder of datasets."""
    false_positives, false_negatives = results.errors()
    frames = {
        "metrics": results.metrics,
        "leaderboard": results.leaderboard,
        "per_sample": results.per_sample,
        "feature_importance": results.importance.select("feature", "mentions"),
        "anomaly_score_ranking": results.ranking,
        "false_positive_deep_dive": false_positives,
        "false_negative_deep_dive": false_negatives,
        "reference_stats": results.reference_stats(),
        "executive_summary": results.summary(),
    }
    save_results(spark, path, frames, {**about, "best_model": results.best})


def report_tables(results: Results) -> dict[str, DataFrame]:
    """The report's sections as frames."""
    false_positives, false_negatives = results.errors()
    errors = false_positives.withColumn("kind", F.lit("false positive")).unionByName(
        false_negatives.withColumn("kind", F.lit("false negative"))
    )
    return {
        "leaderboard": evaluation.metric_table(results.metrics),
        "fault_summary": evaluation.fault_summary(results.scored, results.models),
        "anomaly_ranking": results.top(),
        "feature_report": ranking.feature_report(results.importance),
        "error_deep_dive": errors,
        "executive_summary": results.summary(),
    }
