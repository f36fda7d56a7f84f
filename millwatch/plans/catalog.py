"""Named queries over the given tables, one per operator or group of operators.

Each takes a session and a folder of Parquet tables and returns a frame.  The
deterministic ones have an equivalent SQL text in ``oracle``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch import fixed
from millwatch.functions.rounding import round_scaled
from millwatch.functions.scalar import (
    health, health_band, iso_second, label_text, nan_to_null, risk_level, shown_health,
    shown_score, title,
)
from millwatch.operators import evaluation, preview, ranking
from millwatch.operators.deviations import deviations, explanation
from millwatch.operators.detectors.forest import draw_samples, grow_forest, grow_trees, tree_depth
from millwatch.operators.detectors.recon import fit_recon, moments
from millwatch.operators.detectors.rule import batch_maxima, fit_rule, score_rules
from millwatch.operators.detectors.sequence import fit_sequence, score_sequence, with_windows
from millwatch.operators.normalize import label_of, number_of
from millwatch.operators.quantiles import exact_quantiles
from millwatch.operators.split import chronological_split, split_sizes
from millwatch.operators.stats import SCALED, impute, normal_rows
from millwatch.plans.evaluate import (
    Results, evaluate_scored, report_tables, save_document, store_results,
)
from millwatch.plans.ingest import ingest
from millwatch.plans.prepare import Prepared, prepare, prepare_readings
from millwatch.plans.run import run
from millwatch.plans.train import (
    calibrate, fit_detectors, freeze, load_detectors, save_detectors, score_saved, train_and_score,
)
from millwatch.session import stage, staging_path
from millwatch.sources import adapters
from millwatch.sources.csv_source import export_test_csv, load_csv
from millwatch.sources.results import load_results
from millwatch.sources.tables import ResultTables
from millwatch.streaming.scoring import write_scores

Query = Callable[[SparkSession, str], DataFrame]

# Rules of different strictness: deterministic stand-ins for several detectors.
VARIANTS = {"sigma_1_5": 1.5, "sigma_2_5": 2.5, "sigma_4": 4.0, "sigma_6": 6.0}
VARIANT_NAMES = {name: f"Rule {sigma}" for name, sigma in VARIANTS.items()}
SENSORS = adapters.EVENT_SENSORS
KEYS = ("sample_id", "machine_id", "split")

_REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    _REGISTRY[function.__name__] = function
    return function


def catalog() -> dict[str, Query]:
    from millwatch.plans import catalog_checks  # noqa: F401  registers its queries here

    return dict(_REGISTRY)


def _round(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


def _events(spark: SparkSession, folder: str) -> Prepared:
    return prepare_readings(adapters.sensor_events(spark, folder), SENSORS)


def _gappy(spark: SparkSession, folder: str) -> Prepared:
    return prepare_readings(adapters.sensor_events_gappy(spark, folder), SENSORS)


def _lines(spark: SparkSession, folder: str) -> Prepared:
    return prepare_readings(adapters.sensor_lines(spark, folder), SENSORS)


def _variants(prepared: Prepared) -> DataFrame:
    """The test split scored by all rule variants, at 6 digits."""
    rules = {name: fit_rule(prepared.stats, sigma) for name, sigma in VARIANTS.items()}
    scored = score_rules(prepared.test, rules)
    return scored.withColumns({f"{n}_score": round_scaled(F.col(f"{n}_raw"), 6) for n in rules})


def _results(prepared: Prepared) -> Results:
    scored = stage(
        _variants(prepared).drop(*[f"{n}_raw" for n in VARIANTS]), "scored"
    )
    thresholds = dict.fromkeys(VARIANTS, fixed.SCORE_THRESHOLD)
    return evaluate_scored(scored, prepared.stats, thresholds, VARIANT_NAMES)


# ---- readings ------------------------------------------------------------


@query
def readings_events(spark: SparkSession, folder: str) -> DataFrame:
    df = adapters.sensor_events(spark, folder)
    return _round(df.withColumn("timestamp", iso_second(F.col("timestamp"))), 6, "tool_wear")


@query
def readings_lines(spark: SparkSession, folder: str) -> DataFrame:
    df = adapters.sensor_lines(spark, folder)
    return df.withColumn("timestamp", iso_second(F.col("timestamp")))


@query
def aliased_columns(spark: SparkSession, folder: str) -> DataFrame:
    batch = ingest(adapters.sensor_events_text(spark, folder), id_column="row id")
    return _round(
        batch.readings.withColumn("timestamp", iso_second(F.col("timestamp"))), 6, *SENSORS
    )


@query
def column_renames(spark: SparkSession, folder: str) -> DataFrame:
    """Renames found on the text table, with the rows they apply to."""
    batch = ingest(adapters.sensor_events_text(spark, folder), id_column="row id")
    named = F.create_map(*[F.lit(x) for pair in batch.renamed.items() for x in pair])
    return batch.readings.agg(F.count(F.lit(1)).alias("rows")).select(
        F.explode(named).alias("original", "canonical"), "rows"
    )


@query
def timeline_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Neither machine nor time given: default machine, generated timeline."""
    events = spark.read.parquet(f"{folder}/events.parquet").select(
        (F.col("event_id") + 1).alias("n"), F.col("value").alias("Vibe")
    )
    batch = ingest(events, order=["n"])
    return batch.readings.select(
        "sample_id", "machine_id", iso_second(F.col("timestamp")).alias("timestamp"),
        "vibration", "failure_label",
    )


@query
def label_words(spark: SparkSession, folder: str) -> DataFrame:
    """Text labels by word, numeric texts by sign."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    words = F.array(*map(F.lit, ("yes", "No", " TRUE ", "anomaly", "2", "1", "Fail", "ok")))
    place = (F.col("event_id") % 9).cast("int")
    texts = events.select(
        "event_id",
        F.when(place < 8, F.get(words, place)).alias("text_label"),
        F.when(place < 8, (place - 3).cast("string")).alias("number_label"),
        ((place - 4) / 2).alias("double_label"),
        (place == 5).alias("flag_label"),
    )
    names = ("text_label", "number_label", "double_label", "flag_label")
    return texts.select("event_id", *[label_of(texts, n).cast("long").alias(n) for n in names])


@query
def numeric_coercion(spark: SparkSession, folder: str) -> DataFrame:
    """Sensor texts to numbers: bad texts, NaN and missing become null."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    place = F.col("event_id") % 7
    text = (
        F.when(place == 0, F.lit("bad"))
        .when(place == 1, F.lit("nan"))
        .when(place == 2, F.lit("7d"))
        .when(place == 3, F.lit(" 1e3 "))
        .when(place == 4, F.lit(".5"))
        .when(place == 5, F.lit(None))
        .otherwise(F.col("value").cast("string"))
    )
    texts = events.select("event_id", text.alias("reading"))
    return texts.select(
        "event_id", number_of(F.col("reading"), texts.schema["reading"].dataType).alias("reading")
    )


@query
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Write the text table as CSV and ingest it from there."""
    path = staging_path(spark, "csv")
    adapters.sensor_events_text(spark, folder).write.option("header", True).csv(path)
    batch = ingest(load_csv(spark, path), id_column="row id")
    return _round(
        batch.readings.withColumn("timestamp", iso_second(F.col("timestamp"))), 6, *SENSORS
    )


@query
def null_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Missing-value texts of a CSV, counted per event type."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    tokens = F.array(*map(F.lit, ("NA", "N/A", "null", "None", "-nan", "#N/A")))
    place = (F.col("event_id") % 8).cast("int")
    path = staging_path(spark, "csv")
    events.select(
        "event_type",
        F.when(place < 6, F.get(tokens, place)).otherwise(F.col("value").cast("string")).alias("v"),
    ).write.option("header", True).csv(path)
    return load_csv(spark, path).groupBy("event_type").agg(
        F.count("v").alias("present"), F.count_if(F.col("v").isNull()).alias("missing")
    )


@query
def file_row_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Line numbers of a CSV written in event order: equal to the order written."""
    path = staging_path(spark, "csv")
    spark.read.parquet(f"{folder}/events.parquet").select("event_id").orderBy(
        "event_id"
    ).write.option("header", True).csv(path)
    lines = load_csv(spark, path, row_number="sample_id")
    return lines.select("sample_id", F.col("event_id").cast("long").alias("event_id"))


@query
def preview_counts(spark: SparkSession, folder: str) -> DataFrame:
    return preview.preview_counts(adapters.sensor_events_text(spark, folder))


@query
def preview_rows(spark: SparkSession, folder: str) -> DataFrame:
    first = preview.preview_rows(adapters.sensor_events(spark, folder), ["sample_id"])
    return first.select("sample_id", "machine_id", "torque", "vibration", "failure_label")


@query
def class_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.class_distribution(adapters.sensor_events(spark, folder))


# ---- split, gaps, scaling ------------------------------------------------


def _split_rows(readings: DataFrame) -> DataFrame:
    return chronological_split(readings).select(*KEYS, "split_position")


@query
def chrono_split_events(spark: SparkSession, folder: str) -> DataFrame:
    return _split_rows(adapters.sensor_events(spark, folder))


@query
def chrono_split_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _split_rows(adapters.sensor_lines(spark, folder))


@query
def split_size_counts(spark: SparkSession, folder: str) -> DataFrame:
    return split_sizes(chronological_split(adapters.sensor_events(spark, folder)))


@query
def short_timelines(spark: SparkSession, folder: str) -> DataFrame:
    """Order keys as machines: timelines of one to a few rows, all split edges."""
    orders = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        F.col("l_orderkey").cast("string").alias("machine_id"),
        F.col("l_shipdate").alias("timestamp"),
        F.xxhash64("*").alias("sample_id"),
    )
    return split_sizes(chronological_split(orders))


@query
def hot_machine_split(spark: SparkSession, folder: str) -> DataFrame:
    """All events on one machine, with small cells: the path of a hot machine."""
    hot = adapters.sensor_events(spark, folder).withColumn("machine_id", F.lit("M-001"))
    return chronological_split(hot, group_rows=500).select(*KEYS, "split_position")


@query
def hot_machine_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Trailing windows of one machine cut into small chunks."""
    hot = adapters.sensor_events(spark, folder).withColumn("machine_id", F.lit("M-001"))
    rows = with_windows(chronological_split(hot, group_rows=500), ("torque",), group_rows=300)
    entry = F.transform("window", lambda r: r[0].cast("long").cast("string"))
    return rows.select(*KEYS, F.array_join(entry, " ").alias("window"))


@query
def bracketed_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact quantiles found by bracketing, as for columns of any size."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    names = ("l_quantity", "l_extendedprice", "l_discount")
    found = exact_quantiles(
        lines, {name: [0.25, 0.5, 0.95] for name in names}, gathered_values=200
    )
    wide = lines.agg(F.count(F.lit(1)).alias("rows"))
    parts = [
        F.struct(
            F.lit(name).alias("column"),
            *[F.round(F.lit(v), 4).alias(q) for q, v in zip(("q25", "q50", "q95"), found[name])],
        )
        for name in names
    ]
    return wide.select(F.inline(F.array(*parts)), "rows")


@query
def train_medians(spark: SparkSession, folder: str) -> DataFrame:
    prepared = _gappy(spark, folder)
    return prepared.statistics().select("feature_name", F.round("median", 4).alias("median"))


@query
def imputed_gaps(spark: SparkSession, folder: str) -> DataFrame:
    prepared = _gappy(spark, folder)
    return _round(prepared.frame.select(*KEYS, *SENSORS), 6, *SENSORS)


def _statistics(prepared: Prepared) -> DataFrame:
    return _round(prepared.statistics(), 4, "mean", "std", "min", "max", "median")


@query
def feature_statistics_events(spark: SparkSession, folder: str) -> DataFrame:
    return _statistics(_gappy(spark, folder))


@query
def feature_statistics_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _statistics(_lines(spark, folder))


@query
def scaled_features(spark: SparkSession, folder: str) -> DataFrame:
    names = [SCALED.format(name) for name in SENSORS]
    return _round(_lines(spark, folder).frame.select(*KEYS, *names), 4, *names)


def _reference(prepared: Prepared) -> DataFrame:
    train = normal_rows(prepared.train, prepared.stats)
    spread = prepared.stats.reference_stds
    wide = train.agg(
        *[
            F.struct(
                F.lit(name).alias("feature_name"),
                F.round(F.lit(prepared.stats.reference_means[name]), 4).alias("mean"),
                F.round(F.lit(spread[name]), 4).alias("std"),
                F.count(F.lit(1)).alias("rows"),
            ).alias(name)
            for name in prepared.features
        ]
    )
    return wide.select(F.inline(F.array(*prepared.features)))


@query
def reference_stats_events(spark: SparkSession, folder: str) -> DataFrame:
    return _reference(_events(spark, folder))


@query
def reference_stats_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _reference(_lines(spark, folder))


@query
def contamination_rate(spark: SparkSession, folder: str) -> DataFrame:
    prepared = _lines(spark, folder)
    return prepared.train.agg(F.count(F.lit(1)).alias("train_rows")).withColumn(
        "contamination", F.round(F.lit(prepared.stats.contamination), 6)
    )


@query
def lag_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Trailing windows of eight readings, one text per reading."""
    prepared = _events(spark, folder)
    rows = with_windows(prepared.frame, ("torque", "vibration"))
    entry = F.transform(
        "window", lambda r: F.concat(r[0].cast("long").cast("string"), F.lit(":"), F.round(r[1] * 100).cast("long").cast("string"))
    )
    return rows.select(*KEYS, F.array_join(entry, " ").alias("window"))


# ---- rule scores and evaluation ------------------------------------------


def _rule_rows(prepared: Prepared) -> DataFrame:
    scored = score_rules(prepared.test, {"rule": fit_rule(prepared.stats)})
    score = F.col("score")
    return scored.withColumn("score", round_scaled(F.col("rule_raw"), 6)).select(
        "sample_id", "machine_id", "score", "rule_prediction",
        health(score).alias("health"),
        shown_health(health(score)).alias("shown_health"),
        health_band(health(score)).alias("band"),
        shown_score(score).alias("shown_score"),
        risk_level(shown_score(score)).alias("risk"),
        label_text(F.col("rule_prediction")).alias("predicted_label"),
        label_text(F.col("failure_label")).alias("true_label"),
    )


@query
def rule_scores_events(spark: SparkSession, folder: str) -> DataFrame:
    return _rule_rows(_events(spark, folder))


@query
def rule_scores_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _rule_rows(_lines(spark, folder))


def _frozen_rule(prepared: Prepared, readings: DataFrame) -> DataFrame:
    """Rule scores of other readings, in units of the test split."""
    rules = {"rule": fit_rule(prepared.stats)}
    scored = score_rules(impute(readings, prepared.medians), rules, batch_maxima(prepared.test, rules))
    return scored.select(
        "sample_id", "machine_id", round_scaled(F.col("rule_raw"), 6).alias("score"),
        "rule_prediction",
    )


@query
def frozen_rule_scores(spark: SparkSession, folder: str) -> DataFrame:
    """All readings with gaps, scored by fitted values alone."""
    return _frozen_rule(_gappy(spark, folder), adapters.sensor_events_gappy(spark, folder))


@query
def streamed_rule_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The same readings as a stream of files, scored as they come."""
    source = stage(adapters.sensor_events_gappy(spark, folder), "stream")
    stream = spark.readStream.schema(source.schema).parquet(source.inputFiles()[0].rsplit("/", 1)[0])
    path = staging_path(spark, "stream-scores")
    scores = _frozen_rule(_gappy(spark, folder), stream)
    write_scores(scores, path, staging_path(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(path)


@query
def batch_maximum(spark: SparkSession, folder: str) -> DataFrame:
    """Excess over the sigma limit: rows beyond it and the batch maximum."""
    prepared = _lines(spark, folder)
    excess = fit_rule(prepared.stats).excess()
    return prepared.test.agg(
        F.count_if(excess > 0).alias("rows_beyond"),
        F.round(F.greatest(F.max(excess), F.lit(1.0)), 6).alias("batch_maximum"),
    )


def _metric_rows(prepared: Prepared) -> DataFrame:
    rows = evaluation.metrics(_variants(prepared), VARIANT_NAMES).drop("model_order")
    return _round(rows, 6, *evaluation.METRICS)


@query
def variant_metrics_events(spark: SparkSession, folder: str) -> DataFrame:
    return _metric_rows(_events(spark, folder))


@query
def variant_metrics_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _metric_rows(_lines(spark, folder))


@query
def roc_curves(spark: SparkSession, folder: str) -> DataFrame:
    curve = evaluation.roc_curve(_variants(_lines(spark, folder)), list(VARIANTS))
    return curve.withColumn("threshold", F.when(F.col("threshold") <= 1, F.col("threshold")))


@query
def roc_points(spark: SparkSession, folder: str) -> DataFrame:
    curve = evaluation.roc_curve(_variants(_lines(spark, folder)), list(VARIANTS), False)
    return curve.withColumn("threshold", F.when(F.col("threshold") <= 1, F.col("threshold")))


@query
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.confusion(_variants(_lines(spark, folder)), "sigma_2_5")


@query
def score_histogram(spark: SparkSession, folder: str) -> DataFrame:
    rows = evaluation.score_histogram(_variants(_events(spark, folder)), list(VARIANTS))
    return _round(rows, 6, "bin_start")


@query
def fault_summary(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.fault_summary(_variants(_events(spark, folder)), VARIANT_NAMES)


@query
def leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    results = _results(_lines(spark, folder))
    table = evaluation.metric_table(results.metrics)
    return table.withColumn("best", F.col("model") == VARIANT_NAMES[results.best])


@query
def f1_chart(spark: SparkSession, folder: str) -> DataFrame:
    return _round(evaluation.f1_chart(_results(_lines(spark, folder)).metrics), 6, "f1")


# ---- ranking, explanations, reports --------------------------------------


@query
def top_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    return _results(_events(spark, folder)).top()


@query
def anomaly_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return _results(_events(spark, folder)).ranking


@query
def model_ranks(spark: SparkSession, folder: str) -> DataFrame:
    rows = _results(_lines(spark, folder)).predictions()
    return rows.select("sample_id", "machine_id", "model_name", "anomaly_score", "rank")


@query
def predictions_long(spark: SparkSession, folder: str) -> DataFrame:
    rows = _results(_events(spark, folder)).predictions()
    return rows.drop("timestamp")


@query
def error_deep_dive(spark: SparkSession, folder: str) -> DataFrame:
    results = _results(_events(spark, folder))
    parts = zip(("false positive", "false negative"), results.errors())
    first, second = [
        rows.select(
            F.lit(kind).alias("kind"), "sample_id", "machine_id",
            F.col("scores")[results.best].alias("score"),
            F.array_join("top_features", ", ").alias("top_features"), "explanation",
        )
        for kind, rows in parts
    ]
    return first.unionByName(second)


@query
def sample_records(spark: SparkSession, folder: str) -> DataFrame:
    """Per-reading records, flattened."""
    results = _results(_events(spark, folder))
    return results.samples().withColumn("timestamp", iso_second(F.col("timestamp")))


@query
def sample_table(spark: SparkSession, folder: str) -> DataFrame:
    results = _results(_events(spark, folder))
    return ranking.sample_table(results.samples(), results.best, list(VARIANTS))


@query
def predictions_wide(spark: SparkSession, folder: str) -> DataFrame:
    results = _results(_events(spark, folder))
    wide = ranking.predictions_wide(results.scored, list(VARIANTS))
    kept = [c for c in wide.columns if c.startswith("sigma")]
    return wide.select("sample_id", "machine_id", "failure_label", *kept)


@query
def filter_modes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every display filter, tagged with its name."""
    results = _results(_events(spark, folder))
    wide = results.samples().select(
        "sample_id", "machine_id", "true_label", f"{results.best}_flag"
    )
    parts = [
        ranking.filter_samples(wide, results.best, mode).select(
            F.lit(mode).alias("mode"), "sample_id", "machine_id"
        )
        for mode in ranking.FILTER_MODES
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


@query
def signal_rows(spark: SparkSession, folder: str) -> DataFrame:
    results = _results(_events(spark, folder))
    return ranking.signal_rows(results.scored, results.best).select("sample_id", "machine_id")


@query
def row_deviations(spark: SparkSession, folder: str) -> DataFrame:
    prepared = _lines(spark, folder)
    return prepared.test.select(
        "sample_id", "machine_id", F.posexplode(deviations(prepared.stats)).alias("place", "d")
    ).select("sample_id", "machine_id", (F.col("place") + 1).alias("place"), "d.feature", "d.z_score")


@query
def explanations(spark: SparkSession, folder: str) -> DataFrame:
    prepared = _lines(spark, folder)
    scored = _variants(prepared).withColumn("entries", deviations(prepared.stats))
    return scored.select(
        "sample_id", "machine_id",
        explanation(
            F.col("sigma_2_5_score"), F.col("sigma_2_5_prediction"), F.col("entries"), len(SENSORS)
        ).alias("explanation"),
    )


@query
def feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    results = _results(_lines(spark, folder))
    return results.importance.select("feature", "mentions", "first_seen.sample_id")


@query
def feature_report(spark: SparkSession, folder: str) -> DataFrame:
    report = ranking.feature_report(_results(_lines(spark, folder)).importance)
    return report.withColumn("shown_name", title(F.col("feature")))


@query
def feature_insight(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.feature_insight(_results(_lines(spark, folder)).importance)


@query
def risk_overview(spark: SparkSession, folder: str) -> DataFrame:
    results = _results(_events(spark, folder))
    return _round(ranking.risk_overview(results.scored, results.best), 4, "average_health")


@query
def executive_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _results(_lines(spark, folder)).summary()


# ---- tables and SQL ------------------------------------------------------


def _stored(spark: SparkSession, folder: str, stage_name: str = "evaluated") -> ResultTables:
    """The tables as a run of the rule variants fills them, up to a stage."""
    tables = ResultTables(spark, staging_path(spark, "tables"))
    if stage_name == "evaluated":
        tables.create()
    batch = ingest(
        adapters.sensor_events_gappy(spark, folder), "events", id_column="sample_id",
        tables=tables, batch_id="batch",
    )
    if stage_name != "ingested":
        prepared = prepare(batch, tables, "run")
    if stage_name == "evaluated":
        store_results(_results(prepared), tables, "run", "batch")
    return tables


@query
def raw_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = _stored(spark, folder, "ingested").table("raw_sensor_records")
    field = lambda name: F.get_json_object("raw_payload", f"$.{name}")
    return rows.select(
        "batch_id", "sample_id", "source_file", "machine_id",
        iso_second(F.col("timestamp")).alias("timestamp"),
        "air_temperature", "torque", "vibration", "failure_label",
        field("timestamp").alias("payload_timestamp"),
        field("torque").cast("double").alias("payload_torque"),
    )


@query
def cleaned_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = _stored(spark, folder, "prepared").table("cleaned_sensor_records")
    return rows.select(
        "batch_id", "split_name", "sample_id", "machine_id", "missing_columns",
        F.round("vibration", 4).alias("vibration"),
        F.round(
            F.get_json_object("scaled_payload", "$.vibration").cast("double"), 4
        ).alias("scaled_vibration"),
    )


@query
def scores_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = _stored(spark, folder).table("anomaly_scores")
    return rows.drop("created_at")


@query
def predictions_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = _stored(spark, folder).table("model_predictions")
    return rows.drop("created_at")


@query
def evaluation_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = _stored(spark, folder).table("evaluation_results")
    field = lambda name: F.get_json_object("summary_json", f"$.{name}")
    return _round(
        rows.select(
            "run_id", "batch_id", "model_name", *evaluation.METRICS, "support", "flagged_count",
            "verdict", field("status").alias("summary_status"),
            field("f1").cast("double").alias("summary_f1"),
        ),
        6, *evaluation.METRICS, "summary_f1",
    )


@query
def statistics_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = _stored(spark, folder, "prepared").table("feature_statistics").drop("created_at")
    return _round(rows, 4, "mean", "std", "min", "max", "median")


@query
def table_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _stored(spark, folder).counts()


@query
def sql_over_tables(spark: SparkSession, folder: str) -> DataFrame:
    """SQL with parameters over the stored tables."""
    return _stored(spark, folder).query(
        "SELECT p.model_name, count(*) AS flagged, round(avg(s.anomaly_score), 4) AS mean_score "
        "FROM model_predictions p JOIN anomaly_scores s "
        "ON p.sample_id = s.sample_id AND p.model_name = s.model_name AND p.run_id = s.run_id "
        "WHERE p.predicted_label = ? AND p.batch_id = ? GROUP BY p.model_name",
        [1, "batch"],
    )


@query
def results_document(spark: SparkSession, folder: str) -> DataFrame:
    """Save the result folder, load it again, return its ranking."""
    path = staging_path(spark, "document")
    results = _results(_events(spark, folder))
    save_document(spark, results, path, run_id="run")
    frames, about = load_results(spark, path)
    return frames["anomaly_score_ranking"].withColumn("model", F.lit(about["best_model"]))


@query
def test_split_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The cleaned test split, exported as CSV and read back."""
    path = staging_path(spark, "export")
    export_test_csv(_gappy(spark, folder).frame, path)
    rows = load_csv(spark, path)
    return rows.select(
        F.col("sample_id").cast("long").alias("sample_id"), "machine_id", "timestamp",
        *[F.round(F.col(name).cast("double"), 6).alias(name) for name in SENSORS],
        F.col("failure_label").cast("long").alias("failure_label"),
    )


# ---- detectors -----------------------------------------------------------


@query
def recon_moments(spark: SparkSession, folder: str) -> DataFrame:
    """Covariances the reconstruction detector is fitted on."""
    prepared = _lines(spark, folder)
    names = [SCALED.format(name) for name in SENSORS]
    normal = normal_rows(prepared.train, prepared.stats)
    _, covariance = moments(normal, names)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    return normal.agg(F.count(F.lit(1)).alias("rows")).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(SENSORS[i]).alias("one"), F.lit(SENSORS[j]).alias("other"),
                        F.round(F.lit(float(covariance[i, j])), 4).alias("covariance"),
                    )
                    for i, j in pairs
                ]
            )
        ),
        "rows",
    )


def _recon_rows(prepared: Prepared) -> DataFrame:
    names = [SCALED.format(name) for name in SENSORS]
    normal = normal_rows(prepared.train, prepared.stats)
    model = fit_recon(normal, names)
    raw = stage(normal.select(model.raw().alias("recon")), "calibration")
    ends = raw.agg(F.min("recon"), F.max("recon")).first()
    limit = exact_quantiles(raw, {"recon": [fixed.RECON_QUANTILE]})["recon"][0]
    model = replace(model, low=ends[0], high=ends[1], limit=limit)
    return prepared.test.select(
        "sample_id", "machine_id",
        F.round(model.score(model.raw()), 4).alias("score"),
        model.predict(model.raw()).alias("prediction"),
        F.lit(round(model.threshold, 4)).alias("threshold"),
    )


@query
def recon_scores_events(spark: SparkSession, folder: str) -> DataFrame:
    return _recon_rows(_events(spark, folder))


@query
def recon_scores_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _recon_rows(_lines(spark, folder))


@query
def score_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """Range and quantiles of the rule excess over normal train rows."""
    prepared = _lines(spark, folder)
    rows = normal_rows(prepared.train, prepared.stats).select(
        fit_rule(prepared.stats, 0.0).excess().alias("raw")
    )
    limit = exact_quantiles(rows, {"raw": [fixed.RECON_QUANTILE, fixed.FOREST_QUANTILE_CAP]})
    return rows.agg(
        F.round(F.min("raw"), 4).alias("low"), F.round(F.max("raw"), 4).alias("high")
    ).withColumns(
        {
            "q95": F.round(F.lit(limit["raw"][0]), 4),
            "q99": F.round(F.lit(limit["raw"][1]), 4),
        }
    )


@query
def nan_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Readings whose ratio is undefined, as null."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    torque = F.get_json_object("props", "$.k").cast("double")
    ratio = F.when(torque == 0, F.lit(float("nan"))).otherwise(F.col("value") / torque)
    return events.select("event_id", nan_to_null(ratio).alias("ratio"))


@query
def forest_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of all trees; random by seed, so without SQL."""
    prepared = _events(spark, folder)
    names = [SCALED.format(name) for name in SENSORS]
    rows, sample = prepared.stats.normal_rows, fixed.FOREST_SAMPLE
    drawn = draw_samples(
        normal_rows(prepared.train, prepared.stats), names, rows, fixed.FOREST_TREES, sample,
        fixed.SEED,
    )
    return grow_trees(drawn, names, tree_depth(sample), fixed.SEED)


@query
def forest_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Forest scores of the test split, calibrated on train."""
    prepared = _events(spark, folder)
    names = [SCALED.format(name) for name in SENSORS]
    normal = normal_rows(prepared.train, prepared.stats)
    forest = grow_forest(normal, names, prepared.stats.normal_rows, prepared.stats.contamination)
    forest, _ = calibrate(forest, fit_recon(normal, names), normal)
    raw = prepared.test.withColumn("raw", forest.raw(spark))
    return raw.select(
        "sample_id", "machine_id", round_scaled(forest.score(F.col("raw")), 6).alias("score"),
        forest.predict(F.col("raw")).alias("prediction"),
    )


@query
def sequence_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Failure probability of the test split from trailing windows."""
    prepared = _events(spark, folder)
    names = [SCALED.format(name) for name in SENSORS]
    model = fit_sequence(prepared.train, names, prepared.stats.classes)
    scored = score_sequence(prepared.test, model, "sequence")
    return scored.select(
        "sample_id", "machine_id", round_scaled(F.col("sequence_raw"), 6).alias("score"),
        F.col("sequence_prediction").alias("prediction"),
    )


@query
def saved_detectors(spark: SparkSession, folder: str) -> DataFrame:
    """Fit, save, load, score all readings anew with a frozen rule unit."""
    prepared = _events(spark, folder)
    path = staging_path(spark, "detectors")
    save_detectors(spark, freeze(fit_detectors(prepared), prepared.test), path)
    scored = score_saved(adapters.sensor_events(spark, folder), load_detectors(spark, path))
    return scored.drop("timestamp")


@query
def full_run(spark: SparkSession, folder: str) -> DataFrame:
    """Text table to metrics of the four detectors."""
    done = run(
        spark, adapters.sensor_events_text(spark, folder), ingest_options={"id_column": "row id"}
    )
    return done.results.metrics


@query
def full_report(spark: SparkSession, folder: str) -> DataFrame:
    """The four detectors on the larger table, as leaderboard text."""
    prepared = _lines(spark, folder)
    detectors, scored = train_and_score(prepared)
    results = evaluate_scored(
        scored, prepared.stats, detectors.thresholds,
        status=detectors.status, notes=detectors.notes,
    )
    return report_tables(results)["leaderboard"]
