"""Queries on edges, on six sensors and on what the learnt detectors must hold to.

The forest and the sequence detector are random by seed, so SQL cannot give
their scores; what follows from the data alone is stated here as rows that it can.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch import fixed
from millwatch.functions.rounding import round_scaled
from millwatch.operators import evaluation
from millwatch.operators.detectors.bottleneck import fit_bottleneck
from millwatch.operators.detectors.forest import draw_samples, grow_forest, grow_trees, tree_depth
from millwatch.operators.detectors.recon import fit_recon, moments
from millwatch.operators.detectors.rule import fit_rule, score_rules
from millwatch.operators.detectors.sequence import fit_recurrent, fit_sequence, score_sequence, with_windows
from millwatch.operators.deviations import deviations, explanation
from millwatch.operators.ids import repeated_id
from millwatch.operators.normalize import column_warnings
from millwatch.operators.ordering import seconds_of, with_positions, with_previous
from millwatch.operators.quantiles import exact_quantiles
from millwatch.operators.running import RunningStatistics
from millwatch.operators.split import chronological_split
from millwatch.operators.stats import SCALED, normal_rows
from millwatch.plans.catalog import SENSORS, _results, query
from millwatch.plans.evaluate import evaluate_scored, report_tables, store_results
from millwatch.plans.ingest import ingest
from millwatch.plans.prepare import Prepared, prepare, prepare_readings
from millwatch.plans.train import (
    MODELS, calibrate, fit_detectors, freeze, inference_table, load_detectors, save_detectors, score_detectors,
    score_saved, train_and_score,
)
from millwatch.plans.run import run
from millwatch.session import stage, staging_path
from millwatch.sources import adapters
from millwatch.sources.csv_source import load_csv
from millwatch.sources.records import text_lines
from millwatch.sources.results import load_results
from millwatch.sources.tables import ResultTables, cleaned_rows, utc_now
from millwatch.sources.timelines import store_timelines
from millwatch.streaming.scoring import write_scores
from millwatch.streaming.windows import stream_windows

SIX = adapters.SIX_SENSORS
_SCALED = [SCALED.format(name) for name in SENSORS]


def _events(spark: SparkSession, folder: str) -> Prepared:
    return prepare_readings(adapters.sensor_events(spark, folder), SENSORS)


# ---- order on awkward keys and times -------------------------------------


@query
def hot_machine_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Each event's previous value where machines and times are missing, one machine cut into cells."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    event_id = F.col("event_id")
    hot = F.when(event_id % 3 == 0, F.lit("M-001")).otherwise(F.col("user_id").cast("string"))
    holed = events.select(
        "event_id", "value",
        F.when(event_id % 11 != 0, hot).alias("machine_id"),
        F.when(event_id % 13 != 0, F.col("ts")).alias("moment"),
    )
    placed = with_previous(holed, "machine_id", "moment", "event_id", "value", "previous", 500)
    return placed.select("event_id", "machine_id", "previous")


@query
def bucketed_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Split and trailing windows of readings stored by machine, and the shuffles that their plan has."""
    path = staging_path(spark, "timelines")
    name = f"timelines_{path.rsplit('-', 1)[-1]}"
    stored = store_timelines(adapters.sensor_events(spark, folder), name, path, 8)
    rows = with_windows(chronological_split(stored), ("torque", "vibration"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    shuffles = len(re.findall(r"(?<!Broadcast)Exchange (hash|range|round)", plan, re.IGNORECASE))
    entry = F.transform(
        "window", lambda r: F.concat(r[0].cast("long").cast("string"), F.lit(":"), F.round(r[1] * 100).cast("long").cast("string"))
    )
    return rows.select("sample_id", "machine_id", "split", F.array_join(entry, " ").alias("window"), F.lit(shuffles).alias("shuffles"))


@query
def subsecond_order(spark: SparkSession, folder: str) -> DataFrame:
    """Places of all events on one machine within one thousandth of a second, in small cells."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    squeezed = events.select(
        "event_id", F.lit("M-001").alias("machine_id"),
        F.timestamp_add("MICROSECOND", F.col("event_id") * 7_919 % 997, start).alias("moment"),
    )
    placed = with_positions(squeezed, "machine_id", "moment", "event_id", 50)
    return placed.select("event_id", "position", "group_size")


# ---- ingest --------------------------------------------------------------


@query
def time_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The same times in five spellings, each read as a whole column."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    moment = F.col("ts").cast("timestamp_ntz")
    since = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), moment)
    spellings = {
        "iso": (F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), {}),
        "month_first": (F.date_format(moment, "MM/dd/yyyy HH:mm"), {}),
        "dotted": (F.date_format(moment, "dd.MM.yyyy HH:mm:ss"), {}),
        "given": (F.date_format(moment, "yyyyMMdd HHmmss"), {"time_format": "yyyyMMdd HHmmss"}),
        "epoch": (since * 1_000 + 7, {"epoch_unit": "ms"}),
    }
    rows = None
    for name, (spelling, options) in spellings.items():
        table = events.select("event_id", spelling.alias("time"), F.col("value").alias("vibration"))
        read = ingest(table, id_column="event_id", **options).readings
        part = read.select(F.lit(name).alias("spelling"), "sample_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@contextmanager
def _file_blocks(spark: SparkSession, size: int) -> Iterator[None]:
    """Files are read in blocks of about ``size`` bytes, as large ones are in blocks of many megabytes."""
    wanted = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@query
def quoted_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """All events written as CSV with line breaks inside quotes, read back in parallel in file order."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    note = F.concat_ws("\n", F.col("event_type"), F.concat(F.lit('"user", '), F.col("user_id").cast("string")), F.lit(""), F.col("props"))
    path = staging_path(spark, "quoted")
    written = events.select("event_id", note.alias("note"), F.col("value").cast("string").alias("value"))
    written.orderBy("event_id").write.options(header=True, quoteAll=True, escape='"').csv(path)
    with _file_blocks(spark, 65_536):
        blocks = text_lines(spark, path).agg(F.count_distinct("_file", "_start").alias("blocks"), F.count_distinct("_file").alias("files")).first()
        rows = load_csv(spark, path, row_number="number")
    return rows.select(
        F.col("event_id").cast("long").alias("event_id"), "note", F.col("value").cast("double").alias("value"), "number",
        F.lit(blocks["blocks"] > blocks["files"]).alias("files_split"),
    )


@query
def batch_notes(spark: SparkSession, folder: str) -> DataFrame:
    """What ingest has to say on a table of values alone, with the rows it concerns."""
    values = spark.read.parquet(f"{folder}/events.parquet").select("event_id", F.col("value").alias("Vibe"))
    batch = ingest(values, id_column="event_id")
    notes = F.array(*map(F.lit, [*column_warnings(values), *batch.notes]))
    return batch.readings.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(notes).alias("note"), "rows")


@query
def refusals(spark: SparkSession, folder: str) -> DataFrame:
    """What unfit tables are told: the message of each check, over all events less what the check asks for."""
    events = stage(adapters.sensor_events(spark, folder), "events")
    only_first = events.groupBy("machine_id").agg(F.min_by(F.struct(*events.columns), "sample_id").alias("r")).select("r.*")
    cases = {
        "no rows": lambda: ingest(events.where("sample_id < 0"), "events", id_column="sample_id"),
        "no sensors": lambda: ingest(events.drop(*SENSORS), id_column="sample_id"),
        "one sensor": lambda: prepare(ingest(events.drop("torque", "tool_wear"), id_column="sample_id")),
        "repeated ids": lambda: ingest(events.unionByName(events.where("sample_id = 7")), id_column="sample_id"),
        "unreadable ids": lambda: ingest(events.withColumn("sample_id", F.concat(F.lit("n"), "sample_id")), id_column="sample_id"),
        "unreadable times": lambda: ingest(events.withColumn("timestamp", F.lit("soon")), id_column="sample_id"),
        "empty split": lambda: prepare(ingest(only_first, id_column="sample_id")),
        "missing file": lambda: load_csv(spark, f"{folder}/no_such_table.csv"),
    }
    said = []
    for name, case in cases.items():
        try:
            case()
            said.append((name, ""))
        except (ValueError, AnalysisException) as error:
            said.append((name, "PATH_NOT_FOUND" if "PATH_NOT_FOUND" in str(error) else str(error)))
    messages = F.create_map(*[F.lit(x) for pair in said for x in pair])
    return events.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(messages).alias("check", "message"), "rows")


@query
def repeated_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Whether ids of all events repeat, and which of them, by bitmaps and by counting: as they are, and with one row twice."""
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_id")
    twice = events.unionByName(events.where("event_id = 123"))
    found = [
        F.struct(
            F.lit(name).alias("ids"), F.lit(way).alias("by_bitmap"),
            F.lit(repeated_id(table, F.col("event_id") * factor, way)).cast("long").alias("repeated"),
        )
        for name, table in (("as they are", events), ("one twice", twice))
        for way, factor in ((True, 1), (False, -1_000_003))
    ]
    return events.agg(F.count(F.lit(1)).alias("rows")).select(F.inline(F.array(*found)), "rows")


@query
def stamped_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of stored tables by whether their own ids and creation times are well formed."""
    tables = ResultTables(spark, staging_path(spark, "tables"))
    prepare(ingest(adapters.sensor_events(spark, folder), "events", id_column="sample_id", tables=tables), tables)
    parts = [
        tables.table(name).groupBy(
            F.lit(name).alias("table_name"),
            F.col("batch_id").rlike("^[0-9a-f]{12}$").alias("has_id"),
            F.col(stamp).rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00$").alias("has_stamp"),
        ).agg(
            F.count(F.lit(1)).alias("rows"), F.count_distinct("batch_id").alias("batches"),
            F.count_distinct(stamp).alias("stamps"),
        )
        for name, stamp in (
            ("raw_sensor_records", "ingested_at"), ("cleaned_sensor_records", "created_at"),
            ("feature_statistics", "created_at"),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def repeated_appends(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per table when a job breaks off between two tables, is tried again, and again after it is done."""
    tables = ResultTables(spark, staging_path(spark, "tables"))
    tables.create()
    for done in (False, True, True):
        batch = ingest(
            adapters.sensor_events_gappy(spark, folder), "events", id_column="sample_id", tables=tables, batch_id="batch"
        )
        if done:
            prepared = prepare(batch, tables, "run")
            store_results(_results(prepared), tables, "run", "batch")
            continue
        with suppress(InterruptedError), tables.commit("prepared batch run") as half:
            rows = prepare_readings(batch.readings, batch.features).frame
            half.append("cleaned_sensor_records", cleaned_rows(rows, batch.features, batch.missing, "batch", utc_now()))
            raise InterruptedError("between two tables")
    return tables.counts()


# ---- six sensors ---------------------------------------------------------


def _six(spark: SparkSession, folder: str) -> Prepared:
    return prepare_readings(adapters.sensor_lines_six(spark, folder), SIX)


@query
def six_sensor_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Rule scores on six sensors; the explanation names the three that deviate most."""
    prepared = _six(spark, folder)
    scored = score_rules(prepared.test, {"rule": fit_rule(prepared.stats)}).withColumns(
        {"score": round_scaled(F.col("rule_raw"), 6), "entries": deviations(prepared.stats)}
    )
    return scored.select(
        "sample_id", "machine_id", "score", "rule_prediction",
        explanation(F.col("score"), F.col("rule_prediction"), F.col("entries"), fixed.TOP_FEATURES).alias("explanation"),
    )


@query
def six_sensor_scaling(spark: SparkSession, folder: str) -> DataFrame:
    names = [SCALED.format(name) for name in SIX]
    frame = _six(spark, folder).frame
    return frame.select("sample_id", "split", *[F.round(name, 4).alias(name) for name in names])


@query
def six_sensor_statistics(spark: SparkSession, folder: str) -> DataFrame:
    rows = _six(spark, folder).statistics()
    return rows.withColumns({name: F.round(name, 4) for name in ("mean", "std", "min", "max", "median")})


@query
def six_sensor_moments(spark: SparkSession, folder: str) -> DataFrame:
    """The covariances that the reconstruction detector is fitted on."""
    prepared = _six(spark, folder)
    normal = normal_rows(prepared.train, prepared.stats)
    _, covariance = moments(normal, [SCALED.format(name) for name in SIX])
    entries = [
        F.struct(
            F.lit(one).alias("one"), F.lit(other).alias("other"),
            F.round(F.lit(float(covariance[i, j])), 4).alias("covariance"),
        )
        for i, one in enumerate(SIX)
        for j, other in enumerate(SIX[: i + 1])
    ]
    return normal.agg(F.count(F.lit(1)).alias("rows")).select(F.inline(F.array(*entries)), "rows")


@query
def six_sensor_table(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rows as stored: all six columns and the payload that holds them again."""
    tables = ResultTables(spark, staging_path(spark, "tables"))
    ingest(adapters.sensor_lines_six(spark, folder), "lines", id_column="sample_id", tables=tables, batch_id="batch")
    again = F.from_json("raw_payload", ", ".join(f"{name} string" for name in SIX))  # read once, not once for each sensor
    same = F.array(*[F.col("_again")[name].cast("double") for name in SIX]) == F.array(*map(F.col, SIX))
    rows = tables.table("raw_sensor_records").withColumn("_again", again)
    return rows.select("sample_id", *SIX, same.alias("payload_holds"))


@query
def running_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of all events from four batches, summed up one after another, with exact medians."""
    readings = stage(adapters.sensor_events_gappy(spark, folder), "readings")
    running = RunningStatistics(spark, staging_path(spark, "running"), SENSORS)
    for number in range(4):
        running.add(readings.where(F.pmod(F.xxhash64("machine_id"), F.lit(4)) == number), f"batch {number}")
    rows = running.statistics(running.medians(readings, 500))
    return rows.withColumns({name: F.round(name, 4) for name in ("mean", "std", "min", "max", "median")})


# ---- learnt detectors ----------------------------------------------------


@query
def forest_tree_totals(spark: SparkSession, folder: str) -> DataFrame:
    """What every tree must hold to: its rows differ, end in its leaves, and were cut apart."""
    prepared = _events(spark, folder)
    rows = prepared.stats.normal_rows
    sample = min(fixed.FOREST_SAMPLE, rows)
    normal = normal_rows(prepared.train, prepared.stats)
    drawn = stage(draw_samples(normal, _SCALED, rows, fixed.FOREST_TREES, sample, fixed.SEED), "drawn")
    nodes = grow_trees(drawn, _SCALED, tree_depth(sample), fixed.SEED)
    leaf = F.col("feature") < 0
    trees = nodes.groupBy("tree").agg(
        F.sum(F.when(F.col("node") == 0, F.col("rows"))).alias("root_rows"),
        F.sum(F.when(leaf, F.col("rows"))).alias("leaf_rows"),
        (F.count_if(leaf) - F.count_if(~leaf)).alias("spare_leaves"),
        (F.count_if(~leaf) > 20).alias("branched"),
    )
    return drawn.groupBy("tree").agg(F.count_distinct("sample_id").alias("drawn_rows")).join(trees, "tree")


@query
def forest_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Train scores about the flagging limit: it stands at its share of the rows, scores differ."""
    prepared = _events(spark, folder)
    normal = normal_rows(prepared.train, prepared.stats)
    forest = grow_forest(normal, _SCALED, prepared.stats.normal_rows, prepared.stats.contamination)
    forest, _ = calibrate(forest, fit_recon(normal, _SCALED), normal)
    raw = stage(normal.select(forest.raw(spark).alias("raw")), "raw")
    score = forest.score(F.col("raw"))
    found = raw.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("raw") > forest.limit).alias("above"),
        F.count_if(F.col("raw") >= forest.limit).alias("reached"),
        ((F.min(score) == 0) & (F.max(score) == 1)).alias("fills_range"),
        (F.count_distinct("raw") * 2 > F.count(F.lit(1))).alias("scores_differ"),
    )
    flagged = F.col("rows") - F.ceil(F.lit(forest.quantiles[0]) * (F.col("rows") - 1))
    return found.select(
        "rows", flagged.alias("flagged"), flagged.between(F.col("above"), F.col("reached")).alias("limit_holds"),
        "fills_range", "scores_differ",
    )


@query
def sequence_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Test scores of the sequence detector: probabilities, flagged from 0.5, better than chance."""
    prepared = _events(spark, folder)
    model = fit_sequence(prepared.train, _SCALED, prepared.stats.classes)
    scored = score_sequence(prepared.test, model, "lstm")
    scored = stage(scored.withColumn("lstm_score", round_scaled(F.col("lstm_raw"), 6)), "scored")
    area = evaluation.metrics(scored, {"lstm": fixed.MODELS["lstm"]}).first()["roc_auc"]
    flagged = (F.col("lstm_raw") >= fixed.SCORE_THRESHOLD).cast("int")
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("lstm_raw").between(0, 1)).alias("probabilities"),
        F.count_if(flagged == F.col("lstm_prediction")).alias("flags_agree"),
    ).withColumn("better_than_chance", F.lit(area is not None and area > 0.6))


@query
def recurrent_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Test scores of the recurrent cell: probabilities, flagged from 0.5, better than chance."""
    prepared = _events(spark, folder)
    model = fit_recurrent(prepared.train, _SCALED, prepared.stats.classes, prepared.stats.rows)
    scored = score_sequence(prepared.test, model, "lstm")
    scored = stage(scored.withColumn("lstm_score", round_scaled(F.col("lstm_raw"), 6)), "scored")
    area = evaluation.metrics(scored, {"lstm": fixed.MODELS["lstm"]}).first()["roc_auc"]
    flagged = (F.col("lstm_raw") >= fixed.SCORE_THRESHOLD).cast("int")
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("lstm_raw").between(0, 1)).alias("probabilities"),
        F.count_if(flagged == F.col("lstm_prediction")).alias("flags_agree"),
    ).withColumn("better_than_chance", F.lit(area is not None and area > 0.6))


@query
def bottleneck_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Train errors of the bottleneck network: the limit stands at its share of the rows, training lowered the mean."""
    prepared = _events(spark, folder)
    normal = normal_rows(prepared.train, prepared.stats)
    rows = prepared.stats.normal_rows
    start, model = (fit_bottleneck(normal, _SCALED, rows, iterations=n) for n in (0, fixed.NETWORK_ITERATIONS))
    raw = stage(normal.select(model.raw().alias("raw"), start.raw().alias("start")), "raw")
    limit = exact_quantiles(raw, {"raw": [fixed.RECON_QUANTILE]})["raw"][0]
    found = raw.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("raw") >= 0).alias("errors"),
        F.count_if(F.col("raw") > limit).alias("above"),
        F.count_if(F.col("raw") >= limit).alias("reached"),
        (F.avg("raw") < 0.7 * F.avg("start")).alias("learnt"),
    )
    flagged = F.col("rows") - F.ceil(F.lit(fixed.RECON_QUANTILE) * (F.col("rows") - 1))
    return found.select("rows", "errors", flagged.alias("flagged"), flagged.between(F.col("above"), F.col("reached")).alias("limit_holds"), "learnt")


@query
def streamed_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Trailing windows of all events on a stream, which arrive in four loads and up to an hour late."""
    readings = adapters.sensor_events(spark, folder)
    arrival = F.timestamp_add("SECOND", F.pmod(F.xxhash64("sample_id"), F.lit(3600)).cast("int"), F.col("timestamp"))
    coming = stage(readings.withColumn("_arrival", seconds_of(arrival)), "coming")
    first, last = coming.agg(F.min("_arrival"), F.max("_arrival")).first()
    load = F.least(F.floor((F.col("_arrival") - first) * 4 / (last - first + 1)), F.lit(3))
    source = staging_path(spark, "loads")
    for number in range(4):
        coming.where(load == number).drop("_arrival").repartition(1).write.parquet(f"{source}/{number}")
    ahead = F.lit("2100-01-01 00:00:00").cast("timestamp_ntz")  # a reading far ahead lets all others go
    readings.limit(1).withColumns({"timestamp": ahead, "machine_id": F.lit("end")}).write.parquet(f"{source}/4")
    stream = spark.readStream.schema(readings.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    path = staging_path(spark, "windows")
    windows = stream_windows(stream, ("torque", "vibration"), "2 hours")
    write_scores(windows, path, staging_path(spark, "window-state")).awaitTermination()
    entry = F.transform(
        "window", lambda r: F.concat(r[0].cast("long").cast("string"), F.lit(":"), F.round(r[1] * 100).cast("long").cast("string"))
    )
    return spark.read.parquet(path).select("sample_id", "machine_id", F.array_join(entry, " ").alias("window"))


@query
def sequence_skipped(spark: SparkSession, folder: str) -> DataFrame:
    """No failure in the labels: the sequence detector stands aside and scores nothing."""
    readings = adapters.sensor_events(spark, folder).withColumn("failure_label", F.lit(0))
    prepared = prepare_readings(readings, SENSORS)
    model = fit_sequence(prepared.train, _SCALED, prepared.stats.classes)
    return score_sequence(prepared.test, model, "lstm").select(
        "sample_id", "machine_id", F.col("lstm_raw").alias("score"), F.col("lstm_prediction").alias("prediction"),
        F.lit(model.status).alias("status"), F.lit(model.notes).alias("notes"),
    )


@query
def saved_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the test rows by saved and by fresh detectors: how far apart, for each model."""
    prepared = _events(spark, folder)
    path = staging_path(spark, "detectors")
    detectors = freeze(fit_detectors(prepared), prepared.test)
    save_detectors(spark, detectors, path)
    rows = prepared.test.select("sample_id", "machine_id", "timestamp", *SENSORS, "failure_label")
    names = [f"{model}_{what}" for model in MODELS for what in ("score", "prediction")]
    fresh = score_detectors(prepared.test, detectors).select("sample_id", *[F.col(n).alias(f"{n}_fresh") for n in names])
    both = score_saved(rows, load_detectors(spark, path)).join(fresh, "sample_id")
    return both.select("sample_id", "machine_id", *[F.abs(F.col(n) - F.col(f"{n}_fresh")).cast("double").alias(n) for n in names])


@query
def pretrained_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Drifted readings of all events by detectors saved before the drift, with their own scaling.

    Reconstruction scores are given in ten-thousandths.
    """
    prepared = _events(spark, folder)
    path = staging_path(spark, "detectors")
    save_detectors(spark, freeze(fit_detectors(prepared), prepared.test), path)
    drifted = adapters.sensor_events(spark, folder).withColumns(
        {"torque": F.col("torque") * 2 + 50, "vibration": F.col("vibration") + 10}
    )
    scored = score_saved(drifted, load_detectors(spark, path))
    return scored.select(
        "sample_id", "machine_id", "rule_based_score", "rule_based_prediction",
        F.floor(F.round(F.col("autoencoder_score") * 1e6) / 100).cast("long").alias("autoencoder_score"),
        "autoencoder_prediction",
    )


@query
def pretrained_run(spark: SparkSession, folder: str) -> DataFrame:
    """A whole run over drifted events with detectors saved before: stored scores, explanations and scaled readings."""
    prepared = _events(spark, folder)
    path = staging_path(spark, "detectors")
    save_detectors(spark, freeze(fit_detectors(prepared, trees=20, iterations=5), prepared.test), path)
    drifted = adapters.sensor_events(spark, folder).withColumns(
        {"torque": F.col("torque") * 2 + 50, "vibration": F.col("vibration") + 10}
    )
    tables = ResultTables(spark, staging_path(spark, "tables"))
    run(spark, drifted, tables, pretrained=path, ingest_options={"id_column": "sample_id", "batch_id": "batch"})
    rule = F.col("model_name") == "rule_based"
    cleaned = tables.table("cleaned_sensor_records").where("split_name = 'test'").select(
        "sample_id", "machine_id",
        F.round(F.get_json_object("scaled_payload", "$.vibration").cast("double"), 4).alias("scaled_vibration"),
    )
    scores = tables.table("anomaly_scores").where(rule).select("sample_id", F.col("anomaly_score").alias("score"))
    predictions = tables.table("model_predictions").where(rule).select("sample_id", "predicted_label", "explanation")
    return cleaned.join(scores, "sample_id").join(predictions, "sample_id")


@query
def pretrained_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics that such a run stores: those of the table before the drift."""
    prepared = _events(spark, folder)
    drifted = adapters.sensor_events(spark, folder).withColumns({name: F.col(name) * 3 + 1 for name in SENSORS})
    batch = ingest(drifted, "drifted", id_column="sample_id")
    rows = prepare(batch, saved=(prepared.medians, prepared.stats)).statistics()
    return rows.withColumns({name: F.round(name, 4) for name in ("mean", "std", "min", "max", "median")})


@query
def report_of_two(spark: SparkSession, folder: str) -> DataFrame:
    """The leaderboard rows of the two detectors that are not random, of a full training."""
    prepared = prepare_readings(adapters.sensor_lines(spark, folder), SENSORS)
    detectors, scored = train_and_score(prepared)
    results = evaluate_scored(
        scored, prepared.stats, detectors.thresholds, status=detectors.status, notes=detectors.notes
    )
    names = [fixed.MODELS[model] for model in ("rule_based", "autoencoder")]
    return report_tables(results)["leaderboard"].where(F.col("model").isin(names))


@query
def full_run_of_two(spark: SparkSession, folder: str) -> DataFrame:
    """A whole run from the text table, with tables and document: metrics of the two detectors that are not random, as stored and as saved."""
    tables, path = ResultTables(spark, staging_path(spark, "tables")), staging_path(spark, "document")
    text = adapters.sensor_events_text(spark, folder)
    run(spark, text, tables, document=path, trees=20, iterations=5, ingest_options={"id_column": "row id"})
    saved = load_results(spark, path)[0]["metrics"]
    names = ("model_name", *evaluation.METRICS, "support", "flagged_count", "verdict")
    both = tables.table("evaluation_results").select(F.lit("table").alias("kept_as"), *names).unionByName(
        saved.select(F.lit("document").alias("kept_as"), *names)
    )
    found = both.where(F.col("model_name").isin("rule_based", "autoencoder"))
    return found.withColumns({name: F.round(name, 6) for name in evaluation.METRICS})


@query
def inference_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Limits beside the scored rows, for the detectors whose limit is not random, and rows flagged by them."""
    prepared = _events(spark, folder)
    detectors, scored = train_and_score(prepared)
    limits = inference_table(spark, detectors).where(F.col("model_name") != "isolation_forest")
    flags = scored.agg(*[F.sum(f"{m}_prediction").alias(m) for m in ("rule_based", "autoencoder")])
    counts = flags.select(F.explode(F.create_map(*[x for m in ("rule_based", "autoencoder") for x in (F.lit(m), F.col(m))])).alias("model_name", "flagged"))
    return limits.join(counts, "model_name", "left").select(
        "model_name", F.round("threshold", 4).alias("threshold"), "status", "flagged"
    )
