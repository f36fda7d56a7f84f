"""Windows and sequence scores on a stream: order of time, restarts, late readings."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millwatch.operators.stats import SCALED
from millwatch.plans.prepare import prepare_readings
from millwatch.plans.train import fit_detectors, freeze, score_saved
from millwatch.streaming.scoring import score_stream, write_scores
from millwatch.streaming.windows import stream_windows
from tests.frames import readings

FEATURES = ("torque", "vibration")
END = datetime(2030, 1, 1)


def write_arrivals(spark, rows, schema, folder, name):
    """One file of readings as they arrive together."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def arrivals(table, jitter, parts, seed=3):
    """Readings in the order in which they come: each up to ``jitter`` seconds late."""
    rng = random.Random(seed)
    rows = sorted(table.collect(), key=lambda r: (r.timestamp + timedelta(seconds=rng.uniform(0, jitter)), r.sample_id))
    size = -(-len(rows) // parts)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def last_word(schema):
    """A reading far ahead, which lets all others go."""
    return [(0, "end", END, 0.0, 0.0, 0)]


def plain_windows(rows, length=8):
    out = {}
    for machine in {r.machine_id for r in rows}:
        line = sorted((r for r in rows if r.machine_id == machine), key=lambda r: (r.timestamp, r.sample_id))
        for i, r in enumerate(line):
            seen = [[x.torque, x.vibration] for x in line[max(0, i + 1 - length) : i + 1]]
            out[r.sample_id] = [seen[0]] * (length - len(seen)) + seen
    return out


def run(spark, source, schema, out, checkpoint, lateness="10 minutes"):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    write_scores(stream_windows(stream, FEATURES, lateness), out, checkpoint).awaitTermination()


def test_windows_of_a_shuffled_stream_over_a_restart(spark, tmp_path):
    table = readings(spark, {"a": 70, "b": 25, "c": 3, None: 4})
    parts = arrivals(table, 300, 5)
    source, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    for i, rows in enumerate(parts[:3]):
        write_arrivals(spark, rows, table.schema, source, f"p{i}")
    run(spark, source, table.schema, out, checkpoint)
    early = spark.read.parquet(out).count()
    assert 0 < early < sum(map(len, parts[:3]))  # the last ones wait
    for i, rows in enumerate([*parts[3:], last_word(table.schema)]):
        write_arrivals(spark, rows, table.schema, source, f"q{i}")
    run(spark, source, table.schema, out, checkpoint)
    found = {r.sample_id: [list(x) for x in r.window] for r in spark.read.parquet(out).collect()}
    rows = [r for r in table.collect() if r.machine_id is not None]
    assert found == plain_windows(rows)
    times = {r.sample_id: (r.machine_id, r.timestamp, r.torque) for r in spark.read.parquet(out).collect()}
    assert times == {r.sample_id: (r.machine_id, r.timestamp, r.torque) for r in rows}


def test_readings_later_than_allowed_are_left_out(spark, tmp_path):
    table = readings(spark, {"a": 40})
    rows = sorted(table.collect(), key=lambda r: r.timestamp)
    late, rest = rows[5], rows[:5] + rows[6:]
    source, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    for i, part in enumerate((rest[:20], rest[20:], [late], last_word(table.schema))):
        write_arrivals(spark, part, table.schema, source, f"p{i}")
    run(spark, source, table.schema, out, checkpoint, "1 minute")
    found = {r.sample_id: [list(x) for x in r.window] for r in spark.read.parquet(out).collect()}
    assert found == plain_windows(rest)


@pytest.mark.parametrize("kind", ["perceptron", "recurrent"])
def test_stream_scores_equal_those_of_the_table(spark, tmp_path, kind):
    table = readings(spark, {"a": 60, "b": 45})
    prepared = prepare_readings(table, FEATURES)
    detectors = freeze(fit_detectors(prepared, trees=10, iterations=5, sequence_kind=kind), prepared.test)
    source = f"{tmp_path}/in"
    for i, rows in enumerate([*arrivals(table, 120, 3), last_word(table.schema)]):
        write_arrivals(spark, rows, table.schema, source, f"p{i}")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    scores = score_stream(stream, detectors, "10 minutes")
    write_scores(scores, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    names = ("sample_id", "machine_id", "timestamp", "rule_based_score", "isolation_forest_score", "autoencoder_score", "lstm_score", "lstm_prediction")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert not [c for c in got.columns if c in map(SCALED.format, FEATURES) or c == "window"]
    want = score_saved(table, detectors)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, want.select(*names).collect()))
    assert got.where(F.col("lstm_score") > 0).count() > 0


def test_machines_of_one_group_keep_apart(spark, tmp_path, monkeypatch):
    """Two groups for all machines: state is asked for by group, windows stay those of each machine."""
    from millwatch.streaming import windows

    monkeypatch.setattr(windows, "STATE_GROUPS", 2)
    test_windows_of_a_shuffled_stream_over_a_restart(spark, tmp_path)
