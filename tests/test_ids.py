"""Repeated ids by bitmaps, ingest in one read of its source, readings stored by machine."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millwatch.operators.detectors.sequence import with_windows
from millwatch.operators.ids import repeated_id
from millwatch.operators.split import chronological_split
from millwatch.plans.ingest import ingest
from millwatch.session import stage_observed, staging_path
from millwatch.sources import timelines
from tests.frames import readings, values


def shuffle_written(spark, work) -> int:
    """Bytes that the stages of some work write for shuffles."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    store = spark.sparkContext._jsc.sc().statusStore()

    def total() -> int:
        stages = store.stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    work()
    return total() - before


@pytest.mark.parametrize("by_bitmap", [None, True, False])
def test_repeated_ids_are_found(spark, by_bitmap):
    rng = random.Random(4)
    for spread in (50, 100_000, 1 << 40):
        for _ in range(4):
            ids = [rng.randint(-spread, spread) for _ in range(rng.randint(0, 60))] + [None, None]
            table = spark.createDataFrame([(i,) for i in ids], "i bigint").repartition(3)
            repeated = {i for i, n in Counter(ids).items() if n > 1 and i is not None}
            found = repeated_id(table, F.col("i"), by_bitmap)
            assert (found in repeated) if repeated else found is None
    ends = spark.createDataFrame([(i,) for i in (-(1 << 63), (1 << 63) - 1, 0, 1, -1, 32_768, 32_769, -32_768)], "i bigint")
    assert repeated_id(ends, F.col("i"), by_bitmap) is None


def test_close_ids_are_checked_without_shuffling_them(spark):
    table = spark.range(0, 2_000_000, 1, 4)
    written = shuffle_written(spark, lambda: repeated_id(table, F.col("id")))
    assert written < 2_000_000 * 8 / 100
    assert repeated_id(table.unionByName(spark.range(77, 78)), F.col("id")) == 77


def test_ingest_reads_its_source_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    source = readings(spark, {"a": 40, None: 3}).withColumn("torque", counted("torque")).withColumn("unused", F.lit("x"))
    batch = ingest(source, id_column="sample_id")
    assert batch.readings.count() == 43 and batch.readings.agg(F.sum("torque")).first()[0] > 0
    assert seen.value == 43
    assert batch.notes == ("3 readings without machine id stay out of every split.",)
    seen.value = 0
    ingest(source).readings.agg(F.sum("torque")).collect()
    assert seen.value == 43  # numbering copies it as well
    plain = ingest(readings(spark, {"a": 40, None: 3}), id_column="sample_id", stored=True)
    names = ("sample_id", "machine_id", "timestamp", "torque", "failure_label")
    assert plain.notes == batch.notes
    assert sorted(values_with_nulls(plain.readings, *names), key=str) == sorted(values_with_nulls(batch.readings, *names), key=str)


def values_with_nulls(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_metrics_taken_while_staging(spark):
    staged, seen = stage_observed(spark.range(100), {"rows": F.count(F.lit(1)), "top": F.max("id")})
    assert seen == {"rows": 100, "top": 99} and staged.count() == 100
    staged, seen = stage_observed(spark.range(100).where("id < 0"), {"rows": F.count(F.lit(1))})
    assert staged.count() == 0 and not seen.get("rows")


def test_stored_timelines_need_no_shuffle(spark):
    table = readings(spark, {"a": 60, "b": 31, "c": 2, None: 5})
    path = staging_path(spark, "timelines")
    name = f"timelines_{path.rsplit('-', 1)[-1]}"
    stored = timelines.store_timelines(table, name, path, 4)
    features = ("torque", "vibration")
    rows = with_windows(chronological_split(stored), features)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan and "SelectedBucketsCount: 4 out of 4" in plan
    plain = with_windows(chronological_split(table), features)
    names = ("sample_id", "machine_id", "split", "split_position", "window")
    assert values(rows, *names) == values(plain, *names)
    # a session that does not know the table yet
    schema = stored.dtypes
    spark.sql(f"DROP TABLE {name}")
    again = timelines.open_timelines(spark, name, path, schema, 4)
    rows = chronological_split(again)
    assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
    assert values(again, "sample_id", "torque") == values(table.where("machine_id is not null"), "sample_id", "torque")
    spark.sql(f"DROP TABLE {name}")


def test_a_machine_too_large_for_a_bucket_is_refused(spark, monkeypatch):
    monkeypatch.setattr(timelines, "GROUP_ROWS", 10)
    with pytest.raises(ValueError, match="20 readings"):
        timelines.store_timelines(readings(spark, {"a": 20}), "too_large", staging_path(spark, "large"), 2)
