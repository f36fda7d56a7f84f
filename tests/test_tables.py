"""Appends that count once, whatever fails and however often a job is tried."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millwatch.plans.ingest import ingest
from millwatch.plans.prepare import prepare
from millwatch.sources.files import path_exists, put_text_once, subfolders
from millwatch.sources.tables import ResultTables, raw_rows
from tests.frames import readings

FEATURES = ("torque", "vibration")


def raw(spark, size=6, batch="b"):
    return raw_rows(readings(spark, {"a": size}), FEATURES, batch, "made", "now")


def counts(tables):
    return {r.table_name: r.rows for r in tables.counts().collect()}


def test_a_try_that_fails_between_two_tables_leaves_nothing(spark, tmp_path, monkeypatch):
    tables = ResultTables(spark, f"{tmp_path}/tables")
    tables.create()
    table = readings(spark, {"a": 60})
    write = ResultTables.write

    def failing(self, name, rows, attempt):
        if name == "feature_statistics":
            raise RuntimeError("lost")
        write(self, name, rows, attempt)

    def job():
        batch = ingest(table, id_column="sample_id", tables=tables, batch_id="b7")
        return prepare(batch, tables, "r7")

    monkeypatch.setattr(ResultTables, "write", failing)
    with pytest.raises(RuntimeError, match="lost"):
        job()
    assert counts(tables)["cleaned_sensor_records"] == 0 and counts(tables)["raw_sensor_records"] == 60
    monkeypatch.setattr(ResultTables, "write", write)
    for _ in range(2):
        job()
        found = counts(tables)
        assert (found["raw_sensor_records"], found["cleaned_sensor_records"], found["feature_statistics"]) == (60, 60, 2)
    # what the failed try wrote is there until it is swept away
    attempts = len(subfolders(spark, f"{tables.root}/cleaned_sensor_records"))
    assert tables.vacuum(older_than=3_600) == 0 and tables.vacuum(older_than=0) == 1
    assert len(subfolders(spark, f"{tables.root}/cleaned_sensor_records")) == attempts - 1
    assert counts(tables) == found


def test_keys_and_appends_without_one(spark, tmp_path):
    tables = ResultTables(spark, f"{tmp_path}/tables")
    assert tables.append("raw_sensor_records", raw(spark), "one") is True
    assert tables.append("raw_sensor_records", raw(spark, 9), "one") is False
    assert tables.table("raw_sensor_records").count() == 6
    for _ in range(2):
        assert tables.append("raw_sensor_records", raw(spark, 2))
    assert tables.table("raw_sensor_records").count() == 10
    assert tables.is_published("one") and not tables.is_published("two")
    tables.create()
    tables.create()
    assert counts(tables)["raw_sensor_records"] == 10 and tables.published().count() == 4


def test_readers_see_published_partitions_only(spark, tmp_path):
    tables = ResultTables(spark, f"{tmp_path}/tables")
    for batch in ("b1", "b2"):
        tables.append("raw_sensor_records", raw(spark, 4, batch), batch)
    tables.write("raw_sensor_records", raw(spark, 50, "b2"), "unfinished")
    found = tables.table("raw_sensor_records").groupBy("batch_id").count().collect()
    assert sorted(map(tuple, found)) == [("b1", 4), ("b2", 4)]


def test_a_small_file_is_put_once(spark, tmp_path):
    path = f"{tmp_path}/deep/file.json"
    assert put_text_once(spark, path, "first") and not put_text_once(spark, path, "second")
    assert (tmp_path / "deep" / "file.json").read_text() == "first" and path_exists(spark, path)
    assert [p.name for p in (tmp_path / "deep").iterdir() if not p.name.endswith(".crc")] == ["file.json"]


def test_two_roots_in_one_session_and_statements_with_names_of_their_own(spark, tmp_path):
    one, two = (ResultTables(spark, f"{tmp_path}/{n}") for n in ("one", "two"))
    for tables, size in ((one, 3), (two, 8)):
        tables.create()
        tables.append("raw_sensor_records", raw(spark, size))
    text = "SELECT count(*) AS n FROM raw_sensor_records WHERE sample_id > ?"
    first, second = one.query(text, [1]), two.query(text, [1])
    assert (first.first()[0], second.first()[0]) == (2, 7)
    named = "with big AS (SELECT * FROM raw_sensor_records WHERE sample_id > 2) SELECT sample_id FROM big ORDER BY sample_id DESC"
    assert [r[0] for r in two.query(named).collect()] == [8, 7, 6, 5, 4, 3]
    assert one.query("SELECT max(sample_id) FROM raw_sensor_records").agg(F.max("max(sample_id)")).first()[0] == 3
