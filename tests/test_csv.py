import csv
from contextlib import contextmanager

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from millwatch.plans.ingest import ingest_csv
from millwatch.plans.prepare import prepare_readings
from millwatch.session import stage
from millwatch.sources import csv_source, records
from millwatch.sources.csv_source import export_test_csv, load_csv
from millwatch.sources.records import has_quoted_breaks, text_lines
from tests.frames import readings


def write(tmp_path, text, name="data.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_texts_missing_values_and_quotes(spark, tmp_path):
    path = write(tmp_path, 'a,b,c\n1,NA,"x, ""y"""\n,nan,null\n2,3\nNone,ok,"N/A"\n')
    rows = [tuple(r) for r in load_csv(spark, path).collect()]
    assert rows == [("1", None, 'x, "y"'), (None, None, None), ("2", "3", None), (None, "ok", None)]


def test_empty_and_broken_files(spark, tmp_path):
    for i, text in enumerate(("", "a,b\n")):
        with pytest.raises(ValueError, match="empty"):
            load_csv(spark, write(tmp_path, text, f"e{i}.csv"))
    for i, text in enumerate(("a,b\n1,2,3\n", "a,b\n1,2\n1,2,3,4\n", 'a,b\n1,2\n"1,0",2,3\n')):
        with pytest.raises(ValueError, match="valid CSV"):
            load_csv(spark, write(tmp_path, text, f"b{i}.csv"))
    with pytest.raises(AnalysisException):
        load_csv(spark, str(tmp_path / "absent.csv"))


def test_line_breaks_in_quotes(spark, tmp_path):
    path = write(tmp_path, 'a,b\n"x\ny",1\nz,2\n')
    rows = load_csv(spark, path, row_number="n", multi_line=True).orderBy("n").collect()
    assert [tuple(r) for r in rows] == [("x\ny", "1", 1), ("z", "2", 2)]


def small_blocks(spark, size):
    """Read files in blocks of a few bytes."""
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in names}

    @contextmanager
    def block():
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
        for name, value in before.items():
            spark.conf.set(name, value)

    return block()


SIGNS = st.sampled_from(["a", "b", "\"", ",", "\n", "\r\n", " ", "x\ny\n\nz"])
FIELD = st.lists(SIGNS, max_size=6).map("".join)


@settings(max_examples=7, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(FIELD, FIELD), min_size=1, max_size=25), size=st.integers(5, 60), ends=st.sampled_from(["\n", "\r\n"]))
def test_records_of_any_fields_in_blocks_of_any_size(spark, tmp_path_factory, rows, size, ends):
    """Two files as Python writes them, read in blocks that end anywhere."""
    folder = tmp_path_factory.mktemp("quoted")
    rows = [(a, b, str(i)) for i, (a, b) in enumerate(rows)]
    half = len(rows) // 2
    for name, part in (("p0", rows[:half]), ("p1", rows[half:])):
        with open(folder / f"{name}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator=ends)
            writer.writerow(["left, \"one\"", "right", "id"])
            writer.writerows(part)
    with small_blocks(spark, size):
        got = load_csv(spark, str(folder), row_number="n").orderBy("n").collect()
    assert [(r[0] or "", r[1] or "", r[2], r[3]) for r in got] == [(a, b, i, n) for n, (a, b, i) in enumerate(rows, 1)]


def test_one_file_is_split_among_tasks_also_inside_quotes(spark, tmp_path):
    long = "\n".join(f"line {i}, \"\"said\"\"" for i in range(400))
    path = write(tmp_path, "a,b\n" + "".join(f'"{i}\n{long if i == 7 else i}",{i}\n\n' for i in range(60)))
    with small_blocks(spark, 700):
        lines = text_lines(spark, path)
        assert lines.rdd.getNumPartitions() > 10 and has_quoted_breaks(lines)
        got = load_csv(spark, path, row_number="n").orderBy("n").collect()
    assert [(r.b, r.n) for r in got] == [(str(i), i + 1) for i in range(60)]
    assert got[7].a == "7\n" + long.replace('""', '"')


def test_tasks_sort_no_more_text_where_there_is_more(spark, tmp_path, monkeypatch):
    path = write(tmp_path, "a,b\n" + "".join(f'"{i}\n\nx",{i}\n' for i in range(300)))
    parts = {}

    def kept(df, label="stage"):
        parts[label] = df.rdd.getNumPartitions()
        return stage(df, label)

    monkeypatch.setattr(records, "stage", kept)
    monkeypatch.setattr(csv_source, "stage", kept)
    monkeypatch.setattr(records, "_PART_BYTES", 300, raising=False)
    with small_blocks(spark, 700):
        got = load_csv(spark, path, row_number="n").orderBy("n").collect()
    assert [(r.a, r.b, r.n) for r in got] == [(f"{i}\n\nx", str(i), i + 1) for i in range(300)]
    assert parts["lines"] == -(-len(open(path).read()) // 300) > 8 and parts["csv"] >= parts["lines"]


def test_quotes_in_plain_fields_open_nothing(spark, tmp_path):
    path = write(tmp_path, 'a,b\n5" pipe,1\nx "y" z,"two\nlines"\n"in",3" \n')
    got = [tuple(r) for r in load_csv(spark, path, row_number="n").orderBy("n").collect()]
    assert got == [('5" pipe', "1", 1), ('x "y" z', "two\nlines", 2), ("in", '3" ', 3)]
    assert not has_quoted_breaks(text_lines(spark, write(tmp_path, 'a,b\n5" pipe,1\n"x, y",2\n', "plain.csv")))


def test_quotes_that_stay_open_and_further_fields_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="never closed"):
        load_csv(spark, write(tmp_path, 'a,b\n1,"x\ny,2\n'))
    with pytest.raises(ValueError, match="more fields"):
        load_csv(spark, write(tmp_path, 'a,b\n"x\ny",2\n"1\n2",3,4\n', "wide.csv"))
    with pytest.raises(ValueError, match="empty"):
        load_csv(spark, write(tmp_path, '"a\nb",c\n\n', "head.csv"))


def test_line_numbers_follow_files_and_blocks(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for part, size in (("p0", 10), ("p1", 4000), ("p2", 300)):
        lines = "\n".join(f"{part}-{i},{i}.0" for i in range(size))
        (folder / f"{part}.csv").write_text("name,torque\n" + lines + "\n")
    want = [f"{p}-{i}" for p, size in (("p0", 10), ("p1", 4000), ("p2", 300)) for i in range(size)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = load_csv(spark, str(folder), row_number="n")
        assert got.rdd.getNumPartitions() > 3
        assert [r.name for r in got.orderBy("n").collect()] == want
        assert got.agg(F.max("n"), F.count_distinct("n")).first() == (4310, 4310)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ingest_csv(spark, tmp_path):
    path = write(
        tmp_path,
        "Machine ID,Time,Torque [Nm],Vibe,Failure\nb,2026-01-01 00:00:00,1.5,x,yes\n"
        "a,2026-01-02T00:00:00,NA,2,no\n",
    )
    batch = ingest_csv(spark, path)
    rows = batch.readings.orderBy("sample_id").collect()
    assert [(r.sample_id, r.machine_id, r.torque, r.vibration, r.failure_label) for r in rows] == [
        (1, "b", 1.5, None, 1), (2, "a", None, 2.0, 0),
    ]
    assert batch.renamed["Vibe"] == "vibration" and batch.source == path


def test_export_of_the_test_split(spark, tmp_path):
    prepared = prepare_readings(readings(spark, {"a": 50}), ("torque", "vibration"))
    export_test_csv(prepared.frame, f"{tmp_path}/out")
    back = load_csv(spark, f"{tmp_path}/out")
    assert back.columns == ["sample_id", "machine_id", "timestamp", "torque", "vibration", "failure_label"]
    assert back.count() == 10
    first = back.orderBy(F.col("sample_id").cast("int")).first()
    assert first.timestamp == "2026-01-01T00:24:40"
