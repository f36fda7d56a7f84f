import pytest
from pyspark.sql import functions as F

from millwatch.functions.scalar import fixed_text, health_band, iso_second, label_text, metric_cell, nan_to_null, risk_level, verdict
from millwatch.operators.normalize import (
    available_sensors, canonical_names, column_warnings, label_of, normalize_columns, number_of, slug, timeline_moment,
)
from millwatch.operators.ordering import seconds_of
from millwatch.operators.split import chronological_split
from millwatch.plans.ingest import ingest
from millwatch.plans.prepare import prepare

HEADER = [
    "Product ID", "Event Time", "Air temperature [K]", "Process temperature [K]",
    "Rotational speed [rpm]", "Torque [Nm]", "Tool wear [min]", "Vibe", "Machine failure",
]


def texts(spark, columns, *rows):
    return spark.createDataFrame(list(rows), ", ".join(f"`{c}` string" for c in columns))


def test_slug_and_aliases():
    assert slug("  Air temperature [K] ") == "air_temperature_k"
    assert list(canonical_names(HEADER).values()) == [
        "machine_id", "timestamp", "air_temperature", "process_temperature", "rotational_speed",
        "torque", "tool_wear", "vibration", "failure_label",
    ]
    assert available_sensors(["vibration", "torque"])[0] == ["torque", "vibration"]


def test_two_columns_for_one_name_are_refused(spark):
    with pytest.raises(ValueError, match="machine_id.*Product ID"):
        normalize_columns(texts(spark, ["machine_id", "Product ID", "torque"], ("a", "b", "1")))


def test_only_sensors(spark):
    batch = ingest(texts(spark, ["torque", "vibration"], ("1", "2"), ("3", "x"), ("5", "nan")))
    rows = batch.readings.orderBy("sample_id").collect()
    assert [r.sample_id for r in rows] == [1, 2, 3]
    assert {r.machine_id for r in rows} == {"M-001"}
    assert [str(r.timestamp) for r in rows] == [
        "2026-01-01 00:00:00", "2026-01-01 00:05:00", "2026-01-01 00:10:00",
    ]
    assert [r.vibration for r in rows] == [2.0, None, None]
    assert [r.failure_label for r in rows] == [0, 0, 0]
    assert not batch.label_available and len(batch.notes) == 3
    assert batch.missing == (
        "air_temperature", "process_temperature", "rotational_speed", "tool_wear",
    )


def test_input_errors(spark):
    with pytest.raises(ValueError, match="empty"):
        ingest(texts(spark, ["torque"]))
    with pytest.raises(ValueError, match="sensor"):
        ingest(texts(spark, ["machine_id", "other"], ("a", "1")))
    with pytest.raises(ValueError, match="two sensor"):
        prepare(ingest(texts(spark, ["torque"], ("1",), ("2",))))
    bad_time = texts(spark, ["time", "torque"], ("2026-01-01", "1"), ("soon", "2"))
    with pytest.raises(ValueError, match="timestamp"):
        ingest(bad_time)


def test_warnings(spark):
    assert column_warnings(texts(spark, ["vibration"], ("1",))) == ["Missing required column: torque"]
    assert column_warnings(texts(spark, ["torque", "rpm"], ("1", "2"))) == [
        "Missing sensor columns: air_temperature, process_temperature, tool_wear, vibration"
    ]
    assert column_warnings(texts(spark, HEADER, ("a",) * 9)) == []


def test_labels_by_column_type(spark):
    words = texts(spark, ["failure_label"], *[(w,) for w in ("yes", "No", " TRUE", "anomaly", "2", "1", "1.0", None)])
    assert [r[0] for r in words.select(label_of(words)).collect()] == [1, 0, 1, 1, 0, 1, 0, 0]
    numbers = texts(spark, ["failure_label"], *[(w,) for w in ("0", "1", "2", "-1", None)])
    assert [r[0] for r in numbers.select(label_of(numbers)).collect()] == [0, 1, 1, 0, 0]


def test_fractions_of_seconds_go_before_ordering(spark):
    rows = texts(
        spark, ["machine", "time", "torque", "id"],
        ("a", "2026-01-01 00:00:00.9", "1", "1"), ("a", "2026-01-01 00:00:00.1", "2", "2"),
        ("a", "2026-01-01T00:00:01", "3", "3"),
    )
    batch = ingest(rows, id_column="id")
    assert {str(r.timestamp) for r in batch.readings.collect()} == {
        "2026-01-01 00:00:00", "2026-01-01 00:00:01",
    }
    split = chronological_split(batch.readings).orderBy("sample_id").collect()
    assert [r.split for r in split] == ["train", "validation", "test"]


def test_time_format_and_order(spark):
    rows = texts(
        spark, ["time", "torque", "vibration"],
        ("02/01/2026 10:00", "1", "7"), ("01/01/2026 10:00", "2", "5"),
    )
    batch = ingest(rows, time_format="dd/MM/yyyy HH:mm", order=["vibration"])
    got = batch.readings.orderBy("sample_id").collect()
    assert [(r.sample_id, r.torque, str(r.timestamp)) for r in got] == [
        (1, 2.0, "2026-01-01 10:00:00"), (2, 1.0, "2026-01-02 10:00:00"),
    ]


def test_forms_of_time_are_chosen_for_the_whole_column(spark):
    def read(*times, **options):
        batch = ingest(texts(spark, ["time", "torque", "id"], *[(t, "1", str(i)) for i, t in enumerate(times)]), id_column="id", **options)
        return [str(r.timestamp) for r in batch.readings.orderBy("sample_id").collect()]

    assert read("01/02/2026 10:00", "03/04/2026 11:30:05") == ["2026-01-02 10:00:00", "2026-03-04 11:30:05"]
    assert read("01/02/2026 10:00", "13/04/2026 11:30") == ["2026-02-01 10:00:00", "2026-04-13 11:30:00"]
    assert read("5.1.26", "17.1.26", time_format=["d.M.yy H", "d.M.yy"]) == ["2026-01-05 00:00:00", "2026-01-17 00:00:00"]
    assert read("1767225600999", " -1 ", epoch_unit="ms") == ["2026-01-01 00:00:00", "1969-12-31 23:59:59"]
    with pytest.raises(ValueError, match="timestamps"):
        read("13/14/2026 10:00", "01/02/2026 10:00")
    with pytest.raises(ValueError, match="timestamps"):
        read("soon", "1", epoch_unit="s")
    with pytest.raises(ValueError, match="epoch unit"):
        read("1", epoch_unit="h")
    numbers = spark.createDataFrame([(1_767_225_600, 1.0)], "time bigint, torque double")
    with pytest.raises(ValueError, match="epoch_unit"):
        ingest(numbers)
    assert str(ingest(numbers, epoch_unit="s").readings.first().timestamp) == "2026-01-01 00:00:00"


def test_later_forms_of_time_are_tried_only_where_the_first_does_not_fit(spark, monkeypatch):
    def forms(*_):
        first = F.col("timestamp").try_cast("timestamp_ntz")
        return [first, F.raise_error(F.lit("a later form was tried")).cast("timestamp_ntz")]

    monkeypatch.setattr("millwatch.plans.ingest.time_readings", forms)
    rows = [("2026-01-05 10:00:00", "1"), ("2026-01-06", "2")]
    batch = ingest(texts(spark, ["time", "torque"], *rows))
    assert batch.readings.where("timestamp is not null").count() == 2
    with pytest.raises(Exception, match="a later form was tried"):
        ingest(texts(spark, ["time", "torque"], *rows, ("5.1.26", "3")))


def test_texts_read_as_finite_numbers(spark):
    given = ["1.5", " -0.0 ", "1e999", "-1e999", "nan", "inf", "1d", "0x1p3", "", None, "1e-400", "+.5"]
    rows = texts(spark, ["text", "n"], *[(text, str(i)) for i, text in enumerate(given)])
    got = {r.n: r.x for r in rows.select("n", number_of(F.col("text"), rows.schema["text"].dataType).alias("x")).collect()}
    want = [1.5, -0.0, None, None, None, None, None, None, None, None, 0.0, 0.5]
    assert [str(got[str(i)]) for i in range(len(given))] == [str(x) for x in want]


def test_fixed_texts_are_those_of_python(spark):
    given = [0.0, 0.5, 0.05, 0.25, 0.125, 0.995, 1.005, 2.675, 9.95, 99.949, 123456.789, 999_999_999.96, 1e9, 1e15, -0.25, -3.14159, float("nan")]
    got = spark.createDataFrame([(x,) for x in given], "x double").select(fixed_text(F.col("x"), 1), fixed_text(F.col("x"), 2)).collect()
    for x, row in zip(given, got):
        want = ("NaN", "NaN") if x != x else (f"{x:.1f}", f"{x:.2f}")
        assert tuple(row) == want


def test_given_ids_must_be_unique_numbers(spark):
    def rows(*ids):
        return texts(spark, ["id", "torque"], *[(i, "1") for i in ids])

    with pytest.raises(ValueError, match="repeats values, such as 7"):
        ingest(rows("7", "8", "7"), id_column="id")
    with pytest.raises(ValueError, match="2 rows have no readable number"):
        ingest(rows("7", None, "x"), id_column="id")
    assert ingest(rows("7", "8"), id_column="id").readings.count() == 2


def test_session_zone_plays_no_part(spark):
    """Clock changes of the session's zone must not move readings."""
    gap = ("2026-03-08 02:30:00.5", "2026-11-01 01:30:00", "1969-07-20 20:17:40")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        plain = ingest(texts(spark, ["time", "torque"], *[(t, "1") for t in gap]))
        want = sorted(t[:19].replace(" ", "T") for t in gap)
        iso = iso_second(F.col("timestamp"))
        assert sorted(r[0] for r in plain.readings.select(iso).collect()) == want
        styled = [(f"{t[8:10]}/{t[5:7]}/{t[:4]} {t[11:19]}", "1") for t in gap]
        formed = ingest(texts(spark, ["time", "torque"], *styled), time_format="dd/MM/yyyy HH:mm:ss")
        assert sorted(r[0] for r in formed.readings.select(iso).collect()) == want
        steps = spark.range(1, 40_000).select(seconds_of(timeline_moment(F.col("id"))).alias("s"))
        assert steps.agg(F.max("s") - F.min("s")).first()[0] == 39_998 * 300
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_null_machines_are_noted(spark):
    rows = texts(spark, ["machine", "torque"], ("a", "1"), (None, "2"))
    batch = ingest(rows)
    assert any("1 readings without machine id" in note for note in batch.notes)
    assert chronological_split(batch.readings).where("machine_id is null").count() == 0


def test_scalar_functions(spark):
    df = spark.createDataFrame([(0.75,), (0.6,), (0.45,), (0.1,), (None,)], "x double")
    got = df.select(
        verdict(F.col("x")), metric_cell(F.col("x")), risk_level(F.col("x")),
        health_band(F.col("x") * 100), label_text((F.col("x") > 0.5).cast("int")),
    ).collect()
    assert [r[0] for r in got] == ["Strong", "Good", "Decent", "Weak", "Unavailable"]
    assert [r[1] for r in got] == ["0.750", "0.600", "0.450", "0.100", "n/a"]
    assert [r[2] for r in got][:4] == ["HIGH RISK", "MONITOR", "MONITOR", "NORMAL"]
    assert [r[3] for r in got][:4] == ["Watch", "Watch", "Risky", "Critical"]
    assert [r[4] for r in got] == ["FAILURE", "FAILURE", "NORMAL", "NORMAL", "UNKNOWN"]
    one = spark.sql("SELECT timestamp_ntz'2026-01-02 03:04:05' AS t, double('NaN') AS n")
    row = one.select(iso_second(F.col("t")), nan_to_null(F.col("n"))).first()
    assert tuple(row) == ("2026-01-02T03:04:05", None)
