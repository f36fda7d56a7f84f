import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millwatch.operators.quantiles import exact_quantiles
from millwatch.operators.running import RunningStatistics
from millwatch.operators.stats import fit_train_stats, impute, scale, train_medians
from millwatch.plans.prepare import load_preparation, prepare_readings, save_preparation
from tests.frames import readings

FEATURES = ("torque", "vibration")
QUANTILES = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]


@pytest.mark.parametrize("gathered", [100_000, 40, 1])
def test_quantiles_are_exact(spark, gathered):
    rng = np.random.default_rng(2)
    ties = np.where(rng.random(6001) < 0.6, 3.0, rng.normal(3, 1, 6001))
    table = pd.DataFrame(
        {"smooth": rng.lognormal(0, 3, 6001), "ties": ties, "same": 7.0, "few": rng.integers(0, 3, 6001) * 1.0}
    )
    df = spark.createDataFrame(table).repartition(6)
    df = df.withColumn("gaps", F.when(F.col("smooth") > 1, F.col("smooth"))).withColumn(
        "none", F.lit(None).cast("double")
    )
    got = exact_quantiles(df, {c: QUANTILES for c in df.columns}, gathered)
    table["gaps"] = table["smooth"].where(table["smooth"] > 1)
    for name in table:
        want = np.quantile(table[name].dropna(), QUANTILES)
        assert np.allclose(got[name], want, rtol=1e-12, atol=0), name
    assert got["none"] == [None] * len(QUANTILES)


def test_quantile_of_even_count_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (20.0,)], "x double")
    assert np.allclose(exact_quantiles(df, {"x": [0.5, 0.95]})["x"], [6.0, 18.5])
    assert exact_quantiles(df.limit(1), {"x": [0.3]}) == {"x": [1.0]}


def test_medians_fill_gaps_and_empty_sensors_get_zero(spark):
    df = spark.createDataFrame(
        [(1.0, None), (None, None), (5.0, None), (2.0, None)], "torque double, vibration double"
    )
    medians = train_medians(df, FEATURES)
    assert medians == {"torque": 2.0, "vibration": 0.0}
    assert [tuple(r) for r in impute(df, medians).collect()][1] == (2.0, 0.0)


def test_statistics_are_population_based(spark):
    df = readings(spark, {"a": 200})
    stats = fit_train_stats(df, FEATURES)
    table = df.toPandas()
    normal = table[table["failure_label"] == 0]
    assert stats.rows == 200 and stats.normal_rows == len(normal)
    for name in FEATURES:
        assert np.isclose(stats.means[name], table[name].mean())
        assert np.isclose(stats.scales[name], table[name].std(ddof=0))
        assert np.isclose(stats.reference_means[name], normal[name].mean())
        assert np.isclose(stats.reference_stds[name], normal[name].std(ddof=0))
    scaled = scale(df, stats).toPandas()
    assert abs(scaled["torque__scaled"].mean()) < 1e-9
    share = table["failure_label"].mean()
    assert np.isclose(stats.contamination, min(max(share * 1.5, 0.02), 0.15))


def test_constant_sensor(spark):
    df = readings(spark, {"a": 50}).withColumn("vibration", F.lit(0.1))
    stats = fit_train_stats(df, FEATURES)
    assert stats.scales["vibration"] == 1.0
    assert stats.reference_stds["vibration"] == 1e-6


def test_all_failed(spark):
    df = readings(spark, {"a": 50}).withColumn("failure_label", F.lit(1))
    stats = fit_train_stats(df, FEATURES)
    assert stats.normal_rows == 0 and stats.contamination == 0.08 and stats.classes == 1
    assert stats.reference_means == stats.means


def test_fitted_values_come_from_train_only(spark):
    df = readings(spark, {"a": 100, "b": 50})
    base = prepare_readings(df, FEATURES)
    late = F.col("timestamp") >= F.lit("2026-01-01 00:57:00").cast("timestamp_ntz")
    changed = prepare_readings(
        df.withColumn("torque", F.when(late & (F.col("machine_id") == "a"), 999.0).otherwise(F.col("torque"))),
        FEATURES,
    )
    assert changed.test.where("torque = 999").count() > 0
    assert base.stats == changed.stats and base.medians == changed.medians
    assert base.sizes == changed.sizes == {"train": 90, "validation": 30, "test": 30}


def test_statistics_rows(spark):
    prepared = prepare_readings(readings(spark, {"a": 100}), FEATURES)
    train = prepared.train.toPandas()
    for row in prepared.statistics().collect():
        column = train[row.feature_name]
        assert np.allclose(
            [row["mean"], row["std"], row["min"], row["max"], row["median"]],
            [column.mean(), column.std(ddof=0), column.min(), column.max(), column.median()],
        )


def test_preparation_document(spark, tmp_path):
    prepared = prepare_readings(readings(spark, {"a": 30}), FEATURES, run_id="r", batch_id="b")
    save_preparation(spark, prepared, f"{tmp_path}/prep")
    document = load_preparation(spark, f"{tmp_path}/prep")
    assert document["medians"] == prepared.medians
    assert document["feature_columns"] == list(FEATURES) and document["run_id"] == "r"


def batches(spark):
    """Five batches with gaps, one of them empty, one without failures, one far off."""
    table = readings(spark, {"a": 900}, seed=5).withColumn("torque", F.when(F.col("sample_id") % 7 != 0, F.col("torque")))
    cut = [(0, 100), (100, 101), (101, 101), (101, 500), (500, 900)]
    parts = [table.where(F.col("sample_id").between(a + 1, b)) for a, b in cut]
    parts[3] = parts[3].withColumn("failure_label", F.lit(0))
    parts[4] = parts[4].withColumn("vibration", F.col("vibration") + 1_000)
    return parts


@pytest.mark.parametrize("gathered", [100_000, 20])
def test_statistics_of_batches_equal_those_of_the_whole_table(spark, tmp_path, gathered):
    running = RunningStatistics(spark, f"{tmp_path}/state", FEATURES)
    whole = None
    for number, part in enumerate(batches(spark)):
        assert running.add(part, f"b{number}") and not running.add(part, f"b{number}")
        whole = part if whole is None else whole.unionByName(part)
        medians = running.medians(whole, gathered)
        assert medians == train_medians(whole, FEATURES)
        want, got = fit_train_stats(impute(whole, medians), FEATURES), running.stats(medians)
        assert (got.rows, got.normal_rows, got.minima, got.maxima) == (want.rows, want.normal_rows, want.minima, want.maxima)
        assert np.isclose(got.failure_share, want.failure_share)
        for name in ("means", "stds", "scales", "reference_means", "reference_stds"):
            a, b = getattr(got, name), getattr(want, name)
            assert np.allclose([a[f] for f in FEATURES], [b[f] for f in FEATURES], rtol=1e-9), (number, name)


def test_running_statistics_without_values(spark, tmp_path):
    running = RunningStatistics(spark, f"{tmp_path}/state", FEATURES)
    empty = readings(spark, {"a": 3}).limit(0)
    running.add(empty, "none")
    with pytest.raises(ValueError, match="No batch"):
        running.stats({name: 0.0 for name in FEATURES})
    rows = readings(spark, {"a": 4}).withColumn("torque", F.lit(None).cast("double"))
    running.add(rows, "gaps")
    medians = running.medians(rows)
    assert medians["torque"] == 0.0
    assert running.stats(medians).means["torque"] == 0.0 and running.stats(medians).scales["torque"] == 1.0
