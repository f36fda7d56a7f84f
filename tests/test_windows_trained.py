"""The perceptron trained on timelines, and the forest read from tables, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwatch.operators.detectors.forest import _grow, _path_sums
from millwatch.operators.detectors.gradient import _block_numbers, gradient_sums, pack_timelines
from millwatch.operators.detectors.networks import draw, perceptron_kernel, perceptron_shapes
from millwatch.operators.detectors.sequence import with_windows
from millwatch.operators.normalize import zone_free_seconds
from millwatch.operators.ordering import micros_of, seconds_of


@pytest.mark.parametrize("group_rows", [11, 2_000_000])
def test_gradient_is_that_of_all_windows(spark, group_rows):
    rows = spark.range(400).select(
        F.lit("train").alias("split"), F.concat(F.lit("m"), (F.col("id") % 7 * (F.col("id") % 3)).cast("string")).alias("machine_id"),
        "id", F.sin("id").alias("a"), F.cos(F.col("id") * 3).alias("b"), (F.col("id") % 5 == 0).cast("int").alias("failure_label"),
    )
    rows = rows.selectExpr("*", "row_number() over (partition by machine_id order by id) as split_position").cache()
    shapes = perceptron_shapes(16, 5)
    at = draw(shapes, 1)
    blocks = pack_timelines(rows, ["split", "machine_id"], "split_position", ["a", "b"], F.col("failure_label"), 400, 8, group_rows)
    loss, gradient = gradient_sums(blocks, perceptron_kernel(shapes, 8), at)

    table = with_windows(rows, ("a", "b"), group_rows=group_rows).toPandas()
    x, y = np.array([np.array(list(map(list, w))).ravel() for w in table["window"]]), table["failure_label"].to_numpy()

    def plain(p):
        w, b, v, c = p[:80].reshape(16, 5), p[80:85], p[85:95].reshape(5, 2), p[95:]
        out = 1 / (1 + np.exp(-(x @ w + b))) @ v + c
        return -(out[np.arange(len(y)), y] - np.log(np.exp(out).sum(1))).sum()

    assert len(x) == 400
    assert loss == pytest.approx(plain(at), abs=1e-3)
    steps = np.eye(len(at)) * 1e-5
    assert gradient == pytest.approx([(plain(at + s) - plain(at - s)) / 2e-5 for s in steps], abs=5e-3)


def test_blocks_hold_a_reading_once(spark):
    rows = spark.range(5_000).selectExpr("'train' split", "'m' machine_id", "id + 1 split_position", "double(id) a", "0 failure_label")
    blocks = pack_timelines(rows, ["split", "machine_id"], "split_position", ["a"], F.col("failure_label"), 5_000, 8, 2_000_000)
    held = sum(len(targets) for batch in [blocks.toArrow()] for b in batch.to_batches() for _, targets in _block_numbers(b))
    assert held < 5_000 * 1.1  # eight values for each reading before


@pytest.mark.parametrize("size", [2, 6])
def test_forest_tables_equal_the_walk(size):
    rng = np.random.default_rng(3)
    data, width, depth = rng.normal(size=(4_000, size)).round(2), 256, 8
    features, cuts, paths = np.zeros((12, 255), np.intp), np.full((12, 255), np.inf), np.zeros((12, 256))
    for tree in range(12):
        few = data[rng.choice(4_000, 256 if tree else 1, False)]
        for node, index, value, length, _ in _grow(few, np.random.default_rng(tree), depth):
            if index >= 0:
                features[tree, node], cuts[tree, node] = index, value
                continue
            while node < width - 1:
                node = 2 * node + 1
            paths[tree, node - (width - 1)] = length
    rows = np.concatenate([data, [[np.nan] * size], [cuts[1][np.isfinite(cuts[1])][:size]]])
    wanted = np.zeros(len(rows))
    for f, c, p in zip(features, cuts, paths):
        for i, row in enumerate(rows):
            node = 0
            while node < width - 1:
                node = 2 * node + 1 + int(row[f[node]] > c[node])
            wanted[i] += p[node - (width - 1)]
    assert np.array_equal(_path_sums(features, cuts, paths, size)(list(rows.T)), wanted)


def test_windows_are_read_by_lags(spark):
    rows = spark.range(30).selectExpr("'train' split", "'m' machine_id", "id + 1 split_position", "double(id) a")
    got = with_windows(rows, ("a",), group_rows=10)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    for row in got.collect():
        last = int(row["a"])
        assert [int(entry[0]) for entry in row["window"]] == [max(0, n) for n in range(last - 7, last + 1)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kathmandu"])
def test_fractions_are_whole_numbers_in_any_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["1969-12-31 23:59:59.999999", "1960-02-29 00:00:00.000001", "2024-03-10 02:30:00.5", "2024-11-03 01:30:07", "2024-01-01 00:00:11.172425", None]
        rows = spark.createDataFrame([(text,) for text in texts], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
        second = F.date_part(F.lit("SECOND"), "t")
        got = rows.select(
            micros_of(F.col("t")).alias("m"), (seconds_of(F.col("t")) * 1_000_000 + (second % 1 * 1_000_000).cast("long")).alias("m0"),
            zone_free_seconds(F.col("t")).cast("string").alias("s"), F.substring(F.col("t").cast("string"), 1, 19).alias("s0"), zone_free_seconds(F.col("t")).alias("type"),
        )
        assert got.schema["type"].dataType.simpleString() == "timestamp_ntz"
        assert "decimal" not in got.select("m", "s").schema.simpleString()
        for row in got.collect():
            assert (row["m"], row["s"]) == (row["m0"], row["s0"])
        plan = rows.select(micros_of(F.col("t")), zone_free_seconds(F.col("t")))._jdf.queryExecution().analyzed().toString()
        assert "decimal" not in plan and "date_part" not in plan.lower()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
