from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millwatch import fixed
from millwatch.operators.detectors.forest import average_path, draw_samples, grow_forest, tree_depth
from millwatch.operators.detectors.recon import fit_recon, moments
from millwatch.operators.detectors.sequence import with_windows
from millwatch.operators.stats import SCALED, normal_rows
from millwatch.plans.evaluate import evaluate_scored
from millwatch.plans.prepare import prepare_readings
from millwatch.plans.run import run
from millwatch.plans.train import (
    MODELS, fit_detectors, freeze, inference_table, load_detectors, save_detectors, score_detectors,
    score_row_local, score_saved,
)
from millwatch.sources.results import load_results
from millwatch.sources.tables import SCHEMAS, ResultTables
from millwatch.streaming.scoring import score_stream, write_scores
from tests.frames import readings, values

FEATURES = ("torque", "vibration")
NAMES = [SCALED.format(name) for name in FEATURES]


@pytest.fixture(scope="module")
def prepared(spark):
    return prepare_readings(readings(spark, {"a": 900, "b": 500, "c": 40}, failures=0.15), FEATURES)


@pytest.fixture(scope="module")
def detectors(prepared):
    return fit_detectors(prepared, trees=40, iterations=15)


@pytest.fixture(scope="module")
def normal(prepared):
    return normal_rows(prepared.train, prepared.stats)


def brute_depth(nodes, row):
    """Walk one tree node by node."""
    table = nodes.set_index("node")
    node = 0
    while table.loc[node, "feature"] >= 0:
        item = table.loc[node]
        node = 2 * node + (2 if row[int(item.feature)] > item.cut else 1)
    return table.loc[node, "path"]


def test_forest_scores_against_a_walk(spark, prepared, normal):
    model = grow_forest(normal, NAMES, prepared.stats.normal_rows, 0.1, trees=7, sample=64)
    some = prepared.test.orderBy("sample_id").limit(60)
    got = some.select(*NAMES, model.raw(spark).alias("raw")).toPandas()
    trees = [nodes for _, nodes in model.nodes.groupby("tree")]
    for row in got.itertuples(index=False):
        depth = np.mean([brute_depth(nodes, row[:2]) for nodes in trees])
        assert np.isclose(row[2], 2 ** (-depth / average_path(64)))


def test_trees_are_well_formed(prepared, normal):
    model = grow_forest(normal, NAMES, prepared.stats.normal_rows, 0.1, trees=9, sample=128)
    assert sorted(model.nodes["tree"].unique()) == list(range(9))
    roots = model.nodes[model.nodes["node"] == 0]
    assert (roots["rows"] == 128).all()
    for _, nodes in model.nodes.groupby("tree"):
        leaves = nodes[nodes["feature"] < 0]
        assert leaves["rows"].sum() == 128
        assert nodes["node"].max() < 2 ** (tree_depth(128) + 1) - 1
        assert len(nodes) == 2 * len(leaves) - 1


def test_samples_do_not_depend_on_the_layout(normal, prepared):
    def drawn(df, rows):
        return values(draw_samples(df, NAMES, rows, 5, 32, 42), "tree", "place", "sample_id")

    rows = prepared.stats.normal_rows
    one, many = drawn(normal.coalesce(1), rows), drawn(normal.repartition(16), rows)
    assert one == many and len(one) == 5 * 32
    assert len({s for t, _, s in one if t == 0}) == 32
    assert {s for t, _, s in one if t == 0} != {s for t, _, s in one if t == 1}


def test_thinned_pool_still_fills_every_tree(spark):
    big = spark.range(20_000).select(
        F.col("id").alias("sample_id"), F.rand(1).alias("x"), F.rand(2).alias("y")
    )
    got = draw_samples(big, ["x", "y"], 20_000, 4, 64, 42).groupBy("tree").count().collect()
    assert sorted(tuple(r) for r in got) == [(t, 64) for t in range(4)]


def test_extreme_reading_ranks_first(spark, prepared, detectors):
    odd = prepared.test.orderBy("sample_id").limit(1).withColumns(
        {"sample_id": F.lit(-1).cast("bigint"), **{n: F.lit(40.0) for n in NAMES}, **{f: F.lit(900.0) for f in FEATURES}}
    )
    scored = score_detectors(prepared.test.unionByName(odd), detectors).toPandas()
    for model in MODELS[:3]:
        assert scored.loc[scored[f"{model}_score"].idxmax(), f"{model}_score"] == scored.set_index("sample_id").loc[-1, f"{model}_score"]


def test_every_row_may_be_drawn(spark):
    rows, trees, sample = 40_000, 200, 256
    big = spark.range(rows).select(F.col("id").alias("sample_id"), F.rand(5).alias("x"))
    drawn = draw_samples(big, ["x"], rows, trees, sample, 42).toPandas()
    assert (drawn.groupby("tree").size() == sample).all() and len(drawn["tree"].unique()) == trees
    assert not drawn.duplicated(["tree", "sample_id"]).any()
    # 51,200 draws leave exp(-1.28) of the rows out; first, middle and last trees see alike rows
    assert abs(drawn["sample_id"].nunique() / rows - (1 - np.exp(-1.28))) < 0.02
    middle = drawn.groupby(drawn["tree"] // 50)["sample_id"].mean()
    assert (abs(middle / rows - 0.5) < 0.02).all()
    # trees are independent: rows met in two neighbouring trees are as rare as chance has it
    sets = drawn.groupby("tree")["sample_id"].apply(set)
    shared = sum(len(sets[t] & sets[t + 1]) for t in range(trees - 1)) / (trees - 1)
    assert abs(shared - sample * sample / rows) < 0.5


def test_scores_and_calibration(prepared, detectors, normal):
    scored = score_detectors(prepared.test, detectors)
    for name in MODELS:
        low, high = scored.agg(F.min(f"{name}_score"), F.max(f"{name}_score")).first()
        assert 0 <= low <= high <= 1
    own = score_detectors(normal, detectors).toPandas()
    assert np.isclose(own["autoencoder_prediction"].mean(), 0.05, atol=0.01)
    share = 1 - detectors.forest.quantiles[0]
    assert np.isclose(own["isolation_forest_prediction"].mean(), share, atol=0.01)
    for name in ("autoencoder", "isolation_forest"):
        assert own[f"{name}_score"].min() == 0 and own[f"{name}_score"].max() == 1
    limit = detectors.normalized_thresholds["autoencoder"]
    assert (own.loc[own["autoencoder_prediction"] == 1, "autoencoder_score"] >= limit - 1e-6).all()


def test_same_scores_in_any_layout(prepared, detectors):
    one = score_detectors(prepared.test.coalesce(1), detectors)
    many = score_detectors(prepared.test.repartition(16), detectors)
    columns = ["sample_id", *[f"{m}_{c}" for m in MODELS for c in ("score", "prediction")]]
    assert values(one, *columns) == values(many, *columns)


def test_reconstruction_against_numpy(prepared, normal):
    model = fit_recon(normal, NAMES)
    table = normal.select(*NAMES).toPandas().to_numpy()
    means, covariance = moments(normal, NAMES)
    assert np.allclose(means, table.mean(axis=0))
    assert np.allclose(covariance, np.cov(table.T, ddof=0))
    _, vectors = np.linalg.eigh(covariance)
    kept = vectors[:, 1:]
    rows = prepared.test.select("sample_id", *NAMES, model.raw().alias("raw")).toPandas()
    centred = rows[NAMES].to_numpy() - means
    want = ((centred - centred @ kept @ kept.T) ** 2).mean(axis=1)
    assert np.allclose(rows["raw"], want)


@pytest.mark.parametrize("limit", [1_000_000, 11])
def test_windows(prepared, limit):
    got = with_windows(prepared.frame, FEATURES, group_rows=limit)
    table = prepared.frame.toPandas().sort_values(["machine_id", "split", "timestamp", "sample_id"])
    want = {}
    for key, part in table.groupby(["machine_id", "split"]):
        rows = part[list(FEATURES)].to_numpy().tolist()
        for i, ident in enumerate(part["sample_id"]):
            seen = rows[max(0, i - 7) : i + 1]
            want[ident, key[1]] = [seen[0]] * (8 - len(seen)) + seen
    assert {(r.sample_id, r.split): r.window for r in got.collect()} == want


def test_sequence_learns_a_lagged_signal(spark):
    df = readings(spark, {f"m{i}": 200 for i in range(6)}, failures=0.0)
    hot = (F.col("sample_id") % 25) < 5
    df = df.withColumns(
        {"torque": F.col("torque") + F.when(hot, 25.0).otherwise(0.0), "failure_label": hot.cast("int")}
    )
    prepared = prepare_readings(df, FEATURES)
    detectors = fit_detectors(prepared, trees=5, iterations=40)
    scored = score_detectors(prepared.test, detectors)
    results = evaluate_scored(scored, prepared.stats, detectors.thresholds)
    assert {r.model_name: r.roc_auc for r in results.metrics.collect()}["lstm"] > 0.95


def test_one_class_skips_the_sequence(spark):
    prepared = prepare_readings(readings(spark, {"a": 200}, failures=0.0), FEATURES)
    detectors = fit_detectors(prepared, trees=5)
    scored = score_detectors(prepared.test, detectors)
    assert values(scored.select("lstm_score", "lstm_prediction").distinct(), "lstm_score", "lstm_prediction") == [(0.0, 0)]
    status = {r.model_name: (r.status, r.threshold) for r in inference_table(spark, detectors).collect()}
    assert status["lstm"] == ("skipped", 0.5) and status["rule_based"][0] == "ok"
    results = evaluate_scored(
        scored, prepared.stats, detectors.thresholds, status=detectors.status, notes=detectors.notes
    )
    row = results.metrics.where("model_name = 'lstm'").first()
    assert row.status == "skipped" and "with and without failure" in row.notes and row.roc_auc is None


def test_saved_detectors_score_alike(spark, tmp_path, prepared, detectors):
    frozen = freeze(detectors, prepared.test)
    save_detectors(spark, frozen, f"{tmp_path}/models")
    loaded = load_detectors(spark, f"{tmp_path}/models")
    assert loaded.rule == frozen.rule and loaded.recon == frozen.recon
    assert replace(loaded.forest, nodes=None) == replace(frozen.forest, nodes=None)
    columns = ["sample_id", *[f"{m}_{c}" for m in MODELS for c in ("score", "prediction")]]
    assert values(score_detectors(prepared.test, loaded), *columns) == values(
        score_detectors(prepared.test, frozen), *columns
    )
    new = readings(spark, {"x": 30}, seed=9).withColumn(
        "torque", F.when(F.col("sample_id") % 5 != 0, F.col("torque"))
    )
    scored = score_saved(new, loaded)
    assert scored.count() == 30 and scored.where("torque is null").count() == 0
    assert {"lstm_health", "rule_based_score"} <= set(scored.columns)


def test_stream_scores_equal_batch_scores(spark, tmp_path, prepared, detectors):
    frozen = freeze(detectors, prepared.test)
    new = readings(spark, {"x": 40, "y": 3}, seed=8)
    new.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(new.schema).parquet(f"{tmp_path}/in")
    query = write_scores(score_stream(stream, frozen), f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination(120)
    columns = ["sample_id", *[f"{m}_{c}" for m in MODELS[:3] for c in ("score", "prediction")]]
    got = values(spark.read.parquet(f"{tmp_path}/out"), *columns)
    assert got == values(score_row_local(new, frozen), *columns) and len(got) == 43
    with pytest.raises(ValueError, match="Freeze"):
        score_stream(stream, detectors)


def test_whole_run_with_tables_and_document(spark, tmp_path):
    tables = ResultTables(spark, f"{tmp_path}/tables")
    tables.create()
    assert {r.rows for r in tables.counts().collect()} == {0}
    done = run(
        spark, readings(spark, {"a": 160, "b": 160, "c": 160}), tables,
        document=f"{tmp_path}/results", models=f"{tmp_path}/models",
        ingest_options={"id_column": "sample_id", "source": "made"}, trees=10, iterations=10,
    )
    assert done.prepared.sizes == {"train": 288, "validation": 96, "test": 96}
    counts = {r.table_name: r.rows for r in tables.counts().collect()}
    assert counts == {
        "raw_sensor_records": 480, "cleaned_sensor_records": 480, "model_predictions": 384,
        "anomaly_scores": 384, "evaluation_results": 4, "feature_statistics": 2,
    }
    for name, schema in SCHEMAS.items():
        assert sorted(tables.table(name).columns) == sorted(spark.createDataFrame([], schema).columns)
    best = tables.query(
        "SELECT count(*) AS n FROM anomaly_scores WHERE model_name = ? AND rank <= ?",
        [done.results.best, 7],
    )
    assert best.first()[0] == 7
    frames, about = load_results(spark, f"{tmp_path}/results")
    assert about["best_model"] == done.results.best and about["source_file"] == "made"
    assert frames["per_sample"].count() == 96 and frames["leaderboard"].count() == 4
    assert set(frames["per_sample"].first().scores.asDict()) == set(fixed.MODELS) if not isinstance(
        frames["per_sample"].first().scores, dict
    ) else set(frames["per_sample"].first().scores) == set(fixed.MODELS)
    again = run(
        spark, readings(spark, {"a": 160, "b": 160, "c": 160}), tables,
        pretrained=f"{tmp_path}/models", ingest_options={"id_column": "sample_id"},
    )
    columns = ("sample_id", "isolation_forest_score", "lstm_score")
    assert values(again.results.scored, *columns) == values(done.results.scored, *columns)
    assert {r.rows for r in tables.counts().collect()} == {960, 768, 8, 4}
    # a drifted table is scaled with the saved values, so it stands out
    table = readings(spark, {"a": 160, "b": 160, "c": 160})
    shifted = table.withColumns({c: F.col(c) + 500 for c in done.detectors.features})
    drifted = run(
        spark, shifted, pretrained=f"{tmp_path}/models", ingest_options={"id_column": "sample_id"},
    )
    mean = [F.avg(f"{m}_score") for m in ("isolation_forest", "autoencoder")]
    new, old = (x.results.scored.agg(*mean).first() for x in (drifted, again))
    assert new[0] > old[0] + 0.2 and new[1] > old[1] + 0.2
