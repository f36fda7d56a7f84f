import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millwatch.operators import evaluation, ranking
from millwatch.operators.detectors.rule import fit_rule, score_rules
from millwatch.operators.stats import TrainStats
from millwatch.plans.evaluate import evaluate_scored, report_tables
from millwatch.plans.prepare import prepare_readings
from tests.frames import readings

MODELS = {"one": "One", "two": "Two", "flat": "Flat"}
FEATURES = ("torque", "vibration")
STATS = TrainStats(
    FEATURES, 10, 9, 0.1, {}, {}, {}, {}, {}, {"torque": 40.0, "vibration": 0.4},
    {"torque": 4.0, "vibration": 0.1},
)


def scored_table(rows=700, seed=4, labels=None):
    rng = np.random.default_rng(seed)
    label = (rng.random(rows) < 0.3).astype(int) if labels is None else np.full(rows, labels)
    one = np.round(np.clip(rng.normal(0.3 + 0.3 * label, 0.2), 0, 1), 2)
    two = np.round(rng.random(rows), 6)
    table = pd.DataFrame(
        {
            "sample_id": np.arange(1, rows + 1), "machine_id": rng.choice(["a", "b"], rows),
            "timestamp": pd.Timestamp("2026-01-01") + pd.to_timedelta(rng.integers(0, 90, rows), unit="s"),
            "torque": rng.normal(40, 8, rows), "vibration": rng.normal(0.4, 0.2, rows),
            "failure_label": label, "one_score": one, "two_score": two, "flat_score": 0.25,
        }
    )
    for name in MODELS:
        table[f"{name}_prediction"] = (table[f"{name}_score"] >= 0.5).astype(int)
    return table


@pytest.fixture(scope="module")
def table():
    return scored_table()


@pytest.fixture(scope="module")
def scored(spark, table):
    return spark.createDataFrame(table).withColumn(
        "timestamp", F.col("timestamp").cast("timestamp_ntz")
    ).cache()


def brute_auc(label, score):
    wins = [
        1.0 if p > n else 0.5 if p == n else 0.0
        for p in score[label == 1] for n in score[label == 0]
    ]
    return sum(wins) / len(wins)


def test_metrics_against_brute_force(scored, table):
    got = {r.model_name: r for r in evaluation.metrics(scored, MODELS).collect()}
    label = table["failure_label"].to_numpy()
    for name in MODELS:
        flag = table[f"{name}_prediction"].to_numpy()
        tp, fp = int((flag & label).sum()), int((flag & (1 - label)).sum())
        fn = int(label.sum()) - tp
        row = got[name]
        assert np.isclose(row.accuracy, (flag == label).mean())
        assert np.isclose(row.precision, tp / (tp + fp) if tp + fp else 0)
        assert np.isclose(row.recall, tp / (tp + fn))
        assert np.isclose(row.f1, 2 * tp / (2 * tp + fp + fn))
        assert np.isclose(row.roc_auc, brute_auc(label, table[f"{name}_score"].to_numpy()))
        assert (row.support, row.flagged_count) == (len(table), tp + fp)


def test_one_class_has_no_auc_and_no_curve(spark):
    for label in (0, 1):
        df = spark.createDataFrame(scored_table(50, labels=label))
        rows = evaluation.metrics(df, MODELS).collect()
        assert [r.roc_auc for r in rows] == [None] * 3
        assert evaluation.roc_curve(df, list(MODELS)).count() == 0
        if label == 0:
            assert {(r.precision, r.recall, r.f1) for r in rows} == {(0.0, 0.0, 0.0)}


def test_leaderboard_ties_keep_the_model_order(spark, scored):
    same = scored.withColumns(
        {f"{n}_{c}": F.col(f"one_{c}") for n in ("two", "flat") for c in ("score", "prediction")}
    )
    rows = evaluation.leaderboard(evaluation.metrics(same, MODELS)).collect()
    assert [r.model_name for r in rows] == ["one", "two", "flat"]
    assert evaluation.best_model(evaluation.metrics(scored, MODELS)) == "one"


def brute_curve(label, score):
    points = []
    for cut in sorted(set(score), reverse=True):
        chosen = score >= cut
        points.append((int(((label == 0) & chosen).sum()), int(((label == 1) & chosen).sum()), cut))
    kept = [
        p for i, p in enumerate(points)
        if i in (0, len(points) - 1)
        or (points[i + 1][0] - p[0], points[i + 1][1] - p[1])
        != (p[0] - points[i - 1][0], p[1] - points[i - 1][1])
    ]
    n, p = (label == 0).sum(), (label == 1).sum()
    return [(0.0, 0.0, float("inf"))] + [(a / n, b / p, c) for a, b, c in kept]


def test_roc_curve_against_brute_force(scored, table):
    rows = evaluation.roc_curve(scored, list(MODELS)).collect()
    label = table["failure_label"].to_numpy()
    for name in MODELS:
        got = sorted((r.fpr, r.tpr, r.threshold) for r in rows if r.model_name == name)
        score = np.array([round(x, 3) for x in table[f"{name}_score"]])
        want = sorted(brute_curve(label, score))
        assert len(got) == len(want) and np.allclose(got, want)


def test_histogram_against_numpy(scored, table):
    rows = evaluation.score_histogram(scored, list(MODELS)).collect()
    for name in MODELS:
        got = [r.rows for r in sorted(rows, key=lambda r: r.bin) if r.model_name == name]
        score = np.array([round(x, 3) for x in table[f"{name}_score"]])
        assert got == np.histogram(score, bins=16)[0].tolist(), name


def test_counts(spark, scored, table):
    cells = {(r.true_label, r.predicted_label): r.rows for r in evaluation.confusion(scored, "flat").collect()}
    positives = int(table["failure_label"].sum())
    assert cells == {
        ("NORMAL", "NORMAL"): len(table) - positives, ("NORMAL", "FAILURE"): 0,
        ("FAILURE", "NORMAL"): positives, ("FAILURE", "FAILURE"): 0,
    }
    classes = {r["class"]: r.rows for r in evaluation.class_distribution(scored).collect()}
    assert classes == {"Normal": len(table) - positives, "Failure": positives}
    bare = evaluation.class_distribution(scored.drop("failure_label")).collect()
    assert {r["class"]: r.rows for r in bare} == {"Normal": len(table), "Failure": 0}


def brute_deviations(row):
    z = {f: round(abs((row[f] - STATS.reference_means[f]) / STATS.reference_stds[f]), 3) for f in FEATURES}
    return sorted(z.items(), key=lambda item: -item[1])


def brute_text(row, score, flag):
    named = ", ".join(f"{f} ({z:.1f}z)" for f, z in brute_deviations(row))
    if flag:
        return f"Risk score {score:.2f}: elevated readings in {named} pushed this sample into the alert range."
    return (
        f"Risk score {score:.2f}: readings stayed near the training baseline, "
        f"with the largest movement in {named}."
    )


def test_records_against_brute_force(scored, table):
    records = ranking.per_sample(scored, STATS, "one", list(MODELS))
    by_id = table.set_index("sample_id")
    for r in records.collect():
        row = by_id.loc[r.sample_id]
        assert r.top_features == [f for f, _ in brute_deviations(row)]
        assert r.explanation == brute_text(row, round(row.one_score, 3), row.one_prediction)
        health = float(np.round(np.clip(100 * (1 - row.one_score), 0, 100), 3))
        assert r.health_score == round(health, 2)
        assert r.scores == {m: round(row[f"{m}_score"], 3) for m in MODELS}
        assert r.prediction_flags == {m: row[f"{m}_prediction"] for m in MODELS}
        assert r.true_label == ("FAILURE" if row.failure_label else "NORMAL")


def test_ranking_and_errors(scored, table):
    given = (scored, STATS, "one", list(MODELS))
    want = table.assign(s=[round(x, 3) for x in table["one_score"]]).sort_values(
        ["s", "machine_id", "timestamp", "sample_id"], ascending=[False, True, True, True]
    )
    assert [r.sample_id for r in ranking.anomaly_ranking(*given).collect()] == want["sample_id"].tolist()
    assert [r.sample_id for r in ranking.top_anomalies(*given).collect()] == want["sample_id"].tolist()[:10]
    alarms = want[(want.failure_label == 0) & (want.one_prediction == 1)]
    misses = want[(want.failure_label == 1) & (want.one_prediction == 0)]
    got = ranking.error_deep_dive(*given)
    assert [[r.sample_id for r in part.collect()] for part in got] == [
        alarms["sample_id"].tolist()[:5], misses["sample_id"].tolist()[:5],
    ]
    plan = ranking.top_anomalies(*given)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("TakeOrderedAndProject", 1)
    assert "format_string" in above and "format_string" not in below and "Sort " not in below


def test_long_rows_and_ranks(scored, table):
    thresholds = {"one": 0.5, "two": 0.4, "flat": 0.3}
    rows = ranking.predictions_long(scored, STATS, list(MODELS), thresholds).toPandas()
    assert len(rows) == 3 * len(table)
    for name in MODELS:
        want = table.sort_values(
            [f"{name}_score", "machine_id", "timestamp", "sample_id"], ascending=[False, True, True, True]
        )["sample_id"].tolist()
        part = rows[rows["model_name"] == name].sort_values("rank")
        assert part["rank"].tolist() == list(range(1, len(table) + 1))
        assert part["sample_id"].tolist() == want
        assert set(part["threshold"]) == {thresholds[name]}
    by_id = table.set_index("sample_id")
    for r in rows[rows["model_name"] == "two"].itertuples():
        assert r.explanation == brute_text(by_id.loc[r.sample_id], r.anomaly_score, r.predicted_label)


def test_votes(spark, scored, table):
    got = ranking.feature_importance(scored, STATS, "one").collect()
    voters = table[
        (table.one_prediction == 1) | (table.failure_label == 1) | (table.one_score.round(3) >= 0.6)
    ]
    # Two sensors: both are named by every voter, so only the order can differ.
    assert [r.mentions for r in got] == [len(voters)] * 2
    first = voters.sort_values(["machine_id", "timestamp", "sample_id"]).iloc[0]
    assert [r.feature for r in got] == [f for f, _ in brute_deviations(first)]
    report = ranking.feature_report(ranking.feature_importance(scored, STATS, "one")).collect()
    assert [r.role for r in report] == ["Primary driver", "Secondary driver"]
    none = ranking.feature_importance(scored.where("1 = 0"), STATS, "one")
    assert ranking.feature_insight(none).first()[0].startswith("No dominant")


def test_filters_and_tables(scored, table):
    records = ranking.per_sample(scored, STATS, "one", list(MODELS))
    wide = ranking.flatten_samples(records, list(MODELS))
    flag, label = table["one_prediction"] == 1, table["failure_label"] == 1
    want = [len(table), label.sum(), flag.sum(), (flag & ~label).sum(), (~flag & label).sum()]
    assert [ranking.filter_samples(wide, "one", m).count() for m in ranking.FILTER_MODES] == want
    names = ranking.sample_table(wide, "one", list(MODELS)).columns
    assert len(names) == len(set(names)) and names[-1] == "explanation"
    assert "explanation" not in ranking.sample_table(wide, "one", list(MODELS), False).columns


def test_rule_follows_the_batch(spark):
    prepared = prepare_readings(readings(spark, {"a": 300, "b": 200}), FEATURES)
    model = fit_rule(prepared.stats)
    got = score_rules(prepared.test, {"rule": model}).toPandas()
    table = prepared.test.toPandas()
    excess = np.max(
        [
            np.maximum(np.abs((table[f] - model.means[f]) / model.stds[f]) - 2.5, 0)
            for f in FEATURES
        ],
        axis=0,
    )
    want = dict(zip(table["sample_id"], excess / max(excess.max(), 1.0)))
    assert np.allclose(got["rule_raw"], [want[i] for i in got["sample_id"]])
    assert ((got["rule_raw"] >= 0.5) == (got["rule_prediction"] == 1)).all()
    fixed_unit = score_rules(prepared.test, {"rule": model}, {"rule": 100.0}).agg(F.max("rule_raw")).first()[0]
    assert np.isclose(fixed_unit, excess.max() / 100)


def test_reports(spark, scored):
    results = evaluate_scored(scored, STATS, dict.fromkeys(MODELS, 0.5), MODELS)
    tables = {name: frame.collect() for name, frame in report_tables(results).items()}
    assert [r.model for r in tables["leaderboard"]][0] == "One"
    assert len(tables["anomaly_ranking"]) == 10 and len(tables["error_deep_dive"]) == 10
    text = tables["executive_summary"][0][0]
    assert text.startswith("One delivered the best F1-score (0.") and "on 700 test samples" in text
