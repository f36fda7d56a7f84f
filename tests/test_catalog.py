"""Catalog queries against their SQL, and the rule's known counts."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from millwatch.operators.detectors.rule import batch_maxima, fit_rule, score_rules
from millwatch.plans.catalog import catalog
from millwatch.plans.oracle import oracle
from millwatch.plans.oracle_checks import oracle_checks
from millwatch.plans.prepare import prepare_readings
from millwatch.sources import adapters
from tools.check_sql import compare, connect

# One per family; tools/check_sql.py runs them all.
CHECKED = (
    "readings_events", "label_words", "numeric_coercion", "chrono_split_lines", "imputed_gaps",
    "lag_windows", "variant_metrics_lines", "roc_curves", "predictions_long", "feature_report",
    "recon_scores_lines", "scores_table", "fault_summary", "hot_machine_gaps", "subsecond_order",
    "time_forms", "six_sensor_scores", "forest_limits", "pretrained_scores",
)


@pytest.fixture(scope="module")
def connection(small):
    return connect(small)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, small, connection, name):
    ours = queries()[name](spark, small).toPandas()
    assert compare(ours, connection.sql(oracle_sql()[name]).df()) == ""


def test_every_sql_belongs_to_a_query():
    texts = oracle() | oracle_checks()
    assert set(oracle_sql()) <= set(queries())
    assert set(texts) <= set(catalog())
    assert set(catalog()) - set(texts) == {
        "forest_trees", "forest_scores", "sequence_scores", "saved_detectors", "full_run", "full_report",
    }


def test_flagship(spark):
    assert entry(spark).count() == 10


@pytest.mark.parametrize(
    "adapter, rows",
    [
        (adapters.sensor_events, (207, 30, 5, 4, 38, 6.84)),
        (adapters.sensor_lines, (1203, 275, 21, 16, 170, 5.39)),
    ],
)
def test_rule_counts(spark, small, adapter, rows):
    prepared = prepare_readings(adapter(spark, small), adapters.EVENT_SENSORS)
    model = fit_rule(prepared.stats)
    flag, failed = F.col("rule_prediction") == 1, F.col("failure_label") == 1
    got = score_rules(prepared.test, {"rule": model}).agg(
        F.count("*"), F.count_if(failed), F.count_if(flag), F.count_if(flag & failed),
        F.count_if(model.excess() > 0),
    ).first()
    maximum = round(batch_maxima(prepared.test, {"rule": model})["rule"], 2)
    assert (*got, maximum) == rows


def test_small_groups_change_nothing(spark, small):
    whole = adapters.sensor_events(spark, small)
    cut = adapters.sensor_events(spark, small, group_rows=5)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))


def test_six_sensor_payload_is_read_once(spark, small):
    found = queries()["six_sensor_table"](spark, small)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "get_json_object" not in plan and plan.count("from_json") <= 1
    assert found.where("not payload_holds or payload_holds is null").count() == 0


def test_six_sensor_explanations_read_one_list(spark, small):
    found = queries()["six_sensor_scores"](spark, small)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array") == 1 and plan.count("rint") < 1000
