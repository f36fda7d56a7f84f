"""SQL equivalents of the queries in ``catalog_checks``."""

from __future__ import annotations

from millwatch.plans.oracle import (
    CLEAN, DEVIATED, DEVIATIONS, EVENTS, EXCESS, GAPPY, LINES, METRICS, RECON, SCALE, SCORED, SENSORS, SPLIT, _cell, _excess,
    _explained, _prepared, _r, _with, plain_round,
)

SIX = ("air_temperature", "process_temperature", "rotational_speed", "torque", "tool_wear", "vibration")


def _list(template: str, names: tuple[str, ...] = SIX) -> str:
    return ", ".join(template.replace("$f", name) for name in names)


_SIX_LINES = LINES.replace(
    "moment, torque,",
    "moment, l_tax * 100 + 290 AS air_temperature, l_discount * 100 + 300 AS process_temperature, "
    "l_extendedprice / l_quantity AS rotational_speed, torque,",
)
_SIX_FITTED = (
    _SIX_LINES, SPLIT,
    "\ntrain AS (SELECT * FROM parts WHERE split = 'train')",
    "\nnormal AS (SELECT * FROM train WHERE failure_label = 0 OR NOT EXISTS "
    "(SELECT 1 FROM train WHERE failure_label = 0))",
    "\nreference AS (SELECT " + _list("avg($f) AS mean_$f, greatest(stddev_pop($f), 1e-6) AS std_$f")
    + ", count(*) AS rows FROM normal)",
    "\nscaling AS (SELECT "
    + _list("avg($f) AS c_$f, CASE WHEN stddev_pop($f) = 0 THEN 1 ELSE stddev_pop($f) END AS s_$f")
    + " FROM train)",
)
_SIX_SCORED = (
    "\ndeviated AS (SELECT parts.*, " + _list("abs(($f - mean_$f) / std_$f) AS z_$f")
    + " FROM parts, reference WHERE split = 'test')",
    "\nexcess AS (SELECT *, greatest(" + _list("z_$f - CAST(2.5 AS DOUBLE)") + ", 0) AS x FROM deviated)",
    "\nunit AS (SELECT greatest(max(x), 1) AS u FROM excess)",
    "\nscored AS (SELECT sample_id, machine_id, round_even(least(x / u, 1) * 1e6, 0) / 1e6 AS score, "
    "CASE WHEN x / u >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS prediction FROM excess, unit)",
    "\nentries AS ("
    + " UNION ALL ".join(
        f"SELECT sample_id, {i} AS idx, '{f}' AS feature, {_r('z_' + f)} AS z_score FROM deviated"
        for i, f in enumerate(SIX)
    )
    + ")",
    "\nordered AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY z_score DESC, idx) AS place "
    "FROM entries)",
    "\nnamed AS (SELECT sample_id, string_agg(feature || ' (' || format('{:.1f}', z_score) || 'z)', ', ' "
    "ORDER BY place) AS sensors FROM ordered WHERE place <= 3 GROUP BY sample_id)",
)

_DRIFTED = (
    "\ndrifted AS (SELECT sample_id, machine_id, torque * 2 + 50 AS torque, tool_wear, "
    "vibration + 10 AS vibration FROM readings)",
    "\njudged AS (SELECT drifted.*, (("
    + " + ".join(f"v[{i}] * (({f} - c_{f}) / s_{f} - m{m})" for i, (f, m) in enumerate(zip(SENSORS, "xyz"), 1))
    + ") / len)^2 / 3 AS err, "
    + ", ".join(f"abs(({f} - mean_{f}) / std_{f}) AS z_{f}" for f in SENSORS)
    + " FROM drifted, scaling, direction, reference)",
    f"\nshares AS (SELECT *, {_excess('2.5')} / (SELECT greatest(max(x_sigma_2_5), 1) FROM excess) AS share "
    "FROM judged, limits)",
)

_TWO = f"""
long AS (
  SELECT sample_id, machine_id, failure_label, 'rule_based' AS model_name, 'Rule-Based' AS display_name,
    0 AS model_order, sigma_2_5_score AS score, sigma_2_5_prediction AS prediction FROM scored
  UNION ALL
  SELECT sample_id, machine_id, failure_label, 'autoencoder', 'Autoencoder', 2,
    round_even(greatest(0, least(1, (err - lo) / greatest(hi - lo, 1e-8))) * 1e6, 0) / 1e6,
    CASE WHEN err >= lim THEN 1 ELSE 0 END
  FROM errors, limits WHERE split = 'test')"""

_REFUSALS = (
    ("no rows", "The input is empty: events"),
    (
        "no sensors",
        "No recognised sensor column; at least one is needed of: air_temperature, process_temperature, "
        "rotational_speed, torque, tool_wear, vibration",
    ),
    ("one sensor", "At least two sensor columns are needed. Found: [''vibration'']"),
    ("repeated ids", "The id column ''sample_id'' repeats values, such as 7."),
    ("unreadable ids", "{} rows have no readable number in the id column ''sample_id''."),
    ("unreadable times", "Some timestamps cannot be read; use ISO times or give a format."),
    ("empty split", "The validation split has no rows; more readings are needed."),
    ("missing file", "PATH_NOT_FOUND"),
)

_NOTES = (
    "Missing required column: torque",
    "No machine id column; all readings get the default machine.",
    "No timestamp column; readings are placed five minutes apart.",
    "No failure label column; all readings count as normal.",
)


def oracle_checks() -> dict[str, str]:
    second = "date_trunc('second', ts)"
    minute = "date_trunc('minute', ts)"
    stamped = "true AS has_id, true AS has_stamp, {} AS rows, 1 AS batches, 1 AS stamps"
    zeros = ", ".join(
        f"CAST(0 AS DOUBLE) AS {m}_{w}"
        for m in ("rule_based", "isolation_forest", "autoencoder", "lstm") for w in ("score", "prediction")
    )
    return {
        "quoted_breaks": (
            "SELECT event_id, concat_ws(chr(10), event_type, '\"user\", ' || CAST(user_id AS VARCHAR), '', props) AS note, value, "
            "row_number() OVER (ORDER BY event_id) AS number, true AS files_split FROM events"
        ),
        "hot_machine_gaps": "SELECT event_id, machine_id, CASE WHEN machine_id IS NOT NULL THEN lag(value) OVER "
        "(PARTITION BY machine_id ORDER BY moment NULLS FIRST, event_id) END AS previous FROM ("
        "SELECT event_id, value, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'M-001' "
        "ELSE CAST(user_id AS VARCHAR) END AS machine_id, CASE WHEN event_id % 13 <> 0 THEN ts END AS moment "
        "FROM events)",
        "subsecond_order": "SELECT event_id, row_number() OVER (ORDER BY event_id * 7919 % 997, event_id) AS "
        "position, count(*) OVER () AS group_size FROM events",
        "time_forms": " UNION ALL ".join(
            f"SELECT '{name}' AS spelling, event_id AS sample_id, strftime({moment}, '%Y-%m-%d %H:%M:%S') AS "
            "timestamp FROM events"
            for name, moment in (
                ("iso", second), ("month_first", minute), ("dotted", second), ("given", second), ("epoch", second),
            )
        ),
        "batch_notes": "SELECT note, (SELECT count(*) FROM events) AS rows FROM (VALUES "
        + ", ".join(f"('{note}')" for note in _NOTES) + ") AS t(note)",
        "bucketed_windows": _with(
            EVENTS, SPLIT,
            select="SELECT sample_id, machine_id, split, 0 AS shuffles, "
            "string_agg(CAST(CAST(t AS BIGINT) AS VARCHAR) || ':' || "
            "CAST(CAST(round(v * 100) AS BIGINT) AS VARCHAR), ' ' ORDER BY step) AS window "
            "FROM (SELECT now.sample_id, now.machine_id, now.split, step, past.torque AS t, past.vibration AS v "
            "FROM parts AS now, range(8) AS s(step) JOIN parts AS past ON past.machine_id = now.machine_id "
            "AND past.split = now.split AND past.split_position = greatest(1, now.split_position - 7 + step)) "
            "GROUP BY sample_id, machine_id, split",
        ),
        "refusals": "SELECT t.\"check\", replace(message, '{}', CAST(rows AS VARCHAR)) AS message, rows FROM (VALUES "
        + ", ".join(f"('{check}', '{message}')" for check, message in _REFUSALS)
        + ") AS t(\"check\", message), (SELECT count(*) AS rows FROM events)",
        "repeated_ids": "SELECT t.*, rows FROM (VALUES ('as they are', true, NULL), ('as they are', false, NULL), "
        "('one twice', true, 123), ('one twice', false, 123 * -1000003)) AS t(ids, by_bitmap, repeated), "
        "(SELECT count(*) AS rows FROM events)",
        "stamped_rows": _with(
            EVENTS, SPLIT,
            select="SELECT 'raw_sensor_records' AS table_name, " + stamped.format("count(*)") + " FROM readings "
            "UNION ALL SELECT 'cleaned_sensor_records', " + stamped.format("count(*)") + " FROM parts "
            "UNION ALL SELECT 'feature_statistics', " + stamped.format("3"),
        ),
        "repeated_appends": _with(
            GAPPY, SPLIT, CLEAN,
            select="SELECT 'raw_sensor_records' AS table_name, count(*) AS rows FROM readings "
            "UNION ALL SELECT 'cleaned_sensor_records', count(*) FROM clean "
            "UNION ALL SELECT 'model_predictions', 4 * count(*) FROM test "
            "UNION ALL SELECT 'anomaly_scores', 4 * count(*) FROM test "
            "UNION ALL SELECT 'evaluation_results', 4 UNION ALL SELECT 'feature_statistics', 3",
        ),
        "six_sensor_scores": _with(
            *_SIX_FITTED, *_SIX_SCORED,
            select="SELECT sample_id, machine_id, score, prediction AS rule_prediction, "
            f"{_explained('score', 'prediction')} AS explanation FROM scored JOIN named USING (sample_id)",
        ),
        "six_sensor_scaling": _with(
            *_SIX_FITTED,
            select="SELECT sample_id, split, " + _list(plain_round("($f - c_$f) / s_$f") + " AS $f__scaled")
            + " FROM parts, scaling",
        ),
        "six_sensor_statistics": _with(
            *_SIX_FITTED,
            select=" UNION ALL ".join(
                f"SELECT '{f}' AS feature_name, round(avg({f}), 4) AS mean, round(stddev_pop({f}), 4) AS std, "
                f"round(min({f}), 4) AS min, round(max({f}), 4) AS max, round(median({f}), 4) AS median FROM train"
                for f in SIX
            ),
        ),
        "six_sensor_moments": _with(
            *_SIX_FITTED,
            select=" UNION ALL ".join(
                f"SELECT '{one}' AS one, '{other}' AS other, round(covar_pop(({one} - c_{one}) / s_{one}, "
                f"({other} - c_{other}) / s_{other}), 4) AS covariance, count(*) AS rows FROM normal, scaling"
                for i, one in enumerate(SIX) for other in SIX[: i + 1]
            ),
        ),
        "six_sensor_table": _with(
            _SIX_LINES, select=f"SELECT sample_id, {', '.join(SIX)}, true AS payload_holds FROM readings"
        ),
        "forest_tree_totals": _with(
            EVENTS, SPLIT, CLEAN,
            select="SELECT tree, least(256, n) AS drawn_rows, least(256, n) AS root_rows, least(256, n) AS "
            "leaf_rows, 1 AS spare_leaves, true AS branched FROM range(200) AS t(tree), "
            "(SELECT count(*) AS n FROM normal)",
        ),
        "forest_limits": _with(
            EVENTS, SPLIT, CLEAN,
            select="SELECT n AS rows, CAST(n - ceil(least(CAST(0.99 AS DOUBLE), 1 - c / 2) * (n - 1)) AS BIGINT) "
            "AS flagged, true AS limit_holds, true AS fills_range, true AS scores_differ FROM "
            "(SELECT count(*) AS n FROM normal), (SELECT CASE WHEN min(failure_label) = 1 THEN CAST(0.08 AS DOUBLE) "
            "ELSE greatest(0.02, least(0.15, avg(failure_label) * 1.5)) END AS c FROM train)",
        ),
        "sequence_quality": _with(
            EVENTS, SPLIT,
            select="SELECT count(*) AS rows, count(*) AS probabilities, count(*) AS flags_agree, true AS "
            "better_than_chance FROM parts WHERE split = 'test'",
        ),
        "recurrent_quality": _with(
            EVENTS, SPLIT,
            select="SELECT count(*) AS rows, count(*) AS probabilities, count(*) AS flags_agree, true AS "
            "better_than_chance FROM parts WHERE split = 'test'",
        ),
        "bottleneck_quality": _with(
            EVENTS, SPLIT, CLEAN,
            select="SELECT count(*) AS rows, count(*) AS errors, CAST(count(*) - ceil(CAST(0.95 AS DOUBLE) * "
            "(count(*) - 1)) AS BIGINT) AS flagged, true AS limit_holds, true AS learnt FROM normal",
        ),
        "streamed_windows": _with(
            EVENTS,
            "\nlined AS (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY moment, sample_id) AS place "
            "FROM readings)",
            select="SELECT sample_id, machine_id, string_agg(CAST(CAST(t AS BIGINT) AS VARCHAR) || ':' || "
            "CAST(CAST(round(v * 100) AS BIGINT) AS VARCHAR), ' ' ORDER BY step) AS window FROM ("
            "SELECT now.sample_id, now.machine_id, step, past.torque AS t, past.vibration AS v FROM lined AS now, "
            "range(8) AS s(step) JOIN lined AS past ON past.machine_id = now.machine_id "
            "AND past.place = greatest(1, now.place - 7 + step)) GROUP BY sample_id, machine_id",
        ),
        "sequence_skipped": _with(
            EVENTS, SPLIT,
            select="SELECT sample_id, machine_id, CAST(0 AS DOUBLE) AS score, 0 AS prediction, 'skipped' AS status, "
            "'The sequence detector needs train readings with and without failure.' AS notes FROM parts "
            "WHERE split = 'test'",
        ),
        "saved_differences": _with(
            EVENTS, SPLIT, select=f"SELECT sample_id, machine_id, {zeros} FROM parts WHERE split = 'test'"
        ),
        "pretrained_scores": _prepared(
            EVENTS, DEVIATED, EXCESS, RECON, *_DRIFTED,
            select="SELECT sample_id, machine_id, round_even(least(share, 1) * 1e6, 0) / 1e6 AS rule_based_score, "
            "CASE WHEN share >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS rule_based_prediction, "
            "CAST(round_even(greatest(0, least(1, (err - lo) / greatest(hi - lo, 1e-8))) * 1e6, 0) AS BIGINT) // 100 "
            "AS autoencoder_score, CASE WHEN err >= lim THEN 1 ELSE 0 END AS autoencoder_prediction FROM shares",
        ),
        "pretrained_run": _prepared(
            EVENTS, DEVIATED, EXCESS, SCALE,
            "\nshifted AS (SELECT * REPLACE (torque * 2 + 50 AS torque, vibration + 10 AS vibration) FROM test)",
            DEVIATED.replace("deviated AS", "moved AS").replace("test.*", "shifted.*").replace("FROM test", "FROM shifted"),
            f"\nshares AS (SELECT *, {_excess('2.5')} / (SELECT greatest(max(x_sigma_2_5), 1) FROM excess) AS share FROM moved)",
            "\njudged AS (SELECT *, round_even(least(share, 1) * 1e6, 0) / 1e6 AS score, "
            "CASE WHEN share >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS prediction FROM shares)",
            DEVIATIONS.replace("deviated", "moved"),
            select="SELECT judged.sample_id, machine_id, score, prediction AS predicted_label, "
            f"{plain_round('(vibration - c_vibration) / s_vibration')} AS scaled_vibration, "
            f"{_explained('score', 'prediction')} AS explanation "
            "FROM judged JOIN named ON judged.sample_id = named.sample_id, scaling",
        ),
        "running_statistics": _with(
            GAPPY,
            "\nwhole AS (SELECT " + ", ".join(f"median({f}) AS m_{f}" for f in SENSORS) + " FROM readings)",
            "\nfilled AS (SELECT " + ", ".join(f"coalesce({f}, m_{f}) AS {f}" for f in SENSORS) + " FROM readings, whole)",
            select=" UNION ALL ".join(
                f"SELECT '{f}' AS feature_name, round(avg({f}), 4) AS mean, round(stddev_pop({f}), 4) AS std, "
                f"round(min({f}), 4) AS min, round(max({f}), 4) AS max, round(median({f}), 4) AS median FROM filled"
                for f in SENSORS
            ),
        ),
        "pretrained_statistics": _with(
            EVENTS, SPLIT, CLEAN,
            select=" UNION ALL ".join(
                f"SELECT '{f}' AS feature_name, round(avg({f}), 4) AS mean, round(stddev_pop({f}), 4) AS std, "
                f"round(min({f}), 4) AS min, round(max({f}), 4) AS max, round(median({f}), 4) AS median FROM train"
                for f in SENSORS
            ),
        ),
        "report_of_two": _prepared(
            LINES, DEVIATED, EXCESS, SCORED, RECON, _TWO, METRICS,
            select="SELECT display_name AS model, "
            + ", ".join(_cell(n) for n in ("accuracy", "precision", "recall", "f1", "roc_auc"))
            + ", verdict FROM verdicts",
        ),
        "full_run_of_two": _prepared(
            EVENTS, DEVIATED, EXCESS, SCORED, RECON, _TWO, METRICS,
            select="SELECT kept_as, model_name, "
            + ", ".join(f"round({n}, 6) AS {n}" for n in ("accuracy", "precision", "recall", "f1", "roc_auc"))
            + ", support, flagged_count, verdict FROM verdicts, (VALUES ('table'), ('document')) AS k(kept_as)",
        ),
        "inference_limits": _prepared(
            EVENTS, DEVIATED, EXCESS, SCORED, RECON,
            select="SELECT 'rule_based' AS model_name, CAST(0.5 AS DOUBLE) AS threshold, 'ok' AS status, "
            "sum(sigma_2_5_prediction) AS flagged FROM scored UNION ALL SELECT 'autoencoder', "
            "round(greatest(0, least(1, max(lim))), 4), 'ok', count(*) FILTER (WHERE err >= lim) FROM errors, limits "
            "WHERE split = 'test' UNION ALL SELECT 'lstm', 0.5, 'ok', NULL",
        ),
    }
