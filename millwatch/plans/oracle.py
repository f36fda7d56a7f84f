"""SQL equivalents of the deterministic catalog queries.

Written independently of the Spark code, in plain SQL, to check its results.
"""

from __future__ import annotations

SENSORS = ("torque", "tool_wear", "vibration")
VARIANTS = {"sigma_1_5": "1.5", "sigma_2_5": "2.5", "sigma_4": "4.0", "sigma_6": "6.0"}

EVENTS = """
readings AS (
  SELECT event_id + 1 AS sample_id, CAST(user_id AS VARCHAR) AS machine_id,
    date_trunc('second', ts) AS moment, torque, tool_wear, value AS vibration,
    CASE WHEN (value >= 110 OR tool_wear >= 100000) AND event_type <> 'view'
      THEN 1 ELSE 0 END AS failure_label
  FROM (
    SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS torque,
      COALESCE((epoch_us(ts) - lag(epoch_us(ts)) OVER (
        PARTITION BY user_id ORDER BY ts, event_id)) / 1e6, 0) AS tool_wear
    FROM events)
)"""

GAPPY = EVENTS.replace("readings AS", "full_readings AS") + """,
readings AS (
  SELECT sample_id, machine_id, moment,
    CASE WHEN (sample_id - 1) % 23 <> 0 THEN torque END AS torque, tool_wear,
    CASE WHEN (sample_id - 1) % 17 <> 0 THEN vibration END AS vibration, failure_label
  FROM full_readings
)"""

LINES = """
readings AS (
  SELECT sample_id, CAST(l_suppkey AS VARCHAR) AS machine_id, l_shipdate AS moment, torque,
    l_quantity AS tool_wear, vibration,
    CASE WHEN (vibration >= CAST(1.2 AS DOUBLE) OR torque >= CAST(7.5 AS DOUBLE))
      AND l_returnflag <> 'A' THEN 1 ELSE 0 END AS failure_label
  FROM (
    SELECT *, l_extendedprice * l_discount / 1000 AS torque,
      l_extendedprice * l_discount * l_tax / 100 AS vibration,
      row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey,
        l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS sample_id
    FROM lineitem)
)"""

SPLIT = """
placed AS (
  SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY moment, sample_id) AS place,
    count(*) OVER (PARTITION BY machine_id) AS n
  FROM readings WHERE machine_id IS NOT NULL),
first_ends AS (
  SELECT *, greatest(1, n * 6 // 10) AS a,
    greatest(greatest(1, n * 6 // 10) + 1, n * 8 // 10) AS b FROM placed),
second_ends AS (SELECT * REPLACE (CASE WHEN b >= n THEN n - 1 ELSE b END AS b) FROM first_ends),
ends AS (SELECT * REPLACE (CASE WHEN a >= b THEN greatest(1, b - 1) ELSE a END AS a)
  FROM second_ends),
parts AS (
  SELECT *, 'train' AS split, place AS split_position FROM ends WHERE place <= a
  UNION ALL SELECT *, 'validation', place - a FROM ends WHERE place > a AND place <= b
  UNION ALL SELECT *, 'test', place - b FROM ends WHERE place > b)"""



def plain_round(value: str, digits: int = 4) -> str:
    """Rounded without a negative zero, which Spark's rounding does not give."""
    return f"CASE WHEN round({value}, {digits}) = 0 THEN CAST(0 AS DOUBLE) ELSE round({value}, {digits}) END"


CLEAN = """
medians AS (
  SELECT COALESCE(median(torque), 0) AS m_torque, COALESCE(median(tool_wear), 0) AS m_tool_wear,
    COALESCE(median(vibration), 0) AS m_vibration
  FROM parts WHERE split = 'train'),
clean AS (
  SELECT sample_id, machine_id, moment, failure_label, split, split_position,
    COALESCE(torque, m_torque) AS torque, COALESCE(tool_wear, m_tool_wear) AS tool_wear,
    COALESCE(vibration, m_vibration) AS vibration
  FROM parts, medians),
train AS (SELECT * FROM clean WHERE split = 'train'),
test AS (SELECT * FROM clean WHERE split = 'test'),
normal AS (
  SELECT * FROM train
  WHERE failure_label = 0 OR NOT EXISTS (SELECT 1 FROM train WHERE failure_label = 0))"""

REFERENCE = "\nreference AS (SELECT " + ", ".join(
    f"avg({f}) AS mean_{f}, greatest(stddev_pop({f}), 1e-6) AS std_{f}" for f in SENSORS
) + ", count(*) AS rows FROM normal)"

SCALE = "\nscaling AS (SELECT " + ", ".join(
    f"avg({f}) AS c_{f}, CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END AS s_{f}"
    for f in SENSORS
) + " FROM train),\nscaled AS (SELECT clean.*, " + ", ".join(
    f"({f} - c_{f}) / s_{f} AS {f}__scaled" for f in SENSORS
) + " FROM clean, scaling)"

DEVIATED = "\ndeviated AS (SELECT test.*, " + ", ".join(
    f"abs(({f} - mean_{f}) / std_{f}) AS z_{f}" for f in SENSORS
) + " FROM test, reference)"


def _excess(sigma: str) -> str:
    limit = f"CAST({sigma} AS DOUBLE)"
    return f"greatest(z_torque - {limit}, z_tool_wear - {limit}, z_vibration - {limit}, 0)"


EXCESS = "\nexcess AS (SELECT *, " + ", ".join(
    f"{_excess(sigma)} AS x_{name}" for name, sigma in VARIANTS.items()
) + " FROM deviated)"

SCORED = "\nunits AS (SELECT " + ", ".join(
    f"greatest(max(x_{n}), 1) AS u_{n}" for n in VARIANTS
) + " FROM excess),\nscored AS (SELECT excess.*, " + ", ".join(
    f"CASE WHEN x_{n} / u_{n} >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS {n}_prediction, "
    f"round_even(least(x_{n} / u_{n}, 1) * 1e6, 0) / 1e6 AS {n}_score"
    for n in VARIANTS
) + " FROM excess, units)"

LONG = "\nlong AS (" + " UNION ALL ".join(
    f"SELECT *, '{n}' AS model_name, 'Rule {s}' AS display_name, {i} AS model_order, "
    f"{n}_score AS score, {n}_prediction AS prediction FROM scored"
    for i, (n, s) in enumerate(VARIANTS.items())
) + ")"

# AUC by ranks with half ties, per model.
METRICS = """
ranked AS (
  SELECT model_name, failure_label,
    (rank() OVER (PARTITION BY model_name ORDER BY score) +
     (count(*) OVER (PARTITION BY model_name, score) - 1) / 2.0::DOUBLE)::DOUBLE AS mid_rank
  FROM long),
areas AS (
  SELECT model_name,
    CASE WHEN min(failure_label) < max(failure_label) THEN
      (sum(mid_rank) FILTER (WHERE failure_label = 1)
        - sum(failure_label)::DOUBLE * (sum(failure_label) + 1) / 2)
      / (sum(failure_label)::DOUBLE * sum(1 - failure_label)) END AS roc_auc
  FROM ranked GROUP BY model_name),
cells AS (
  SELECT model_name, display_name, model_order, count(*) AS support,
    count(*) FILTER (WHERE prediction = 1 AND failure_label = 1) AS tp,
    count(*) FILTER (WHERE prediction = 1 AND failure_label = 0) AS fp,
    count(*) FILTER (WHERE prediction = 0 AND failure_label = 1) AS fn,
    count(*) FILTER (WHERE prediction = 0 AND failure_label = 0) AS tn
  FROM long GROUP BY ALL),
metrics AS (
  SELECT *, (tp + tn) / support AS accuracy, COALESCE(tp / nullif(tp + fp, 0), 0) AS precision,
    COALESCE(tp / nullif(tp + fn, 0), 0) AS recall,
    COALESCE(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, tp + fp AS flagged_count
  FROM cells JOIN areas USING (model_name)),
verdicts AS (
  SELECT *, CASE WHEN f1 >= CAST(0.75 AS DOUBLE) THEN 'Strong'
    WHEN f1 >= CAST(0.6 AS DOUBLE) THEN 'Good'
    WHEN f1 >= CAST(0.45 AS DOUBLE) THEN 'Decent' ELSE 'Weak' END AS verdict FROM metrics),
best AS (SELECT * FROM verdicts ORDER BY f1 DESC, recall DESC, accuracy DESC, model_order LIMIT 1)"""


def _r(expression: str, digits: int = 3) -> str:
    """Decimal rounding of the exact binary value."""
    return f"CAST(format('{{:.{digits}f}}', {expression}) AS DOUBLE)"


def _health(score: str) -> str:
    return f"round_even(greatest(0, least(100, 100 * (1 - {score}))) * 1000, 0) / 1000"


def _band(health: str) -> str:
    return (
        f"CASE WHEN {health} >= 80 THEN 'Healthy' WHEN {health} >= 55 THEN 'Watch' "
        f"WHEN {health} >= 30 THEN 'Risky' ELSE 'Critical' END"
    )


def _risk(score: str) -> str:
    return (
        f"CASE WHEN {score} >= CAST(0.7 AS DOUBLE) THEN 'HIGH RISK' "
        f"WHEN {score} >= CAST(0.4 AS DOUBLE) THEN 'MONITOR' ELSE 'NORMAL' END"
    )


def _label(flag: str) -> str:
    return f"CASE WHEN {flag} = 1 THEN 'FAILURE' ELSE 'NORMAL' END"


def _explained(score: str, flag: str) -> str:
    return (
        f"CASE WHEN {flag} = 1 THEN 'Risk score ' || format('{{:.2f}}', {score}) || "
        "': elevated readings in ' || sensors || ' pushed this sample into the alert range.' "
        f"ELSE 'Risk score ' || format('{{:.2f}}', {score}) || ': readings stayed near the "
        "training baseline, with the largest movement in ' || sensors || '.' END"
    )


DEVIATIONS = "\nentries AS (" + " UNION ALL ".join(
    f"SELECT sample_id, machine_id, moment, {i} AS idx, '{f}' AS feature, {_r('z_' + f)} AS z_score "
    "FROM deviated"
    for i, f in enumerate(SENSORS)
) + """),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY z_score DESC, idx) AS place
  FROM entries),
named AS (
  SELECT sample_id,
    string_agg(feature || ' (' || format('{:.1f}', z_score) || 'z)', ', ' ORDER BY place)
      AS sensors,
    string_agg(feature, ', ' ORDER BY place) AS top_features
  FROM ordered WHERE place <= 3 GROUP BY sample_id)"""

# The best model's view of every test row.
CHOSEN = "\nchosen AS (SELECT scored.*, best.model_name, " + ", ".join(
    "CASE best.model_name " + " ".join(f"WHEN '{n}' THEN {n}_{c}" for n in VARIANTS) + f" END AS {c}"
    for c in ("score", "prediction")
) + """ FROM scored, best),
records AS (
  SELECT chosen.*, sensors, top_features, """ + f"""{_r('score')} AS shown,
    {_health('score')} AS health, {_label('failure_label')} AS true_label,
    {_label('prediction')} AS predicted_label
  FROM chosen JOIN named USING (sample_id))"""

VOTES = """
signals AS (
  SELECT * FROM records
  WHERE prediction = 1 OR failure_label = 1 OR shown >= CAST(0.6 AS DOUBLE)),
votes AS (
  SELECT feature, ordered.sample_id, row_number() OVER (
    ORDER BY ordered.machine_id, ordered.moment, ordered.sample_id, place) AS seen
  FROM ordered JOIN signals USING (sample_id) WHERE place <= 2),
importance AS (
  SELECT feature, count(*) AS mentions, min(seen) AS first_seen,
    arg_min(sample_id, seen) AS sample_id
  FROM votes GROUP BY feature),
report AS (
  SELECT *, row_number() OVER (ORDER BY mentions DESC, first_seen) AS rank FROM importance)"""


def _with(*parts: str, select: str) -> str:
    return "WITH" + ",".join(parts) + "\n" + select


def _prepared(readings: str, *more: str, select: str) -> str:
    return _with(readings, SPLIT, CLEAN, REFERENCE, *more, select=select)


def _evaluated(readings: str, *more: str, select: str) -> str:
    return _prepared(
        readings, DEVIATED, EXCESS, SCORED, LONG, METRICS, DEVIATIONS, CHOSEN, *more, select=select
    )


def _each_sensor(template: str) -> str:
    return " UNION ALL ".join(template.replace("$f", f) for f in SENSORS)


ISO = "strftime(moment, '%Y-%m-%dT%H:%M:%S')"
READING = f"sample_id, machine_id, {ISO} AS timestamp, "

_STATISTICS = _each_sensor(
    "SELECT '$f' AS feature_name, round(avg($f), 4) AS mean, round(stddev_pop($f), 4) AS std, "
    "round(min($f), 4) AS min, round(max($f), 4) AS max, round(median($f), 4) AS median FROM train"
)
_REFERENCE_ROWS = _each_sensor(
    "SELECT '$f' AS feature_name, round(mean_$f, 4) AS mean, round(std_$f, 4) AS std, rows "
    "FROM reference"
)
_RULE_ROWS = (
    f"SELECT sample_id, machine_id, sigma_2_5_score AS score, sigma_2_5_prediction AS "
    f"rule_prediction, {_health('sigma_2_5_score')} AS health, "
    f"{_r(_health('sigma_2_5_score'), 2)} AS shown_health, "
    f"{_band(_health('sigma_2_5_score'))} AS band, {_r('sigma_2_5_score')} AS shown_score, "
    f"{_risk(_r('sigma_2_5_score'))} AS risk, {_label('sigma_2_5_prediction')} AS predicted_label, "
    f"{_label('failure_label')} AS true_label FROM scored"
)
_METRIC_ROWS = (
    "SELECT model_name, display_name, 'ok' AS status, '' AS notes, round(accuracy, 6) AS accuracy, "
    "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, "
    "round(roc_auc, 6) AS roc_auc, support, flagged_count, verdict FROM verdicts"
)

_ROC_STEPS = f"""
steps AS (
  SELECT model_name, {_r('score')} AS threshold,
    count(*) FILTER (WHERE failure_label = 1) AS up,
    count(*) FILTER (WHERE failure_label = 0) AS across
  FROM long GROUP BY ALL),
summed AS (
  SELECT model_name, threshold,
    sum(up) OVER w AS tps, sum(across) OVER w AS fps,
    sum(up) OVER (PARTITION BY model_name) AS p, sum(across) OVER (PARTITION BY model_name) AS n
  FROM steps WINDOW w AS (PARTITION BY model_name ORDER BY threshold DESC)),
bends AS (
  SELECT *, (lead(tps) OVER v - tps) <> (tps - lag(tps) OVER v)
      OR (lead(fps) OVER v - fps) <> (fps - lag(fps) OVER v) AS bend
  FROM summed WINDOW v AS (PARTITION BY model_name ORDER BY threshold DESC))"""
_ROC_START = (
    "SELECT DISTINCT model_name, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr, "
    "CAST(NULL AS DOUBLE) AS threshold FROM summed UNION ALL "
    "SELECT model_name, fps::DOUBLE / n::DOUBLE AS fpr, tps::DOUBLE / p::DOUBLE AS tpr, threshold "
)

_HISTOGRAM = f"""
shown_scores AS (SELECT model_name, {_r('score')} AS s FROM long),
ranges AS (
  SELECT model_name, CASE WHEN min(s) = max(s) THEN min(s) - CAST(0.5 AS DOUBLE) ELSE min(s) END AS lo,
    CASE WHEN min(s) = max(s) THEN max(s) + CAST(0.5 AS DOUBLE) ELSE max(s) END AS hi
  FROM shown_scores GROUP BY model_name),
bins AS (
  SELECT model_name, bin, lo + bin * ((hi - lo) / 16) AS edge,
    CASE WHEN bin = 15 THEN hi ELSE lo + (bin + 1) * ((hi - lo) / 16) END AS next_edge
  FROM ranges, range(16) AS t(bin))"""

_RANKS = """
ranks AS (
  SELECT *, row_number() OVER (
    PARTITION BY model_name ORDER BY score DESC, machine_id, moment, sample_id) AS rank
  FROM long)"""
_LONG_ROWS = (
    f"SELECT ranks.sample_id, machine_id, model_name, prediction AS predicted_label, "
    f"{_health('score')} AS health_score, {_explained('score', 'prediction')} AS explanation, "
    f"score AS anomaly_score, CAST(0.5 AS DOUBLE) AS threshold, rank "
    f"FROM ranks JOIN named ON ranks.sample_id = named.sample_id"
)
_RANKING_COLUMNS = (
    f"sample_id, machine_id, shown AS score, predicted_label, true_label, "
    f"{_r('health', 2)} AS health_score, {_explained('shown', 'prediction')} AS explanation"
)
_RANKING_ORDER = "ORDER BY shown DESC, machine_id, moment, sample_id"
_SAMPLE_MODELS = ", ".join(
    f"{_label(n + '_prediction')} AS {n}_prediction, {_r(n + '_score')} AS {n}_score, "
    f"{n}_prediction AS {n}_flag"
    for n in VARIANTS
)
_SAMPLES = (
    f"SELECT {READING} true_label, {_r('health', 2)} AS health_score, {_band('health')} AS "
    f"health_label, {_explained('shown', 'prediction')} AS explanation, {_SAMPLE_MODELS} "
    "FROM records"
)
_ERRORS = " UNION ALL ".join(
    f"(SELECT '{kind}' AS kind, sample_id, machine_id, shown AS score, top_features, "
    f"{_explained('shown', 'prediction')} AS explanation FROM records "
    f"WHERE failure_label = {label} AND prediction = {flag} {_RANKING_ORDER} LIMIT 5)"
    for kind, label, flag in (("false positive", 0, 1), ("false negative", 1, 0))
)
_MODES = " UNION ALL ".join(
    f"SELECT '{mode}' AS mode, sample_id, machine_id FROM records WHERE {test}"
    for mode, test in (
        ("All samples", "true"), ("Failures only", "failure_label = 1"),
        ("Anomalies only", "prediction = 1"),
        ("False positives", "failure_label = 0 AND prediction = 1"),
        ("False negatives", "failure_label = 1 AND prediction = 0"),
    )
)
_TITLE = (
    "CASE feature WHEN 'torque' THEN 'Torque' WHEN 'tool_wear' THEN 'Tool Wear' "
    "WHEN 'vibration' THEN 'Vibration' END"
)
_MISSING = '["air_temperature","process_temperature","rotational_speed"]'


def _cell(name: str) -> str:
    return f"COALESCE(format('{{:.3f}}', {name}), 'n/a') AS {name}"


# Smallest eigenvector of the 3x3 covariance of the scaled normal rows, in
# closed form: the one direction that two of three components cannot carry.
RECON = SCALE + """,
fit AS (
  SELECT *, p / 6 AS unused FROM (
    SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS a, var_pop(y) AS b,
      var_pop(z) AS c, covar_pop(x, y) AS d, covar_pop(x, z) AS e, covar_pop(y, z) AS f,
      0 AS p, count(*) AS rows
    FROM (
      SELECT torque__scaled AS x, tool_wear__scaled AS y, vibration__scaled AS z
      FROM scaled
      WHERE split = 'train' AND (failure_label = 0
        OR NOT EXISTS (SELECT 1 FROM train WHERE failure_label = 0))))),
mean_eigen AS (SELECT *, (a + b + c) / 3 AS q FROM fit),
spread AS (
  SELECT *, sqrt(((a - q)^2 + (b - q)^2 + (c - q)^2 + 2 * (d^2 + e^2 + f^2)) / 6) AS w
  FROM mean_eigen),
angle AS (
  SELECT *, acos(greatest(-1, least(1, (
      (a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e)
      + e * (d * f - (b - q) * e)) / (2 * w^3)))) / 3 AS phi
  FROM spread),
least_eigen AS (SELECT *, q + 2 * w * cos(phi + 2 * pi() / 3) AS k FROM angle),
crossed AS (
  SELECT *, [d * f - e * (b - k), e * d - (a - k) * f, (a - k) * (b - k) - d * d] AS c1,
    [d * (c - k) - e * f, e * e - (a - k) * (c - k), (a - k) * f - d * e] AS c2,
    [(b - k) * (c - k) - f * f, f * e - d * (c - k), d * f - (b - k) * e] AS c3
  FROM least_eigen),
sized AS (
  SELECT *, list_inner_product(c1, c1) AS n1, list_inner_product(c2, c2) AS n2,
    list_inner_product(c3, c3) AS n3
  FROM crossed),
direction AS (
  SELECT mx, my, mz, rows, CASE WHEN n1 >= n2 AND n1 >= n3 THEN c1 WHEN n2 >= n3 THEN c2 ELSE c3 END AS v,
    sqrt(greatest(n1, n2, n3)) AS len
  FROM sized),
errors AS (
  SELECT scaled.*, ((v[1] * (torque__scaled - mx) + v[2] * (tool_wear__scaled - my)
    + v[3] * (vibration__scaled - mz)) / len)^2 / 3 AS err
  FROM scaled, direction),
limits AS (
  SELECT min(err) AS lo, max(err) AS hi, quantile_cont(err, 0.95) AS lim
  FROM errors WHERE split = 'train' AND (failure_label = 0
    OR NOT EXISTS (SELECT 1 FROM train WHERE failure_label = 0)))"""
_RECON_ROWS = (
    "SELECT sample_id, machine_id, "
    "round(greatest(0, least(1, (err - lo) / greatest(hi - lo, 1e-8))), 4) AS score, "
    "CASE WHEN err >= lim THEN 1 ELSE 0 END AS prediction, "
    "round(greatest(0, least(1, lim)), 4) AS threshold FROM errors, limits WHERE split = 'test'"
)
_COVARIANCES = {
    ("torque", "torque"): "a", ("tool_wear", "torque"): "d", ("tool_wear", "tool_wear"): "b",
    ("vibration", "torque"): "e", ("vibration", "tool_wear"): "f", ("vibration", "vibration"): "c",
}


def oracle() -> dict[str, str]:
    rounded = ", ".join(f"round({f}, 6) AS {f}" for f in SENSORS)
    text_rows = _with(EVENTS, select=f"SELECT {READING}{rounded}, failure_label FROM readings")
    split_rows = "SELECT sample_id, machine_id, split, split_position FROM parts"
    one_machine = EVENTS.replace("CAST(user_id AS VARCHAR)", "'M-001'")
    all_scored = "SELECT sample_id, machine_id, " + (
        "round_even(least(x / unit, 1) * 1e6, 0) / 1e6 AS score, "
        "CASE WHEN x / unit >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS rule_prediction FROM ("
        f"SELECT sample_id, machine_id, {_excess('2.5')} AS x, "
        "(SELECT greatest(max(x_sigma_2_5), 1) FROM excess) AS unit FROM ("
        "SELECT sample_id, machine_id, "
        + ", ".join(
            f"abs((COALESCE({f}, m_{f}) - mean_{f}) / std_{f}) AS z_{f}" for f in SENSORS
        )
        + " FROM readings, medians, reference))"
    )
    frozen = _prepared(GAPPY, DEVIATED, EXCESS, select=all_scored)
    return {
        "hot_machine_split": _with(one_machine, SPLIT, select=split_rows),
        "hot_machine_windows": _with(
            one_machine, SPLIT,
            select="SELECT now.sample_id, now.machine_id, now.split, "
            "string_agg(CAST(CAST(past.torque AS BIGINT) AS VARCHAR), ' ' ORDER BY step) AS window "
            "FROM parts AS now, range(8) AS s(step) JOIN parts AS past ON past.split = now.split "
            "AND past.split_position = greatest(1, now.split_position - 7 + step) "
            "GROUP BY now.sample_id, now.machine_id, now.split",
        ),
        "bracketed_quantiles": " UNION ALL ".join(
            f"SELECT '{c}' AS column, "
            + ", ".join(f"round(quantile_cont({c}, {q / 100}), 4) AS q{q}" for q in (25, 50, 95))
            + ", count(*) AS rows FROM lineitem"
            for c in ("l_quantity", "l_extendedprice", "l_discount")
        ),
        "frozen_rule_scores": frozen,
        "streamed_rule_scores": frozen,
        "readings_events": _with(
            EVENTS,
            select=f"SELECT {READING}torque, round(tool_wear, 6) AS tool_wear, vibration, "
            "failure_label FROM readings",
        ),
        "readings_lines": _with(
            LINES,
            select=f"SELECT {READING}torque, tool_wear, vibration, failure_label FROM readings",
        ),
        "aliased_columns": text_rows,
        "csv_round_trip": text_rows,
        "column_renames": "SELECT original, canonical, (SELECT count(*) FROM events) AS rows FROM "
        "(VALUES ('Product ID', 'machine_id'), ('Event Time', 'timestamp'), "
        "('Torque [Nm]', 'torque'), ('Tool wear [min]', 'tool_wear'), ('Vibe', 'vibration'), "
        "('Machine failure', 'failure_label')) AS t(original, canonical)",
        "timeline_fill": "SELECT event_id + 1 AS sample_id, 'M-001' AS machine_id, "
        "strftime(TIMESTAMP '2026-01-01 00:00:00' + to_minutes(5 * event_id), "
        "'%Y-%m-%dT%H:%M:%S') AS timestamp, value AS vibration, 0 AS failure_label FROM events",
        "label_words": "SELECT event_id, "
        "CASE WHEN k IN (0, 2, 3, 5, 6) THEN 1 ELSE 0 END AS text_label, "
        "CASE WHEN k < 8 AND k - 3 > 0 THEN 1 ELSE 0 END AS number_label, "
        "CASE WHEN k > 4 THEN 1 ELSE 0 END AS double_label, "
        "CASE WHEN k = 5 THEN 1 ELSE 0 END AS flag_label "
        "FROM (SELECT event_id, event_id % 9 AS k FROM events)",
        "numeric_coercion": "SELECT event_id, CASE event_id % 7 WHEN 3 THEN 1000 "
        "WHEN 4 THEN CAST(0.5 AS DOUBLE) WHEN 6 THEN value END AS reading FROM events",
        "null_tokens": "SELECT event_type, count(*) FILTER (WHERE event_id % 8 >= 6) AS present, "
        "count(*) FILTER (WHERE event_id % 8 < 6) AS missing FROM events GROUP BY event_type",
        "file_row_numbers": "SELECT row_number() OVER (ORDER BY event_id) AS sample_id, event_id "
        "FROM events",
        "preview_counts": "SELECT count(*) AS rows, 7 AS features, "
        "CAST(count(DISTINCT user_id) AS VARCHAR) AS machines, 'Yes' AS failure_labels FROM events",
        "preview_rows": _with(
            EVENTS,
            select="SELECT sample_id, machine_id, torque, vibration, failure_label FROM readings "
            "ORDER BY sample_id LIMIT 25",
        ),
        "class_distribution": _with(
            EVENTS,
            select="SELECT 'Normal' AS class, count(*) FILTER (WHERE failure_label = 0) AS rows "
            "FROM readings UNION ALL SELECT 'Failure', count(*) FILTER (WHERE failure_label = 1) "
            "FROM readings",
        ),
        "chrono_split_events": _with(EVENTS, SPLIT, select=split_rows),
        "chrono_split_lines": _with(LINES, SPLIT, select=split_rows),
        "split_size_counts": _with(
            EVENTS, SPLIT, select="SELECT split, count(*) AS rows FROM parts GROUP BY split"
        ),
        "short_timelines": _with(
            "\nreadings AS (SELECT CAST(l_orderkey AS VARCHAR) AS machine_id, l_shipdate AS moment, "
            "row_number() OVER () AS sample_id FROM lineitem)",
            SPLIT,
            select="SELECT split, count(*) AS rows FROM parts GROUP BY split",
        ),
        "train_medians": _with(
            GAPPY, SPLIT, CLEAN,
            select=_each_sensor(
                "SELECT '$f' AS feature_name, round(m_$f, 4) AS median FROM medians"
            ),
        ),
        "imputed_gaps": _with(
            GAPPY, SPLIT, CLEAN, select=f"SELECT sample_id, machine_id, split, {rounded} FROM clean"
        ),
        "feature_statistics_events": _with(GAPPY, SPLIT, CLEAN, select=_STATISTICS),
        "feature_statistics_lines": _with(LINES, SPLIT, CLEAN, select=_STATISTICS),
        "scaled_features": _with(
            LINES, SPLIT, CLEAN, SCALE,
            select="SELECT sample_id, machine_id, split, "
            + ", ".join(f"{plain_round(f + '__scaled')} AS {f}__scaled" for f in SENSORS)
            + " FROM scaled",
        ),
        "reference_stats_events": _prepared(EVENTS, select=_REFERENCE_ROWS),
        "reference_stats_lines": _prepared(LINES, select=_REFERENCE_ROWS),
        "contamination_rate": _with(
            LINES, SPLIT, CLEAN,
            select="SELECT count(*) AS train_rows, round(CASE WHEN count(*) FILTER "
            "(WHERE failure_label = 0) = 0 THEN CAST(0.08 AS DOUBLE) ELSE "
            "greatest(0.02, least(0.15, avg(failure_label) * 1.5)) END, 6) AS contamination "
            "FROM train",
        ),
        "lag_windows": _with(
            EVENTS, SPLIT,
            select="SELECT sample_id, machine_id, split, "
            "string_agg(CAST(CAST(t AS BIGINT) AS VARCHAR) || ':' || "
            "CAST(CAST(round(v * 100) AS BIGINT) AS VARCHAR), ' ' ORDER BY step) AS window "
            "FROM (SELECT now.sample_id, now.machine_id, now.split, step, "
            "past.torque AS t, past.vibration AS v FROM parts AS now, range(8) AS s(step) "
            "JOIN parts AS past ON past.machine_id = now.machine_id AND past.split = now.split "
            "AND past.split_position = greatest(1, now.split_position - 7 + step)) "
            "GROUP BY sample_id, machine_id, split",
        ),
        "rule_scores_events": _prepared(EVENTS, DEVIATED, EXCESS, SCORED, select=_RULE_ROWS),
        "rule_scores_lines": _prepared(LINES, DEVIATED, EXCESS, SCORED, select=_RULE_ROWS),
        "batch_maximum": _prepared(
            LINES, DEVIATED, EXCESS,
            select="SELECT count(*) FILTER (WHERE x_sigma_2_5 > 0) AS rows_beyond, "
            "round(greatest(max(x_sigma_2_5), 1), 6) AS batch_maximum FROM excess",
        ),
        "variant_metrics_events": _prepared(
            EVENTS, DEVIATED, EXCESS, SCORED, LONG, METRICS, select=_METRIC_ROWS
        ),
        "variant_metrics_lines": _prepared(
            LINES, DEVIATED, EXCESS, SCORED, LONG, METRICS, select=_METRIC_ROWS
        ),
        "roc_curves": _prepared(
            LINES, DEVIATED, EXCESS, SCORED, LONG, _ROC_STEPS,
            select=_ROC_START + "FROM bends WHERE bend IS NULL OR bend",
        ),
        "roc_points": _prepared(
            LINES, DEVIATED, EXCESS, SCORED, LONG, _ROC_STEPS, select=_ROC_START + "FROM bends"
        ),
        "confusion_matrix": _prepared(
            LINES, DEVIATED, EXCESS, SCORED,
            select=f"SELECT {_label('t')} AS true_label, {_label('p')} AS predicted_label, "
            "count(sample_id) AS rows FROM range(2) AS a(t), range(2) AS b(p) LEFT JOIN scored "
            "ON failure_label = t AND sigma_2_5_prediction = p GROUP BY t, p",
        ),
        "score_histogram": _prepared(
            EVENTS, DEVIATED, EXCESS, SCORED, LONG, _HISTOGRAM,
            select="SELECT bins.model_name, bin, round(edge, 6) AS bin_start, count(s) AS rows "
            "FROM bins LEFT JOIN shown_scores ON bins.model_name = shown_scores.model_name "
            "AND s >= edge AND (s < next_edge OR (bin = 15 AND s <= next_edge)) "
            "GROUP BY bins.model_name, bin, edge",
        ),
        "fault_summary": _prepared(
            EVENTS, DEVIATED, EXCESS, SCORED, LONG, METRICS,
            select="SELECT model_name, display_name, tp AS caught, tp + fn AS true_failures, "
            "flagged_count AS flagged FROM metrics",
        ),
        "leaderboard": _prepared(
            LINES, DEVIATED, EXCESS, SCORED, LONG, METRICS,
            select="SELECT verdicts.display_name AS model, "
            + ", ".join(
                _cell(n).replace(n, f"verdicts.{n}", 1)
                for n in ("accuracy", "precision", "recall", "f1", "roc_auc")
            )
            + ", verdicts.verdict, verdicts.model_name = best.model_name AS best "
            "FROM verdicts, best",
        ),
        "f1_chart": _prepared(
            LINES, DEVIATED, EXCESS, SCORED, LONG, METRICS,
            select="SELECT display_name, round(f1, 6) AS f1 FROM metrics",
        ),
        "top_anomalies": _evaluated(
            EVENTS,
            select=f"SELECT {_RANKING_COLUMNS}, {_risk('shown')} AS risk FROM records "
            f"{_RANKING_ORDER} LIMIT 10",
        ),
        "anomaly_ranking": _evaluated(EVENTS, select=f"SELECT {_RANKING_COLUMNS} FROM records"),
        "model_ranks": _prepared(
            LINES, DEVIATED, EXCESS, SCORED, LONG, _RANKS,
            select="SELECT sample_id, machine_id, model_name, score AS anomaly_score, rank "
            "FROM ranks",
        ),
        "predictions_long": _prepared(
            EVENTS, DEVIATED, EXCESS, SCORED, LONG, DEVIATIONS, _RANKS, select=_LONG_ROWS
        ),
        "error_deep_dive": _evaluated(EVENTS, select=_ERRORS),
        "sample_records": _evaluated(EVENTS, select=_SAMPLES),
        "sample_table": _evaluated(
            EVENTS,
            select="SELECT sample_id, machine_id, true_label, health_score, "
            + ", ".join(f"{n}_prediction" for n in VARIANTS)
            + ", sigma_1_5_score, explanation FROM (" + _SAMPLES + ")",
        ),
        "predictions_wide": _prepared(
            EVENTS, DEVIATED, EXCESS, SCORED,
            select="SELECT sample_id, machine_id, failure_label, "
            + ", ".join(
                f"{n}_score, {n}_prediction, {_health(n + '_score')} AS {n}_health" for n in VARIANTS
            )
            + " FROM scored",
        ),
        "filter_modes": _evaluated(EVENTS, select=_MODES),
        "signal_rows": _evaluated(
            EVENTS, VOTES, select="SELECT sample_id, machine_id FROM signals"
        ),
        "row_deviations": _prepared(
            LINES, DEVIATED, DEVIATIONS,
            select="SELECT sample_id, machine_id, place, feature, z_score FROM ordered",
        ),
        "explanations": _prepared(
            LINES, DEVIATED, EXCESS, SCORED, DEVIATIONS,
            select="SELECT sample_id, machine_id, "
            f"{_explained('sigma_2_5_score', 'sigma_2_5_prediction')} AS explanation "
            "FROM scored JOIN named USING (sample_id)",
        ),
        "feature_importance": _evaluated(
            LINES, VOTES, select="SELECT feature, mentions, sample_id FROM importance"
        ),
        "feature_report": _evaluated(
            LINES, VOTES,
            select="SELECT rank, feature, mentions, CASE rank WHEN 1 THEN 'Primary driver' "
            f"WHEN 2 THEN 'Secondary driver' ELSE 'Monitor' END AS role, {_TITLE} AS shown_name "
            "FROM report",
        ),
        "feature_insight": _evaluated(
            LINES, VOTES,
            select=f"SELECT CASE count(*) WHEN 0 THEN "
            "'No dominant feature pattern was detected in this run.' WHEN 1 THEN "
            "max(shown) || ' is the primary failure driver.' ELSE "
            "string_agg(shown, ' and ' ORDER BY rank) || ' are primary failure drivers.' END "
            f"AS insight FROM (SELECT rank, {_TITLE} AS shown FROM report WHERE rank <= 2)",
        ),
        "risk_overview": _evaluated(
            EVENTS,
            select="SELECT (SELECT replace(replace(model_name, 'sigma', 'Sigma'), '_', ' ') "
            f"FROM best) AS best_model, (SELECT count(*) FROM (SELECT shown FROM records "
            f"{_RANKING_ORDER} LIMIT 10) WHERE shown >= CAST(0.7 AS DOUBLE)) AS top_high_risk, "
            f"(SELECT round(avg({_r('health', 2)}), 4) FROM records) AS average_health",
        ),
        "executive_summary": _evaluated(
            LINES, VOTES,
            select="SELECT display_name || ' delivered the best F1-score (' || "
            "format('{:.3f}', f1) || ') on ' || support || ' test samples, with ' || "
            "COALESCE((SELECT feature FROM report WHERE rank = 1), 'sensor drift') || "
            "' as the top risk signal.' AS executive_summary FROM best",
        ),
        "raw_table": _with(
            GAPPY,
            select="SELECT 'batch' AS batch_id, sample_id, 'events' AS source_file, machine_id, "
            f"{ISO} AS timestamp, CAST(NULL AS DOUBLE) AS air_temperature, torque, vibration, "
            f"failure_label, {ISO} AS payload_timestamp, torque AS payload_torque FROM readings",
        ),
        "cleaned_table": _with(
            GAPPY, SPLIT, CLEAN, SCALE,
            select="SELECT 'batch' AS batch_id, split AS split_name, sample_id, machine_id, "
            f"'{_MISSING}' AS missing_columns, round(vibration, 4) AS vibration, "
            "round(vibration__scaled, 4) AS scaled_vibration FROM scaled",
        ),
        "scores_table": _prepared(
            GAPPY, DEVIATED, EXCESS, SCORED, LONG, _RANKS,
            select="SELECT 'run' AS run_id, 'batch' AS batch_id, sample_id, 'test' AS split_name, "
            "model_name, score AS anomaly_score, CAST(0.5 AS DOUBLE) AS threshold, rank FROM ranks",
        ),
        "predictions_table": _prepared(
            GAPPY, DEVIATED, EXCESS, SCORED, LONG, DEVIATIONS,
            select="SELECT 'run' AS run_id, 'batch' AS batch_id, long.sample_id, "
            "'test' AS split_name, model_name, prediction AS predicted_label, "
            f"{_health('score')} AS health_score, {_explained('score', 'prediction')} AS "
            "explanation FROM long JOIN named ON long.sample_id = named.sample_id",
        ),
        "evaluation_table": _prepared(
            GAPPY, DEVIATED, EXCESS, SCORED, LONG, METRICS,
            select="SELECT 'run' AS run_id, 'batch' AS batch_id, model_name, "
            + ", ".join(
                f"round({n}, 6) AS {n}" for n in ("accuracy", "precision", "recall", "f1", "roc_auc")
            )
            + ", support, flagged_count, verdict, 'ok' AS summary_status, "
            "round(f1, 6) AS summary_f1 FROM verdicts",
        ),
        "statistics_table": _with(
            GAPPY, SPLIT, CLEAN,
            select="SELECT 'run' AS run_id, 'batch' AS batch_id, 'train' AS split_name, * FROM ("
            + _STATISTICS + ")",
        ),
        "table_counts": _with(
            GAPPY, SPLIT, CLEAN,
            select="SELECT 'raw_sensor_records' AS table_name, count(*) AS rows FROM readings "
            "UNION ALL SELECT 'cleaned_sensor_records', count(*) FROM clean "
            "UNION ALL SELECT 'model_predictions', 4 * count(*) FROM test "
            "UNION ALL SELECT 'anomaly_scores', 4 * count(*) FROM test "
            "UNION ALL SELECT 'evaluation_results', 4 UNION ALL SELECT 'feature_statistics', 3",
        ),
        "sql_over_tables": _prepared(
            GAPPY, DEVIATED, EXCESS, SCORED, LONG,
            select="SELECT model_name, count(*) AS flagged, round(avg(score), 4) AS mean_score "
            "FROM long WHERE prediction = 1 GROUP BY model_name",
        ),
        "results_document": _evaluated(
            EVENTS, select=f"SELECT {_RANKING_COLUMNS}, model_name AS model FROM records"
        ),
        "test_split_csv": _with(
            GAPPY, SPLIT, CLEAN, select=f"SELECT {READING}{rounded}, failure_label FROM test"
        ),
        "recon_moments": _with(
            LINES, SPLIT, CLEAN, RECON,
            select=" UNION ALL ".join(
                f"SELECT '{one}' AS one, '{other}' AS other, round({c}, 4) AS covariance, rows "
                "FROM fit"
                for (one, other), c in _COVARIANCES.items()
            ),
        ),
        "recon_scores_events": _with(EVENTS, SPLIT, CLEAN, RECON, select=_RECON_ROWS),
        "recon_scores_lines": _with(LINES, SPLIT, CLEAN, RECON, select=_RECON_ROWS),
        "score_calibration": _prepared(
            LINES,
            "\nlargest AS (SELECT greatest("
            + ", ".join(f"abs(({f} - mean_{f}) / std_{f})" for f in SENSORS)
            + ") AS raw FROM normal, reference)",
            select="SELECT round(min(raw), 4) AS low, round(max(raw), 4) AS high, "
            "round(quantile_cont(raw, 0.95), 4) AS q95, round(quantile_cont(raw, 0.99), 4) AS q99 "
            "FROM largest",
        ),
        "nan_readings": "SELECT event_id, value / nullif(CAST(json_extract_string(props, "
        "'$.k') AS DOUBLE), 0) AS ratio FROM events",
    }
