"""Names, aliases, limits and wordings that results depend on."""

from __future__ import annotations

# ---- fixed values: canonical columns -------------------------------------
SENSORS = (
    "air_temperature",
    "process_temperature",
    "rotational_speed",
    "torque",
    "tool_wear",
    "vibration",
)

# Column names, after slugging, that are read as each canonical column.
ALIASES = {
    "machine_id": ("machine_id", "machine", "asset_id", "unit_id", "product_id"),
    "timestamp": ("timestamp", "time", "datetime", "date", "event_time"),
    "air_temperature": ("air_temperature", "air_temperature_k", "air_temp"),
    "process_temperature": ("process_temperature", "process_temperature_k", "process_temp"),
    "rotational_speed": ("rotational_speed", "rotational_speed_rpm", "rpm", "speed"),
    "torque": ("torque", "torque_nm", "load_torque"),
    "tool_wear": ("tool_wear", "tool_wear_min", "wear"),
    "vibration": ("vibration", "vibration_level", "vibe"),
    "failure_label": ("failure_label", "failure", "machine_failure", "label", "target"),
}

DEFAULT_MACHINE = "M-001"
TIMELINE_START = "2026-01-01 00:00:00"
TIMELINE_STEP_MINUTES = 5

# Words of a text label column that mean a failure (trimmed, lower case).
FAILURE_WORDS = ("1", "true", "failure", "fail", "yes", "y", "anomaly")

# Cell texts that a CSV reader takes as missing.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Forms of time texts tried after ISO, in this order, on a whole column each.
TIME_FORMS = (
    "MM/dd/yyyy HH:mm[:ss]", "dd/MM/yyyy HH:mm[:ss]", "dd.MM.yyyy HH:mm[:ss]", "yyyy/MM/dd HH:mm[:ss]",
)
EPOCH_UNITS = {"s": 1, "ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}

# ---- fixed values: split, detectors --------------------------------------
SPLITS = ("train", "validation", "test")
TRAIN_TENTHS = 6
TRAIN_AND_VALIDATION_TENTHS = 8

SEED = 42
SIGMA = 2.5
STD_FLOOR = 1e-6
RANGE_FLOOR = 1e-8
SCORE_THRESHOLD = 0.5
FOREST_TREES = 200
FOREST_SAMPLE = 256
DEFAULT_CONTAMINATION = 0.08
CONTAMINATION_FACTOR = 1.5
CONTAMINATION_BOUNDS = (0.02, 0.15)
FOREST_QUANTILE_CAP = 0.99
RECON_QUANTILE = 0.95
WINDOW_ROWS = 8
SEQUENCE_HIDDEN = 24
SEQUENCE_ITERATIONS = 30
NETWORK_ITERATIONS = 40

MODELS = {
    "rule_based": "Rule-Based",
    "isolation_forest": "Isolation Forest",
    "autoencoder": "Autoencoder",
    "lstm": "LSTM",
}

# ---- fixed values: bands and reports -------------------------------------
HEALTH_BANDS = ((80.0, "Healthy"), (55.0, "Watch"), (30.0, "Risky"))
HEALTH_REST = "Critical"
RISK_LEVELS = ((0.70, "HIGH RISK"), (0.40, "MONITOR"))
RISK_REST = "NORMAL"
VERDICTS = ((0.75, "Strong"), (0.60, "Good"), (0.45, "Decent"))
VERDICT_REST = "Weak"
VERDICT_MISSING = "Unavailable"
SIGNAL_SCORE = 0.6
TOP_FEATURES = 3
VOTING_FEATURES = 2
TOP_ANOMALIES = 10
TOP_ERRORS = 5
HISTOGRAM_BINS = 16
PREVIEW_ROWS = 25
NO_DRIVER = "sensor drift"

# Wordings; numbers are filled in with the given formats.
ALERT_TEXT = "Risk score %.2f: elevated readings in %s pushed this sample into the alert range."
CALM_TEXT = (
    "Risk score %.2f: readings stayed near the training baseline, "
    "with the largest movement in %s."
)
SUMMARY_TEXT = (
    "%s delivered the best F1-score (%.3f) on %d test samples, with %s as the top risk signal."
)
