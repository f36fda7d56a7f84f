"""Small hand-made sensor tables."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd

SCHEMA = (
    "sample_id bigint, machine_id string, timestamp timestamp_ntz, torque double, "
    "vibration double, failure_label int"
)
START = datetime(2026, 1, 1)


def readings(spark, sizes: dict[str | None, int], seed: int = 1, failures: float = 0.1):
    """Machines of given lengths with random readings, ids in order."""
    rng = np.random.default_rng(seed)
    rows, ident = [], 0
    for machine, size in sizes.items():
        for step in range(size):
            ident += 1
            failed = bool(rng.random() < failures)
            rows.append(
                (
                    ident, machine, START + timedelta(seconds=37 * step),
                    float(rng.normal(40, 4) + 10 * failed), float(rng.normal(0.4, 0.1)),
                    int(failed),
                )
            )
    return spark.createDataFrame(rows, SCHEMA)


def values(df, *columns: str) -> list[tuple]:
    return sorted(tuple(row) for row in df.select(*columns).collect())


def pandas_of(df, *order: str) -> pd.DataFrame:
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)
