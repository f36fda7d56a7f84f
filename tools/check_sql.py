"""Run catalog queries and their SQL side by side and compare the rows.

    python tools/check_sql.py [folder] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millwatch.plans.catalog import catalog  # noqa: E402
from millwatch.plans.oracle import oracle  # noqa: E402
from millwatch.plans.oracle_checks import oracle_checks  # noqa: E402
from millwatch.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value: object) -> object:
    """One spelling per value, so that both sides hash alike."""
    if value is None or (not isinstance(value, (str, list, dict)) and pd.isna(value)):
        return ""
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value))  # a negative zero is not a zero here
    return str(value)


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(_plain, row)) for row in frame.itertuples(index=False))


def compare(left: pd.DataFrame, right: pd.DataFrame) -> str:
    """Empty if equal, otherwise the first difference."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} / {sorted(right.columns)}"
    a, b = rows_of(left), rows_of(right)
    if len(a) != len(b):
        return f"{len(a)} / {len(b)} rows"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} of {len(a)} rows, first {wrong[0]}" if wrong else ""


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(catalog())
    spark, connection, texts = local_session(), connect(folder), oracle() | oracle_checks()
    failures = 0
    for name in names:
        begin = time.time()
        try:
            ours = catalog()[name](spark, folder).toPandas()
            took = time.time() - begin
            if name not in texts:
                print(f"{name:28} {took:6.1f}s rows only: {len(ours)}", flush=True)
                continue
            begin = time.time()
            theirs = connection.sql(texts[name]).df()
            difference = compare(ours, theirs)
        except Exception as error:  # noqa: BLE001
            took, difference = time.time() - begin, f"{type(error).__name__}: {str(error)[:600]}"
        failures += bool(difference)
        print(
            f"{name:28} {took:6.1f}s sql {time.time() - begin:5.1f}s "
            f"{difference or 'ok ' + str(len(ours))}",
            flush=True,
        )
    print(f"{failures} of {len(names)} differ")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
