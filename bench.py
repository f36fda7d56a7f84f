"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line with seconds per query; every query is run to its last
row, starting from the Parquet files.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millwatch.plans.catalog import catalog  # noqa: E402
from millwatch.session import local_session  # noqa: E402

HEADLINE = (
    "chrono_split_events", "chrono_split_lines", "train_medians", "feature_statistics_lines",
    "scaled_features", "lag_windows", "rule_scores_lines", "variant_metrics_lines", "roc_curves",
    "model_ranks", "row_deviations", "explanations", "feature_report", "top_anomalies",
    "sample_records", "recon_scores_lines", "forest_scores", "sequence_scores", "full_report",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        catalog()[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_query_time", "value": round(sum(seconds.values()), 3),
                "unit": "sec", "queries": seconds,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
