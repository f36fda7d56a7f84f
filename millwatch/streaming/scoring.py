"""Score a stream of canonical readings with frozen detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millwatch.operators.stats import SCALED
from millwatch.plans.train import Detectors, bring_to_inputs, score_inputs, score_row_local
from millwatch.streaming.windows import state_store, stream_windows


def score_stream(stream: DataFrame, detectors: Detectors, lateness: str | None = None) -> DataFrame:
    """Scores per reading of a stream.

    Without ``lateness`` rule, forest and reconstruction scores are given as readings
    come and no state is kept.  With it the sequence detector scores too: each reading
    waits until none before it can come any more (see ``stream_windows``).  The rule
    score needs a frozen unit either way.
    """
    if lateness is None:
        return score_row_local(stream, detectors)
    scaled = [SCALED.format(name) for name in detectors.features]
    inputs = bring_to_inputs(stream, detectors)
    placed = stream_windows(inputs, [*detectors.features, *scaled], lateness, detectors.sequence.rows)
    # windows of the scaled columns alone
    first = len(detectors.features) + 1
    rows = placed.withColumn("window", F.transform("window", lambda row: F.slice(row, first, len(scaled))))
    return score_inputs(rows, detectors).drop("window", *scaled)


def write_scores(scores: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the scored readings to a Parquet folder."""
    with state_store(scores.sparkSession):
        return (
            scores.writeStream.format("parquet")
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(**(trigger or {"availableNow": True}))
            .start(path)
        )
