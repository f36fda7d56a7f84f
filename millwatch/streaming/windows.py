"""Trailing rows of each machine on a stream, in the order of time and not of arrival.

A reading waits until the watermark has passed it; by then every earlier reading that
is not later than allowed has come.  Readings are released in the order of time and
id, each with the readings before it, of which a ring of the last few is kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from millwatch import fixed
from millwatch.operators.ordering import micros_of

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Groups of machines that share their state.
STATE_GROUPS = 1024


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that keeps lists, for queries started inside; the setting goes back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class TrailingRows(StatefulProcessor):
    """For the machines of a group, the last rows released and those that wait for the watermark.

    Every call of a group asks for its state and stores it a fixed number of times, so
    the number of calls grows with the groups and not with the machines.
    """

    def __init__(self, rows: int) -> None:
        self.rows = rows

    def init(self, handle) -> None:  # noqa: ANN001
        entry = "machine string, at bigint, id bigint, row array<double>"
        self.handle = handle
        self.recent = handle.getListState("recent", entry)
        self.waiting = handle.getListState("waiting", entry)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        fresh = [
            (machine, int(at), int(ident), [float(x) for x in row])
            for frame in rows
            for machine, at, ident, row in zip(frame["machine_id"], frame["at_micros"], frame["sample_id"], frame["row_values"])
        ]
        yield from self._release(fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield from self._release([], timerValues.getCurrentWatermarkInMs())

    def _release(self, fresh: list[tuple], mark: int) -> Iterator[pd.DataFrame]:
        held = [tuple(entry) for entry in self.waiting.get()] + fresh
        ready = sorted(entry[:3] + (list(entry[3]),) for entry in held if entry[1] // 1000 < mark)
        rest = [entry for entry in held if entry[1] // 1000 >= mark]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(entry[1] for entry in rest) // 1000 + 1)
        else:
            self.waiting.clear()
        if not ready:
            return
        lines: dict[str, list[tuple]] = {}
        for entry in self.recent.get():
            lines.setdefault(entry[0], []).append(tuple(entry))
        windows = []
        for entry in ready:
            line = lines.setdefault(entry[0], [])
            line.append(entry)
            seen = [list(e[3]) for e in line[-self.rows :]]
            windows.append([seen[0]] * (self.rows - len(seen)) + seen)
            if len(line) > max(self.rows - 1, 1):
                del line[0]
        self.recent.put([entry for line in lines.values() for entry in line])
        yield pd.DataFrame(
            {
                "machine_id": [entry[0] for entry in ready], "sample_id": [entry[2] for entry in ready],
                "at_micros": [entry[1] for entry in ready], "window": windows,
            }
        )

    def close(self) -> None:
        pass


def stream_windows(
    stream: DataFrame, features: Sequence[str], lateness: str, rows: int = fixed.WINDOW_ROWS
) -> DataFrame:
    """machine_id, sample_id, timestamp, the features and ``window``: the last ``rows`` feature rows of the machine.

    ``lateness`` is how long a reading may come after later ones, such as ``10 minutes``;
    a reading waits that long, and one that comes later still is dropped by the
    watermark and counted in the query's progress.  The first readings of a machine
    repeat its first one on the left.  Readings without machine or time are left out.
    The last readings of a stream wait until later ones come.

    State is kept by groups of machines: the last rows and those that wait.  A machine is a
    task's work, however many readings it has.  Start the query inside ``state_store``.
    """
    at = micros_of(F.col("timestamp"))
    placed = stream.where("machine_id is not null and timestamp is not null").select(
        "machine_id", F.col("sample_id").cast("long").alias("sample_id"), at.alias("at_micros"),
        F.array(*[F.col(name).cast("double") for name in features]).alias("row_values"),
        F.timestamp_micros(at).alias("moment"),
    )
    found = (
        placed.withWatermark("moment", lateness)
        .withColumn("_group", F.pmod(F.xxhash64("machine_id"), F.lit(STATE_GROUPS)))
        .groupBy("_group")
        .transformWithStateInPandas(
            TrailingRows(rows), "machine_id string, sample_id bigint, at_micros bigint, window array<array<double>>", "append", "eventTime"
        )
    )
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    own = F.element_at("window", -1)
    return found.select(
        "sample_id", "machine_id", F.timestamp_add("MICROSECOND", F.col("at_micros"), start).alias("timestamp"),
        *[F.get(own, F.lit(i)).alias(name) for i, name in enumerate(features)], "window",
    )
