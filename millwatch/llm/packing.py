"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces no longer than the longest sequence and dealt into
groups of bounded size.  In a group pieces come longest first; each goes to the
open bin that it fills best, or opens the bin size of least cost for what is
still to come.  At the end every bin is downsized to the least permitted length
that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwatch.session import stage

CAPACITIES = (256, 512, 1024, 2048, 4096)
GROUP_PIECES = 20_000


def cost(capacity: int, longest: int) -> float:
    """Cost of a sequence: a fixed part, one for each token, and attention growing with the square."""
    return 32.0 + capacity + 0.25 * capacity * capacity / longest


def least_cost_size(length: int, to_come: int, capacities: tuple[int, ...]) -> int:
    """The bin size with the least cost for each token it can be expected to hold."""
    fits = [c for c in capacities if c >= length]
    return min(fits, key=lambda c: (cost(c, capacities[-1]) / min(c, length + to_come), c))


class BestFit:
    """Open bins ordered by the room they have left."""

    def __init__(self, capacities: tuple[int, ...]):
        self.capacities = capacities
        self.open: list[tuple[int, int]] = []  # room, bin
        self.capacity: list[int] = []

    def place(self, length: int, to_come: int) -> tuple[int, int]:
        """(bin, offset) for a piece; to_come: tokens of the pieces that follow."""
        at = bisect_left(self.open, (length, -1))
        if at < len(self.open):
            room, chosen = self.open.pop(at)
        else:
            room = least_cost_size(length, to_come, self.capacities)
            chosen = len(self.capacity)
            self.capacity.append(room)
        if room > length:
            insort(self.open, (room - length, chosen))
        return chosen, self.capacity[chosen] - room


def _pack(capacities: tuple[int, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, bins, to_come = None, BestFit(capacities), 0
        for batch in batches:
            out = []
            for g, total, length in zip(batch["_group"], batch["_total"], batch["length"], strict=True):
                if g != group:
                    group, bins, to_come = g, BestFit(capacities), total
                to_come -= length
                out.append(bins.place(length, to_come))
            batch["bin"] = [b for b, _ in out]
            batch["offset"] = [o for _, o in out]
            yield batch[["doc_id", "piece", "start", "length", "_group", "bin", "offset"]]

    return run


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).otherwise(0).cast("bigint")


def pack_documents(
    documents: DataFrame, capacities: tuple[int, ...] = CAPACITIES, group_pieces: int = GROUP_PIECES
) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, bin_id, offset, capacity.

    A document's length is its words and one end mark; so an empty or null text
    still takes one place.  A longer document than the longest capacity is cut
    into full pieces and a rest.  Repeated rows are packed each.  Pieces of one
    length are alike, so ties go by id.  Groups hold about ``group_pieces``
    pieces by a hash of id and piece, and any number fits: a task keeps open bins
    only.  An empty table gives no rows.
    """
    capacities = tuple(sorted(set(capacities)))
    longest = capacities[-1]
    sized = documents.select("doc_id", (word_count(F.col("text")) + 1).alias("_n"), F.xxhash64("text").alias("_h"))
    pieces = sized.select(
        "doc_id", "_n", "_h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / longest))).alias("piece")
    ).select(
        "doc_id",
        "piece",
        (F.col("piece") * longest).alias("start"),
        F.least(F.lit(longest).cast("bigint"), F.col("_n") - F.col("piece") * longest).alias("length"),
        F.xxhash64("doc_id", "_h", "piece").alias("_h"),
    )
    pieces = stage(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("_group", F.pmod("_h", F.lit(groups)))
    totals = dealt.groupBy("_group").agg(F.sum("length").alias("_total"))
    ready = (
        dealt.join(totals, "_group")
        .repartition("_group")
        .sortWithinPartitions("_group", F.desc("length"), "doc_id", "piece")
        .select("doc_id", "piece", "start", "length", "_group", "_total")
    )
    packed = ready.mapInPandas(
        _pack(capacities),
        "doc_id bigint, piece bigint, start bigint, length bigint, _group bigint, bin bigint, offset bigint",
    )
    filled = F.sum("length").over(Window.partitionBy("_group", "bin"))
    capacity = F.lit(longest)
    for c in reversed(capacities[:-1]):
        capacity = F.when(filled <= c, c).otherwise(capacity)
    return packed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        F.concat_ws("-", "_group", "bin").alias("bin_id"),
        "offset",
        capacity.cast("int").alias("capacity"),
        filled.alias("filled"),
    )
