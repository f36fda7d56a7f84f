"""Shards of near-equal bytes by Karmarkar-Karp differencing.

Rows of equal text are a group that no shard boundary cuts.  Groups are summed,
dealt into blocks of bounded size, and each block is differenced: the two partial
partitions with the largest spread are combined, the largest part of one with the
smallest of the other, until one partition is left.  The partitions of the blocks
are differenced again, level by level, so no task holds more than a block.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwatch.session import stage

BLOCK_GROUPS = 20_000
BLOCK_PARTITIONS = 1_000
SLOT_ROWS = 50_000


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows of ``sums``, one column for each part).

    Returns the part sums, and for each row and column the part it went to.  Ties
    go by row number.
    """
    rows, parts = sums.shape
    heap, alive, members = [], {}, {}
    for i in range(rows):
        order = np.argsort(sums[i], kind="stable")
        own = sums[i][order]
        alive[i] = own
        members[i] = [[i * parts + int(c)] for c in order]
        heap.append((-(int(own[-1]) - int(own[0])), i))
    heapq.heapify(heap)
    fresh = rows
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        total = alive.pop(a) + alive.pop(b)[::-1]
        one, two = members.pop(a), members.pop(b)[::-1]
        order = np.argsort(total, kind="stable")
        merged = []
        for p in order:
            big, small = (one[p], two[p]) if len(one[p]) >= len(two[p]) else (two[p], one[p])
            big.extend(small)
            merged.append(big)
        total = total[order]
        alive[fresh], members[fresh] = total, merged
        heapq.heappush(heap, (-(int(total[-1]) - int(total[0])), fresh))
        fresh += 1
    last = heap[0][1]
    went = np.empty(rows * parts, np.int64)
    for part, own in enumerate(members[last]):
        went[own] = part
    return alive[last], went.reshape(rows, parts)


def _blocks(parts: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_bytes", "_key"], ascending=[False, True], ignore_index=True)
        sums = np.zeros((len(frame), parts), np.int64)
        sums[:, -1] = frame["_bytes"]
        total, went = difference(sums)
        frame["_part"] = went[:, -1]
        frame["_sum"] = total[frame["_part"]]
        return frame[["_key", "_block", "_part", "_sum"]]

    return run


def _merge(parts: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot_table(index="_block", columns="_part", values="_sum", aggfunc="max", fill_value=0)
        wide = wide.reindex(columns=range(parts), fill_value=0).sort_index()
        total, went = difference(wide.to_numpy(np.int64))
        n = len(wide)
        part = went.ravel()
        return pd.DataFrame(
            {
                "_block": np.repeat(wide.index.to_numpy(np.int64), parts),
                "_part": np.tile(np.arange(parts), n),
                "_upper": int(frame["_upper"].iloc[0]),
                "_to": part,
                "_sum": total[part],
            }
        )

    return run


def shard_documents(
    documents: DataFrame, shards: int = 16, block_groups: int = BLOCK_GROUPS, block_partitions: int = BLOCK_PARTITIONS
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row; sizes of the shards are near equal.

    Size is the UTF-8 bytes of the text plus 1; a null text has size 1 and the
    checksum of an empty one, and null texts are one group.  Slots count the rows
    of a shard from 0 without gaps; rows alike in id and text take any of their
    slots.  A group larger than an even share stays whole, and its shard is that
    much larger.  An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = stage(
        documents.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.coalesce(F.xxhash64("text"), F.lit(0).cast("bigint")).alias("_key"),
        ),
        "sized",
    )
    groups = stage(rows.groupBy("_key").agg(F.sum("size").alias("_bytes")), "groups")
    blocks = max(1, -(-groups.count() // block_groups))
    dealt = groups.withColumn("_block", F.pmod(F.xxhash64("_key"), F.lit(blocks)))
    placed = stage(
        dealt.groupBy("_block").applyInPandas(_blocks(shards), "_key bigint, _block bigint, _part bigint, _sum bigint"), "placed"
    )
    # (_block, _part) -> _sum, and where each part of a block has gone so far
    now = placed.groupBy("_block", "_part").agg(F.max("_sum").alias("_sum"))
    while blocks > 1:
        blocks = -(-blocks // block_partitions)
        upper = F.pmod("_block", F.lit(blocks))
        moved = stage(
            now.withColumn("_upper", upper).groupBy("_upper").applyInPandas(
                _merge(shards), "_block bigint, _part bigint, _upper bigint, _to bigint, _sum bigint"
            ),
            "moved",
        )
        placed = placed.join(moved.select("_block", "_part", "_upper", "_to"), ["_block", "_part"]).select(
            "_key", F.col("_upper").alias("_block"), F.col("_to").alias("_part")
        )
        now = moved.groupBy(F.col("_upper").alias("_block"), F.col("_to").alias("_part")).agg(F.max("_sum").alias("_sum"))
    shard = placed.select("_key", F.col("_part").cast("int").alias("shard"))
    found = stage(rows.join(shard, "_key").select("doc_id", "size", "text_crc32", "shard", "_key"), "sharded")
    return with_slots(found, "shard", shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def with_slots(rows: DataFrame, shard: str, shards: int) -> DataFrame:
    """Number the rows of each shard from 0: inside small parts of it, after the rows of earlier parts."""
    parts = max(1, -(-rows.count() // (shards * SLOT_ROWS)))
    dealt = rows.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "_key", F.lit(3)), F.lit(parts)))
    counts = dealt.groupBy(shard, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(shard, "_slice").orderBy("doc_id", "_key")) - 1
    return dealt.withColumn("_inside", inside).join(starts, [shard, "_slice"]).withColumn("slot", F.col("_start") + F.col("_inside"))
