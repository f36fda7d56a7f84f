"""Whether ids repeat, without shuffling them where they lie close together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ids that one bitmap covers, its bytes, and the bytes that an id takes in a shuffle.
_BITS = 32_768
_BITMAP_BYTES = _BITS // 8
_ID_BYTES = 16


def _bitmap_bytes(df: DataFrame, ident: Column) -> tuple[int, int]:
    """Ids that are not null, and the most that their bitmaps take: one for each task and span of ids it holds."""
    spans = df.groupBy(F.spark_partition_id().alias("_task")).agg(
        F.count(ident).alias("n"), F.min(ident).alias("low"), F.max(ident).alias("high")
    )
    width = (F.col("high").cast("double") - F.col("low").cast("double")) / _BITS + 2
    row = spans.agg(F.sum("n"), F.sum(F.least(width, F.col("n").cast("double")))).first()
    return int(row[0] or 0), int((row[1] or 0) * _BITMAP_BYTES)


def repeated_id(df: DataFrame, ident: Column, by_bitmap: bool | None = None) -> int | None:
    """An id that more than one row has, or None.  Null ids are passed over.

    Where the ids of a task lie close together, as they do in tables that were written
    in order, every task sends one bitmap for each 32,768 of them: a bucket with more
    rows than bits has a repeat.  Bitmaps of full spans shrink to almost nothing.  Ids
    that are scattered are counted one by one; a pass over the column decides.
    """
    ids = df.select(ident.cast("long").alias("_id")).where("_id is not null")
    if by_bitmap is None:
        rows, size = _bitmap_bytes(ids, F.col("_id"))
        by_bitmap = size <= rows * _ID_BYTES
    if by_bitmap:
        bucket = F.bitmap_bucket_number("_id")
        buckets = ids.groupBy(bucket.alias("_bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("_bits"), F.count(F.lit(1)).alias("_rows")
        )
        crowded = buckets.where(F.col("_rows") > F.bitmap_count("_bits")).select("_bucket").head(1)
        if not crowded:
            return None
        ids = ids.where(bucket == crowded[0]["_bucket"])
    found = ids.groupBy("_id").count().where("count > 1").select("_id").head(1)
    return int(found[0]["_id"]) if found else None
