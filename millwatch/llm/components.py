"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch.session import stage


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is its smallest node.

    Large-star and small-star steps (Kiveris et al., 2014) turn the edges into
    stars around the smallest node in few rounds.  Each round is written as a
    table, so a lost executor repeats no earlier one.  Edges with a null and
    loops are ignored.
    """
    spark = edges.sparkSession
    now = stage(
        edges.where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        large = large.distinct()
        # every edge now points from the larger to the smaller node
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        small = small.where("a != b").unionByName(least.select("a", F.col("_m").alias("b"))).distinct()
        now = stage(small, "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError("components have not settled; raise rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
