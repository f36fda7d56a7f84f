"""URL filters: captures against list entries that were active when they were fetched.

A dated list says from which day a pattern (a host or a parent domain) is blocked,
allowed or off the list.  The entries of a pattern become validity intervals,
kept as one row for each pattern with its intervals in order.  A capture meets its
host and each parent domain, finds the interval that holds its time, and follows
the most specific active one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL; null without one.  User, port and a last dot are left out."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)
    return F.nullif(F.regexp_replace(F.lower(found), r"\.$", ""), F.lit(""))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(pattern, intervals) from (pattern, day, action).

    An entry holds from its day until the next day with an entry for the pattern.
    Actions are block, allow and remove; of several entries of a pattern on one
    day block wins over allow, and allow over remove.  Entries with a null or
    another action are left out.  intervals: array of (from, until, action) in order,
    until is null while open.
    """
    rank = F.create_map(*(x for i, a in enumerate(("remove", "allow", "block")) for x in (F.lit(a), F.lit(i))))
    clean = entries.select(F.lower("pattern").alias("pattern"), "day", F.lower("action").alias("action")).where(
        F.col("pattern").isNotNull() & F.col("day").isNotNull() & F.col("action").isin("block", "allow", "remove")
    )
    daily = clean.groupBy("pattern", "day").agg(F.max(rank[F.col("action")]).alias("_rank"))
    until = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    spans = daily.withColumn("_until", until).where("_rank > 0")
    span = F.struct(
        F.col("day").alias("from"), F.col("_until").alias("until"), F.when(F.col("_rank") == 2, "block").otherwise("allow").alias("action")
    )
    return spans.groupBy("pattern").agg(F.array_sort(F.collect_list(span)).alias("intervals"))


def judge_captures(captures: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """keys, host, pattern, action, kept of every capture (keys, url, day).

    ``pattern`` and ``action`` are the most specific list entry active on the day,
    null where none is.  A capture goes only if that entry blocks it: one without
    host or day stays.  The lookup is done once for each host and day, so a host
    with a third of all captures is joined once for each day.  An empty
    table of captures gives no rows.
    """
    seen = captures.select(*keys, host_of(F.col("url")).alias("host"), F.col("day"))
    asked = seen.select("host", "day").where("host is not null and day is not null").distinct()
    labels = F.split("host", r"\.")
    levels = asked.select(
        "host", "day", F.posexplode(F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> i)")).alias("_at", "_level")
    ).select("host", "day", "_at", F.array_join(F.slice(labels, F.col("_level"), F.size(labels)), ".").alias("pattern"))
    listed = validity_intervals(entries)
    met = levels.join(listed, "pattern").select(
        "host",
        "day",
        "_at",
        "pattern",
        F.expr("get(filter(intervals, x -> x.from <= day and (x.until is null or day < x.until)), 0)").alias("_entry"),
    )
    best = (
        met.where("_entry is not null")
        .groupBy("host", "day")
        .agg(F.min_by(F.struct("pattern", F.col("_entry.action").alias("action")), "_at").alias("_best"))
        .select(F.col("host").alias("_host"), F.col("day").alias("_day"), "_best.pattern", "_best.action")
    )
    joined = seen.join(best, (F.col("host") == F.col("_host")) & (F.col("day") == F.col("_day")), "left")
    kept = F.coalesce(F.col("action") != "block", F.lit(True))
    return joined.select(*keys, "host", "day", "pattern", "action", kept.alias("kept"))
