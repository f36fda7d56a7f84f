"""Mixing sources to target weights by Sainte-Lague apportionment.

The words of every source are cut into blocks of near equal size.  A target number of
words for each source becomes votes, and blocks are given to sources one after another
by the highest quotient votes / (2k - 1), never beyond the largest number of passes
over a source.  A source's quota of blocks is dealt to its shards as integers; each
shard takes whole passes of all its blocks and a seeded choice of further ones.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwatch.operators.ordering import with_global_row_number
from millwatch.session import stage

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 256
#: Words and rows of a shard at least, and shards of the whole table at most (beside one for each source).
SHARD_UNITS = 1 << 18
SHARDS = 1 << 16
#: Divisors tried in one pass, and seats between two divisors that are ranked one by one.
_TRIES = 32
_RANKED = 1_000


def _decimal(value: Column | int) -> Column:
    return (value if isinstance(value, Column) else F.lit(Decimal(value))).cast("decimal(19,0)")


def _div(a: Column, b: Column) -> Column:
    """Integer quotient of non-negative longs."""
    return F.call_function("div", a, b)


def _share(a: Column, b: Column, whole: Column) -> Column:
    """floor(a * b / whole) of non-negative longs, exact where the product has more than 64 bits."""
    return _div(_decimal(a) * _decimal(b), _decimal(whole))


def _hash(text: Column) -> Column:
    """60 bits of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def water_level(sources: DataFrame, ceiling: int) -> tuple[int, int]:
    """(words, weights) of the sources below their ceiling: all words go out, the ceilings' excess by weight.

    Each pass caps the sources whose share at the present level exceeds ``ceiling``
    times their words; the level only rises, so the passes end.
    """
    total, weights = sources.agg(F.sum("_words"), F.sum("_weight")).first()
    words, open_weights = int(total or 0), int(weights or 0)
    while open_weights:
        capped = _decimal(F.col("_words")) * _decimal(ceiling * open_weights) < _decimal(words) * _decimal(F.col("_weight"))
        row = sources.where(capped).agg(F.sum("_words"), F.sum("_weight")).first()
        now = int(total) - ceiling * int(row[0] or 0), int(weights) - int(row[1] or 0)
        if now == (words, open_weights):
            break
        words, open_weights = now
    return words, open_weights


def apportion(votes: DataFrame, key: str, seats: int) -> DataFrame:
    """``key`` and ``_seats`` by the highest quotients _votes / (2k - 1) for k up to _cap; ties to the lesser key.

    The seats at a divisor d are floor(votes / d + 1/2) for each key, so the divisor is
    bracketed by counting for many divisors in one aggregate; the few seats between
    the last two are ranked by their quotients.
    """
    def won(divisor: float) -> Column:
        return F.least(F.col("_cap"), F.floor(F.col("_votes") / F.lit(divisor) + 0.5).cast("bigint"))

    def counts(divisors: list[float]) -> list[int]:
        row = votes.agg(*[F.sum(won(d)).alias(f"c{i}") for i, d in enumerate(divisors)]).first()
        return [int(v or 0) for v in row]

    seats = min(seats, int(votes.where("_votes > 0").agg(F.sum("_cap")).first()[0] or 0))
    low, high = 0.5, 2.0
    at_low, at_high = counts([low, high])
    while at_low < seats:
        low /= 1024
        at_low = counts([low])[0]
    while at_high > seats:
        high *= 1024
        at_high = counts([high])[0]
    while at_low - at_high > _RANKED and high / low > 1 + 1e-14:
        tried = [low * (high / low) ** (i / (_TRIES + 1)) for i in range(1, _TRIES + 1)]
        found = counts(tried)
        for divisor, count in zip(tried, found):
            if count >= seats:
                low, at_low = divisor, count
        for divisor, count in zip(reversed(tried), reversed(found)):
            if count <= seats:
                high, at_high = divisor, count
    sure = votes.select(key, won(high).alias("_seats"), won(low).alias("_upper"), "_votes")
    if at_high == seats:
        return sure.select(key, "_seats")
    open_seats = sure.where("_upper > _seats").select(
        key, "_votes", F.explode(F.sequence(F.col("_seats") + 1, F.col("_upper"))).alias("_k")
    )
    quotient = F.col("_votes") / (2 * F.col("_k") - 1)
    further = (
        open_seats.orderBy(quotient.desc(), key).limit(seats - at_high).groupBy(key).agg(F.count("*").alias("_more"))
    )
    return sure.join(further, key, "left").select(key, (F.col("_seats") + F.coalesce("_more", F.lit(0))).alias("_seats"))


def mix_documents(
    documents: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    ceiling: int = 3,
    block_words: int = BLOCK_WORDS,
    shard_units: int = SHARD_UNITS,
    seed: int = 17,
) -> DataFrame:
    """doc_id, source, size, source_size, target, shard, quota, taken of every row.

    ``size`` counts the words of the text (none if null or empty), ``target`` is what
    the source should give, ``quota`` the blocks that the row's shard gives and
    ``taken`` the words that the mix takes of the row, repeats counted: at most
    ``ceiling`` times its size.  Sources are ranked by code point, null last as a
    source of its own, and weigh ``weights`` in turn.  Without any words all targets
    are 0.  Rows alike in id, source and text are told apart at random: together they
    have the same results on every run.  A text of many blocks gives some of them; a
    text longer than a shard fills it.  An empty table gives no rows; other columns
    are left out, whatever their names.

    One narrow row for each document is staged and shuffled once, on its shard.  A
    source, however large, is dealt to shards by a hash of its rows; tables of sources
    and shards are staged, so Spark knows their size before it joins them.
    """
    text = F.coalesce("text", F.lit(""))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = stage(
        documents.select(
            "doc_id",
            "source",
            F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
            F.md5(F.concat(F.lit(f"{seed}|"), ident, F.lit("|"), text).cast("binary")).alias("_key"),
        ),
        "sizes",
    )
    counted = rows.groupBy("source").agg(F.sum("size").alias("_words"), (F.sum("size") + F.count("*")).alias("_units"))
    ranked = with_global_row_number(counted, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    units = int(rows.agg(F.sum("size") + F.count("*")).first()[0] or 0)
    per_shard = max(shard_units, -(-units // SHARDS))
    sources = stage(
        ranked.select(
            F.col("source").alias("_source"),
            F.col("_rank"),
            "_words",
            weight.cast("bigint").alias("_weight"),
            F.ceil(F.col("_units") / per_shard).cast("bigint").alias("_shards"),
        ),
        "sources",
    )
    level_words, level_weight = water_level(sources, ceiling)
    limit = F.col("_words") * ceiling
    share = F.lit(float(level_words)) * F.col("_weight") / F.lit(float(max(level_weight, 1)))
    capped = _decimal(F.col("_words")) * _decimal(ceiling * level_weight) < _decimal(level_words) * _decimal(F.col("_weight"))
    target = F.when(capped | F.lit(level_weight == 0), limit.cast("double")).otherwise(share)

    placed = rows.join(sources, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "shard", F.pmod(F.conv(F.substring("_key", 1, 15), 16, 10).cast("bigint"), F.col("_shards"))
    )
    # a shard's words are cut into the number of blocks that comes nearest to block_words each
    blocks = F.when(
        F.col("_w") > 0, F.greatest(F.lit(1).cast("bigint"), F.floor((2 * F.col("_w") + block_words) / (2 * block_words)).cast("bigint"))
    ).otherwise(F.lit(0).cast("bigint"))
    shards = stage(
        placed.groupBy("_rank", "shard").agg(F.sum("size").alias("_w")).withColumn("_blocks", blocks), "shards"
    )
    votes = stage(
        shards.groupBy("_rank")
        .agg(F.sum("_blocks").alias("_all"))
        .join(sources, "_rank")
        .withColumn("target", target)
        .withColumn("_votes", F.when(F.col("_words") > 0, F.col("target") * F.col("_all") / F.col("_words")).otherwise(0.0))
        .withColumn("_cap", F.col("_all") * ceiling),
        "votes",
    )
    # exact sums of rounded votes: the same number of blocks on every run
    wanted = votes.agg(F.sum(F.col("_votes").cast("decimal(28,9)"))).first()[0] or Decimal(0)
    quotas = apportion(votes, "_rank", int(wanted + Decimal("0.5")))
    before = F.coalesce(
        F.sum("_blocks").over(Window.partitionBy("_rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    whole = F.greatest(F.col("_all"), F.lit(1))
    rest = F.col("_seats") % whole
    start = F.pmod(
        _hash(F.concat_ws("|", F.lit(str(seed)), F.col("_rank").cast("string"), F.col("shard").cast("string"))),
        F.greatest(F.col("_blocks"), F.lit(1)),
    )
    dealt = (
        shards.join(votes.select("_rank", "_all", "target"), "_rank")
        .join(quotas, "_rank")
        .withColumns({"_before": before, "_passes": _div(F.col("_seats"), whole), "_start": start})
        .withColumn(
            "_more",
            _share(F.col("_before") + F.col("_blocks"), rest, whole) - _share(F.col("_before"), rest, whole),
        )
        .withColumn("quota", F.col("_passes") * F.col("_blocks") + F.col("_more"))
    )
    plan = stage(dealt.select("_rank", "shard", "_w", "_blocks", "_passes", "_more", "_start", "quota", "target"), "quotas")

    inside = Window.partitionBy("_rank", "shard").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    lined = placed.select("doc_id", "source", "size", "_rank", "shard", "_key", F.col("_words").alias("source_size")).withColumn(
        "_end", F.sum("size").over(inside)
    )
    n, w = F.col("_blocks"), F.greatest(F.col("_w"), F.lit(1))

    def edge(block: Column) -> Column:
        return _div(block * w, n)

    def part(block: Column) -> Column:
        chosen = (block + F.col("_start")) * F.col("_more") % n < F.col("_more")
        words = F.least(F.col("_end"), edge(block + 1)) - F.greatest(F.col("_begin"), edge(block))
        return F.when(chosen, words).otherwise(F.lit(0))

    touched = F.sequence(_div((F.col("_begin") + 1) * n - 1, w), _div(F.col("_end") * n - 1, w))
    chosen_words = F.aggregate(touched, F.lit(0).cast("bigint"), lambda total, block: total + part(block))
    some = F.when((F.col("size") > 0) & (F.col("_more") > 0), chosen_words).otherwise(F.lit(0))
    return (
        lined.join(plan, ["_rank", "shard"])
        .withColumn("_begin", F.col("_end") - F.col("size"))
        .withColumn("taken", F.col("size") * F.col("_passes") + some)
        .select("doc_id", "source", "size", "source_size", "target", "shard", "quota", "taken")
    )
