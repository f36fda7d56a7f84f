"""Quality rules learnt as a decision list, in DataFrame expressions only.

Each document is reduced to counts and shares.  On a bounded labelled sample
sequential covering learns one rule at a time: conditions (a feature at or above,
or below, a threshold) are added by FOIL gain on the growing part of the sample,
then dropped from the end while that helps on the pruning part.  Every step is one
aggregation over all candidate thresholds.  The rules come out as one ordered
CASE expression: the first rule that holds rejects, none keeps.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch.llm.common import is_training_row
from millwatch.session import stage

_BLANKS = " \t\n\x0b\f\r"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("symbol_share", "capital_share", "repeat_share", "distinct_share", "mean_length", "mark_share", "dup_line_share")


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the labelled rows learnt from; thresholds are ``cuts`` quantiles of a feature."""

    sample_rows: int = 40_000
    cuts: int = 24
    max_rules: int = 8
    max_conditions: int = 3
    min_precision: float = 0.9
    min_rows: int = 5


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    value: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= F.lit(self.value) if self.at_least else c < F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.value:g}"


Rule = tuple[Condition, ...]


def text_counts(documents: DataFrame) -> DataFrame:
    """doc_id, the base counts and shares of every row; zeros for null, empty and blank texts.

    Words in repeated windows: each three-word window is hashed to 64 bits, the
    windows of a text are sorted by hash, those with an equal neighbour are found
    twice or more, and the words that their places cover are counted.  All of it
    stays inside the row.
    """
    bare = F.btrim(F.coalesce("text", F.lit("")), F.lit(_BLANKS))
    rows = documents.select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("_text"),
        bare.alias("_bare"),
        F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")).alias("_w"),
    )
    n = F.size("_w")
    windows = F.expr(
        "array_sort(transform(sequence(0, size(_w) - 3), i -> struct(xxhash64(_w[i], _w[i + 1], _w[i + 2]) as h, i as i)))"
    )
    no_windows = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.select(
        "doc_id",
        n.cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("_bare", r"[\x20\x09-\x0D]+", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("_bare", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.length(F.regexp_replace("_bare", r"\P{Lu}+", "")).cast("bigint").alias("_capitals"),
        F.length(F.regexp_replace("_bare", r"[^!?.,;:]+", "")).cast("bigint").alias("_marks"),
        F.size(F.array_distinct("_w")).cast("bigint").alias("_distinct"),
        F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.when(n >= 3, windows).otherwise(no_windows).alias("_v"),
    )
    again = (
        "filter(transform(sequence(0, size(_v) - 1), j -> if((j > 0 and _v[j - 1].h = _v[j].h) or "
        "(j < size(_v) - 1 and _v[j + 1].h = _v[j].h), _v[j].i, null)), x -> x is not null)"
    )
    rows = rows.withColumn("_p", F.when(F.size("_v") >= 2, F.sort_array(F.expr(again))).otherwise(F.array().cast("array<int>")))
    covered = F.expr(
        "aggregate(sequence(0, size(_p) - 1), 0L, (a, j) -> a + if(j < size(_p) - 1, least(3, _p[j + 1] - _p[j]), 3))"
    )
    rows = rows.withColumn("n_repeat_words", F.when(F.size("_p") > 0, covered).otherwise(F.lit(0)).cast("bigint"))
    lines = F.size("_lines").cast("bigint")
    words = F.greatest("n_words", F.lit(1))
    chars = F.greatest("word_chars", F.lit(1))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (lines - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        "n_repeat_words",
        (F.col("n_symbols") / chars).alias("symbol_share"),
        (F.col("_capitals") / chars).alias("capital_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("_distinct") / F.sqrt(words)).alias("distinct_share"),
        (F.col("word_chars") / words).alias("mean_length"),
        (F.col("_marks") / words).alias("mark_share"),
        ((lines - F.size(F.array_distinct("_lines"))) / F.greatest(lines, F.lit(1))).alias("dup_line_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule), F.lit(True))


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p > 0 else 0.0


def _best_condition(left: DataFrame, rule: Rule, thresholds: dict[str, list[float]], min_rows: int) -> Condition | None:
    """The condition with the greatest FOIL gain, from one pass over the rows that the rule covers."""
    counted = (
        left.where(_holds(rule) & F.col("_grow"))
        .select("_bad", F.posexplode("_bins").alias("f", "b"))
        .groupBy("f", "b")
        .agg(F.count_if(F.col("_bad")).alias("p"), F.count_if(~F.col("_bad")).alias("n"))
        .collect()  # a row for each feature and threshold
    )
    best, found = 1e-9, None
    for i, (feature, values) in enumerate(thresholds.items()):
        by_bin = {r["b"]: (r["p"], r["n"]) for r in counted if r["f"] == i}
        p0, n0 = (sum(x[k] for x in by_bin.values()) for k in (0, 1))
        if not p0 or not n0:
            return None
        p, n = p0, n0
        for b, value in enumerate(values):
            p, n = p - by_bin.get(b, (0, 0))[0], n - by_bin.get(b, (0, 0))[1]
            for at_least, x, y in ((True, p, n), (False, p0 - p, n0 - n)):
                gain = _gain(x, y, p0, n0)
                if x >= min_rows and gain > best:
                    best, found = gain, Condition(feature, at_least, value)
    return found


def _doubles(values: list[float]) -> str:
    return f"cast(array({', '.join(f'{v!r}D' for v in values)}) as array<double>)"


def learn(sample: DataFrame, s: Settings = Settings()) -> list[Rule]:
    """Rules for rows with ``_bad`` true, from features, ``_bad`` and ``_grow`` (part that rules grow on)."""
    features = (*BASE, *SHARES)
    steps = [i / (s.cuts + 1) for i in range(1, s.cuts + 1)]
    by_class = [sample.where(c).agg(*(F.percentile(f, F.lit(steps)).alias(f) for f in features)).first() for c in (F.col("_bad"), ~F.col("_bad"))]
    thresholds = {f: sorted({float(v) for r in by_class for v in (r[f] or [])}) for f in features}
    # the bin of a value is the number of thresholds that it reaches
    bins = [F.expr(f"size(filter({_doubles(ts)}, t -> t <= {f}))") for f, ts in thresholds.items()]
    left = stage(sample.select("_bad", "_grow", *features, F.array(*bins).alias("_bins")), "rule_bins")
    rules: list[Rule] = []
    while len(rules) < s.max_rules:
        rule: Rule = ()
        while len(rule) < s.max_conditions and (c := _best_condition(left, rule, thresholds, s.min_rows)):
            rule += (c,)
        if not rule:
            break
        cuts = [rule[:k] for k in range(1, len(rule) + 1)]
        prune = left.where(~F.col("_grow"))
        counts = prune.agg(
            *(F.count_if(_holds(r) & F.col("_bad")).alias(f"p{k}") for k, r in enumerate(cuts)),
            *(F.count_if(_holds(r) & ~F.col("_bad")).alias(f"n{k}") for k, r in enumerate(cuts)),
        ).first()
        worth = [(counts[f"p{k}"] - counts[f"n{k}"]) / max(1, counts[f"p{k}"] + counts[f"n{k}"]) for k in range(len(cuts))]
        k = max(range(len(cuts)), key=lambda k: (worth[k], -k))
        p, n = counts[f"p{k}"], counts[f"n{k}"]
        if p + n == 0 or p / (p + n) < s.min_precision:
            break
        rules.append(cuts[k])
        left = left.where(~_holds(cuts[k]))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 if none does."""
    out = F
    for i, rule in enumerate(rules, 1):
        out = out.when(_holds(rule), F.lit(i))
    return F.lit(0) if out is F else out.otherwise(F.lit(0))


def quality_rules(documents: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, list[Rule]]:
    """doc_id, base counts, base_failed, rule, kept of every row, and the rules.

    ``rule`` is the number of the rule that rejects, 0 if none; ``kept`` is false
    if the base rule fails or a rule rejects.  Learnt from at most ``sample_rows``
    rows with a label that may be learnt from (quality 0 is what rules look for);
    with one class only there are no rules.  Repeated rows are judged alike.
    """
    counts = stage(text_counts(documents), "text_counts")
    known = (
        labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & is_training_row(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("_q"), F.max("quality").alias("_m")).where("_q = _m")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample_rows)
    )
    sample = stage(
        counts.join(known, "doc_id").where(~base_failed()).select(
            *BASE, *SHARES, (F.col("_q") == 0).alias("_bad"), (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) > 0).alias("_grow")
        ),
        "rule_sample",
    )
    rules = learn(sample, s)
    rule = verdict(rules)
    judged = counts.select(
        "doc_id", *BASE, base_failed().alias("base_failed"), rule.alias("rule"), (~base_failed() & (rule == 0)).alias("kept")
    )
    return judged, rules
