"""Quality of the scored split: metrics, exact AUC, curves, counts.

The scored frame is wide, with ``<model>_score`` (6 digits) and
``<model>_prediction`` per model beside ``failure_label``.  Everything here
first counts rows per model and score, so what is shuffled and ordered is at
most the number of distinct scores, not the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwatch import fixed
from millwatch.functions.scalar import label_text, metric_cell, shown_score, verdict

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")


def constant_by(values: Mapping[str, object], key: Column) -> Column:
    """A constant per model name."""
    chain = None
    for name, value in values.items():
        chain = (F if chain is None else chain).when(key == name, F.lit(value))
    return chain


def long_scores(scored: DataFrame, models: Sequence[str], *keep: str) -> DataFrame:
    """One row per reading and model: ``model_name, score, prediction``."""
    entries = [
        F.struct(
            F.lit(name).alias("model_name"),
            F.col(f"{name}_score").alias("score"),
            F.col(f"{name}_prediction").alias("prediction"),
        )
        for name in models
    ]
    return scored.select(*keep, F.inline(F.array(*entries)))


def score_counts(scored: DataFrame, models: Sequence[str], shown: bool = False) -> DataFrame:
    """Rows per model and distinct score, split by outcome."""
    long = long_scores(scored, models, "failure_label")
    if shown:
        long = long.withColumn("score", shown_score(F.col("score")))
    failed, flagged = F.col("failure_label") == 1, F.col("prediction") == 1
    return long.groupBy("model_name", "score").agg(
        F.count_if(failed).alias("positives"),
        F.count_if(~failed).alias("negatives"),
        F.count_if(failed & flagged).alias("caught"),
        F.count_if(~failed & flagged).alias("false_alarms"),
    )


def _ratio(top: Column, bottom: Column) -> Column:
    """Quotient that is 0 where there is nothing to divide by."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def metrics(
    scored: DataFrame,
    models: Mapping[str, str],
    status: Mapping[str, str] | None = None,
    notes: Mapping[str, str] | None = None,
) -> DataFrame:
    """Metrics per model, with the exact tie-aware AUC (null on one class).

    Metrics and AUC come out of the same counts: one pass over the rows.
    """
    ascending = (
        Window.partitionBy("model_name").orderBy("score")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = score_counts(scored, list(models)).withColumn(
        "lower", F.coalesce(F.sum("negatives").over(ascending), F.lit(0)).cast("double")
    )
    won = F.col("positives") * (F.col("lower") + F.col("negatives") / 2)
    totals = counts.groupBy("model_name").agg(
        F.sum("positives").alias("p"),
        F.sum("negatives").alias("n"),
        F.sum("caught").alias("tp"),
        F.sum("false_alarms").alias("fp"),
        F.sum(won).alias("won"),
    )
    p, n, tp, fp = (F.col(name) for name in ("p", "n", "tp", "fp"))
    f1 = _ratio(2 * tp, p + tp + fp)
    name = F.col("model_name")
    order = {model: i for i, model in enumerate(models)}
    return totals.select(
        name,
        constant_by(models, name).alias("display_name"),
        constant_by(order, name).alias("model_order"),
        constant_by({m: (status or {}).get(m, "ok") for m in models}, name).alias("status"),
        constant_by({m: (notes or {}).get(m, "") for m in models}, name).alias("notes"),
        ((tp + n - fp) / (p + n)).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, p).alias("recall"),
        f1.alias("f1"),
        F.when((p > 0) & (n > 0), F.col("won") / (p.cast("double") * n)).alias("roc_auc"),
        (p + n).alias("support"),
        (tp + fp).alias("flagged_count"),
        verdict(f1).alias("verdict"),
    )


def leaderboard(metric_rows: DataFrame) -> DataFrame:
    """Models by F1, recall and accuracy; ties keep the model order."""
    worst = F.lit(-1.0)
    return metric_rows.orderBy(
        *[F.coalesce(F.col(c), worst).desc() for c in ("f1", "recall", "accuracy")],
        "model_order",
    )


def best_model(metric_rows: DataFrame) -> str:
    return leaderboard(metric_rows).select("model_name").first()[0]


def metric_table(metric_rows: DataFrame) -> DataFrame:
    """Leaderboard rows for display, numbers as text."""
    return leaderboard(metric_rows).select(
        F.col("display_name").alias("model"),
        *[metric_cell(F.col(name)).alias(name) for name in METRICS],
        "verdict",
    )


def f1_chart(metric_rows: DataFrame) -> DataFrame:
    return metric_rows.select("display_name", "f1").orderBy("f1", "model_order")


def roc_curve(
    scored: DataFrame, models: Sequence[str], drop_collinear: bool = True
) -> DataFrame:
    """Points of each model's ROC curve on 3-digit scores, from (0, 0).

    No points for a split with one class.  Points on a straight line between
    their neighbours are left out unless asked for.
    """
    by_model = Window.partitionBy("model_name")
    down = by_model.orderBy(F.col("score").desc())
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    points = (
        score_counts(scored, models, shown=True)
        .select(
            "model_name",
            F.col("score").alias("threshold"),
            F.sum("positives").over(upto).alias("tps"),
            F.sum("negatives").over(upto).alias("fps"),
            F.sum("positives").over(by_model).alias("p"),
            F.sum("negatives").over(by_model).alias("n"),
        )
        .where((F.col("p") > 0) & (F.col("n") > 0))
    )
    if drop_collinear:
        along = by_model.orderBy(F.col("threshold").desc())
        bends = [
            (F.lead(c).over(along) - 2 * F.col(c) + F.lag(c).over(along)) != 0
            for c in ("tps", "fps")
        ]
        # Without a neighbour on one side the test is null: an end point.
        points = points.withColumn("keep", F.coalesce(bends[0] | bends[1], F.lit(True))).where(
            "keep"
        )
    curve = points.select(
        "model_name",
        (F.col("fps") / F.col("n")).alias("fpr"),
        (F.col("tps") / F.col("p")).alias("tpr"),
        "threshold",
    )
    start = points.groupBy("model_name").agg(
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold")
    )
    return start.unionByName(curve)


def confusion(scored: DataFrame, model: str) -> DataFrame:
    """The four cells of the confusion matrix, zeros included."""
    label, flag = F.col("failure_label"), F.col(f"{model}_prediction")
    cells = [(t, p) for t in (0, 1) for p in (0, 1)]
    wide = scored.agg(
        *[F.count_if((label == t) & (flag == p)).alias(f"c{t}{p}") for t, p in cells]
    )
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        label_text(F.lit(t)).alias("true_label"),
                        label_text(F.lit(p)).alias("predicted_label"),
                        F.col(f"c{t}{p}").alias("rows"),
                    )
                    for t, p in cells
                ]
            )
        )
    )


def class_distribution(df: DataFrame) -> DataFrame:
    """Rows per class, zeros included; without labels all rows are normal."""
    if "failure_label" in df.columns:
        label = F.col("failure_label")
        wide = df.agg(
            F.count_if(label == 0).alias("normal"), F.count_if(label == 1).alias("failed")
        )
    else:
        wide = df.agg(F.count(F.lit(1)).alias("normal"), F.lit(0).cast("long").alias("failed"))
    return wide.select(
        F.inline(
            F.array(
                F.struct(F.lit("Normal").alias("class"), F.col("normal").alias("rows")),
                F.struct(F.lit("Failure").alias("class"), F.col("failed").alias("rows")),
            )
        )
    )


def score_histogram(
    scored: DataFrame, models: Sequence[str], bins: int = fixed.HISTOGRAM_BINS
) -> DataFrame:
    """Equal-width bins over each model's own range of 3-digit scores."""
    by_model = Window.partitionBy("model_name")
    low, high = F.min("score").over(by_model), F.max("score").over(by_model)
    ranged = (
        score_counts(scored, models, shown=True)
        .select(
            "model_name", "score",
            (F.col("positives") + F.col("negatives")).alias("rows"),
            F.when(low == high, low - 0.5).otherwise(low).alias("low"),
            F.when(low == high, high + 0.5).otherwise(high).alias("high"),
        )
        .withColumn("step", (F.col("high") - F.col("low")) / bins)
    )
    # Place by division, then correct against the edges themselves.
    guess = F.least(
        F.floor((F.col("score") - F.col("low")) / (F.col("high") - F.col("low")) * bins),
        F.lit(bins - 1),
    )
    left = F.col("low") + F.col("guess") * F.col("step")
    right = F.col("low") + (F.col("guess") + 1) * F.col("step")
    place = (
        F.when(F.col("score") < left, F.col("guess") - 1)
        .when((F.col("score") >= right) & (F.col("guess") < bins - 1), F.col("guess") + 1)
        .otherwise(F.col("guess"))
    )
    per_bin = (
        ranged.withColumn("guess", guess)
        .withColumn("bin", place)
        .groupBy("model_name", "low", "step")
        .pivot("bin", list(range(bins)))
        .agg(F.sum("rows"))
    )
    entries = [
        F.struct(
            F.lit(i).alias("bin"),
            (F.col("low") + i * F.col("step")).alias("bin_start"),
            F.coalesce(F.col(str(i)), F.lit(0)).alias("rows"),
        )
        for i in range(bins)
    ]
    return per_bin.select("model_name", F.inline(F.array(*entries)))


def fault_summary(scored: DataFrame, models: Mapping[str, str]) -> DataFrame:
    """Failures caught, failures in all and rows flagged, per model."""
    failed = F.col("failure_label") == 1
    flags = {model: F.col(f"{model}_prediction") == 1 for model in models}
    counts = scored.agg(
        F.count_if(failed).alias("failures"),
        *[F.count_if(flag & failed).alias(f"{model}_caught") for model, flag in flags.items()],
        *[F.count_if(flag).alias(f"{model}_flagged") for model, flag in flags.items()],
    )
    rows = [
        F.struct(
            F.lit(model).alias("model_name"),
            F.col(f"{model}_caught").alias("caught"),
            F.col("failures").alias("true_failures"),
            F.col(f"{model}_flagged").alias("flagged"),
            F.lit(name).alias("display_name"),
        )
        for model, name in models.items()
    ]
    return counts.select(F.inline(F.array(*rows)))
