"""Train and apply the four detectors, save and load them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch import fixed
from millwatch.functions.rounding import round_scaled
from millwatch.functions.scalar import health
from millwatch.operators.detectors.bottleneck import BottleneckModel, fit_bottleneck
from millwatch.operators.detectors.forest import NODE_SCHEMA, ForestModel, grow_forest
from millwatch.operators.detectors.recon import ReconModel, fit_recon
from millwatch.operators.detectors.rule import RuleModel, batch_maxima, fit_rule, score_rules
from millwatch.operators.detectors.sequence import (
    RecurrentModel, SequenceModel, fit_recurrent, fit_sequence, score_sequence, with_sequence_score,
)
from millwatch.operators.normalize import number_of
from millwatch.operators.ordering import GROUP_ROWS, with_positions
from millwatch.operators.quantiles import GATHERED_VALUES, exact_quantiles
from millwatch.operators.stats import SCALED, TrainStats, normal_rows
from millwatch.plans.prepare import Prepared
from millwatch.session import stage
from millwatch.sources.results import load_text, save_text

MODELS = tuple(fixed.MODELS)


@dataclass(frozen=True)
class Detectors:
    """The fitted detectors and how to bring new readings to their inputs."""

    features: tuple[str, ...]
    medians: dict[str, float]
    means: dict[str, float]
    scales: dict[str, float]
    rule: RuleModel
    forest: ForestModel
    recon: ReconModel | BottleneckModel
    sequence: SequenceModel | RecurrentModel
    rule_maximum: float | None = None  # unit of the rule score when it is frozen
    stats: TrainStats | None = None  # what the train part was like; explanations refer to it

    @property
    def thresholds(self) -> dict[str, float]:
        return dict(
            zip(
                MODELS,
                (
                    self.rule.threshold, self.forest.threshold,
                    self.recon.threshold, self.sequence.threshold,
                ),
            )
        )

    @property
    def normalized_thresholds(self) -> dict[str, float]:
        """Limits on the scale of the scores themselves."""
        def placed(model: ForestModel | ReconModel) -> float:
            width = max(model.high - model.low, fixed.RANGE_FLOOR)
            return min(max((model.limit - model.low) / width, 0.0), 1.0)

        return {
            **self.thresholds,
            "isolation_forest": placed(self.forest),
            "autoencoder": placed(self.recon),
        }

    @property
    def status(self) -> dict[str, str]:
        return {**dict.fromkeys(MODELS, "ok"), "lstm": self.sequence.status}

    @property
    def notes(self) -> dict[str, str]:
        return {**dict.fromkeys(MODELS, ""), "lstm": self.sequence.notes}


def calibrate(
    forest: ForestModel, recon: ReconModel | BottleneckModel, normal: DataFrame, gathered_values: int = GATHERED_VALUES
) -> tuple[ForestModel, ReconModel | BottleneckModel]:
    """Range and flagging limit of both detectors from their train scores.

    The train rows are scored once, in one pass for both, and staged narrow.
    """
    raw = stage(
        normal.select(
            forest.raw(normal.sparkSession).alias("forest"), recon.raw().alias("recon")
        ),
        "calibration",
    )
    ends = raw.agg(
        *[f(c).alias(f"{c}_{n}") for c in ("forest", "recon") for n, f in (("low", F.min), ("high", F.max))]
    ).first()
    limits = exact_quantiles(
        raw, {"forest": forest.quantiles, "recon": [fixed.RECON_QUANTILE]}, gathered_values
    )
    return (
        replace(
            forest, low=ends["forest_low"], high=ends["forest_high"],
            limit=limits["forest"][0], offset=limits["forest"][1],
        ),
        replace(
            recon, low=ends["recon_low"], high=ends["recon_high"], limit=limits["recon"][0]
        ),
    )


def fit_detectors(
    prepared: Prepared,
    trees: int = fixed.FOREST_TREES,
    iterations: int = fixed.SEQUENCE_ITERATIONS,
    group_rows: int = GROUP_ROWS,
    gathered_values: int = GATHERED_VALUES,
    recon_kind: str = "components",
    sequence_kind: str = "perceptron",
) -> Detectors:
    """Fit all four detectors on the train split.

    Reconstruction is by principal ``components`` (one pass) or by a bottleneck
    ``network``; sequences are read by a ``perceptron`` over the whole window or by a
    ``recurrent`` cell.  Networks take some fifty passes over the train rows.
    """
    if recon_kind not in ("components", "network") or sequence_kind not in ("perceptron", "recurrent"):
        raise ValueError(f"Unknown kind of detector: {recon_kind!r}, {sequence_kind!r}.")
    stats, train = prepared.stats, prepared.train
    scaled = [SCALED.format(name) for name in prepared.features]
    normal = normal_rows(train, stats)
    rows = stats.normal_rows or stats.rows
    forest = grow_forest(normal, scaled, rows, stats.contamination, trees)
    redrawn = fit_recon(normal, scaled) if recon_kind == "components" else fit_bottleneck(normal, scaled, rows)
    forest, recon = calibrate(forest, redrawn, normal, gathered_values)
    if sequence_kind == "perceptron":
        sequence = fit_sequence(train, scaled, stats.classes, iterations, group_rows=group_rows)
    else:
        sequence = fit_recurrent(train, scaled, stats.classes, stats.rows, group_rows=group_rows)
    return Detectors(
        prepared.features,
        prepared.medians,
        stats.means,
        stats.scales,
        fit_rule(stats),
        forest,
        recon,
        sequence,
        stats=stats,
    )


def _with_scores(df: DataFrame, models: tuple[str, ...]) -> DataFrame:
    return df.withColumns({f"{m}_score": round_scaled(F.col(f"{m}_raw"), 6) for m in models})


def _score_rule(df: DataFrame, detectors: Detectors) -> DataFrame:
    unit = detectors.rule_maximum
    return score_rules(
        df, {"rule_based": detectors.rule}, None if unit is None else {"rule_based": unit}
    )


def _score_row_local(df: DataFrame, detectors: Detectors) -> DataFrame:
    raw = df.withColumns(
        {
            "_forest": detectors.forest.raw(df.sparkSession),
            "_recon": detectors.recon.raw(),
        }
    )
    return raw.withColumns(
        {
            "isolation_forest_raw": detectors.forest.score(F.col("_forest")),
            "isolation_forest_prediction": detectors.forest.predict(F.col("_forest")),
            "autoencoder_raw": detectors.recon.score(F.col("_recon")),
            "autoencoder_prediction": detectors.recon.predict(F.col("_recon")),
        }
    ).drop("_forest", "_recon")


def score_detectors(
    df: DataFrame, detectors: Detectors, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Add score and prediction of every detector to a prepared split.

    Predictions come from the unrounded scores, which are dropped.
    """
    ruled = _score_rule(df, detectors)
    scored = score_sequence(_score_row_local(ruled, detectors), detectors.sequence, "lstm", group_rows)
    return _with_scores(scored, MODELS).drop(*[f"{m}_raw" for m in MODELS])


def score_prepared(prepared: Prepared, detectors: Detectors, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Scores of the test split, staged for evaluation."""
    scored = score_detectors(prepared.test, detectors, group_rows)
    scaled = [SCALED.format(name) for name in prepared.features]
    return stage(scored.drop("split", "split_position", *scaled), "scored")


def train_and_score(prepared: Prepared, **options) -> tuple[Detectors, DataFrame]:
    """Fit on train, score test; the scored rows are staged for evaluation."""
    detectors = fit_detectors(prepared, **options)
    return detectors, score_prepared(prepared, detectors, options.get("group_rows", GROUP_ROWS))


def inference_table(spark: SparkSession, detectors: Detectors) -> DataFrame:
    """Threshold, status and notes per model, beside the scored frame."""
    rows = [
        (m, detectors.thresholds[m], detectors.normalized_thresholds[m], detectors.status[m], detectors.notes[m])
        for m in MODELS
    ]
    return spark.createDataFrame(
        rows,
        "model_name string, threshold double, threshold_normalized double, status string, notes string",
    )


def freeze(detectors: Detectors, df: DataFrame) -> Detectors:
    """Fix the unit of the rule score to that of the given batch."""
    return replace(detectors, rule_maximum=batch_maxima(df, {"rule": detectors.rule})["rule"])


def save_detectors(spark: SparkSession, detectors: Detectors, path: str) -> None:
    """Parameters as one document, trees as a table, classifier as it saves itself."""
    forest = {k: v for k, v in asdict(replace(detectors.forest, nodes=None)).items() if k != "nodes"}
    document = {
        "features": detectors.features,
        "medians": detectors.medians,
        "means": detectors.means,
        "scales": detectors.scales,
        "rule": asdict(detectors.rule),
        "rule_maximum": detectors.rule_maximum,
        "stats": None if detectors.stats is None else asdict(detectors.stats),
        "forest": forest,
        "recon": asdict(detectors.recon),
        "sequence": _saved_sequence(detectors.sequence),
    }
    save_text(spark, f"{path}/parameters", json.dumps(document))
    nodes = spark.createDataFrame(detectors.forest.nodes, NODE_SCHEMA)
    nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    if isinstance(detectors.sequence, SequenceModel) and detectors.sequence.fitted:
        detectors.sequence.classifier.write().overwrite().save(f"{path}/sequence")


def _saved_sequence(model: SequenceModel | RecurrentModel) -> dict[str, object]:
    if isinstance(model, RecurrentModel):
        return asdict(model)
    return {"features": model.features, "fitted": model.fitted}


def _loaded_sequence(saved: dict[str, object], path: str) -> SequenceModel | RecurrentModel:
    features = tuple(saved["features"])
    if "parameters" in saved:
        numbers = saved["parameters"]
        return RecurrentModel(**{**saved, "features": features, "parameters": None if numbers is None else tuple(numbers)})
    found = MultilayerPerceptronClassificationModel.load(f"{path}/sequence") if saved["fitted"] else None
    return SequenceModel(features, found)


def _loaded_recon(saved: dict[str, object]) -> ReconModel | BottleneckModel:
    features = tuple(saved["features"])
    if "neck" in saved:
        return BottleneckModel(**{**saved, "features": features, "parameters": tuple(saved["parameters"])})
    residual = tuple(map(tuple, saved["residual"]))
    return ReconModel(**{**saved, "features": features, "means": tuple(saved["means"]), "residual": residual})


def _loaded_stats(saved: dict[str, object] | None) -> TrainStats | None:
    return None if saved is None else TrainStats(**{**saved, "features": tuple(saved["features"])})


def load_detectors(spark: SparkSession, path: str) -> Detectors:
    document = json.loads(load_text(spark, f"{path}/parameters"))
    nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/trees").toPandas()
    rule, forest, recon, sequence = (
        document[name] for name in ("rule", "forest", "recon", "sequence")
    )
    return Detectors(
        tuple(document["features"]),
        document["medians"],
        document["means"],
        document["scales"],
        RuleModel(**{**rule, "features": tuple(rule["features"])}),
        ForestModel(**{**forest, "features": tuple(forest["features"])}, nodes=nodes),
        _loaded_recon(recon),
        _loaded_sequence(sequence, path),
        document["rule_maximum"],
        _loaded_stats(document.get("stats")),
    )


def bring_to_inputs(df: DataFrame, detectors: Detectors) -> DataFrame:
    """Fill and scale canonical readings with the saved values."""
    filled = df.withColumns(
        {
            name: F.coalesce(number_of(F.col(name), df.schema[name].dataType), F.lit(value))
            for name, value in detectors.medians.items()
        }
    )
    return filled.withColumns(
        {
            SCALED.format(name): (F.col(name) - F.lit(detectors.means[name])) / F.lit(detectors.scales[name])
            for name in detectors.features
        }
    )


def _score_frozen(inputs: DataFrame, detectors: Detectors) -> DataFrame:
    if detectors.rule_maximum is None:
        raise ValueError("Freeze the detectors first: the rule score would depend on the batch.")
    return _score_row_local(_score_rule(inputs, detectors), detectors)


def score_row_local(df: DataFrame, detectors: Detectors) -> DataFrame:
    """Rule, forest and reconstruction scores of canonical readings.

    Needs a frozen rule unit; then each row stands alone and the frame may be
    a stream.
    """
    scored = _with_scores(_score_frozen(bring_to_inputs(df, detectors), detectors), MODELS[:3])
    inner = [f"{m}_raw" for m in MODELS[:3]] + [SCALED.format(n) for n in detectors.features]
    return scored.drop(*inner)


def score_inputs(rows: DataFrame, detectors: Detectors) -> DataFrame:
    """Scores of all four detectors for filled, scaled readings that have their ``window`` already."""
    scored = with_sequence_score(_score_frozen(rows, detectors), detectors.sequence, "lstm")
    return _with_scores(scored, MODELS).drop(*[f"{m}_raw" for m in MODELS])


def score_saved(
    df: DataFrame, detectors: Detectors, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Score a new canonical table with saved detectors, all rows as one split.

    Rows without machine id belong to no timeline and are left out.
    """
    inputs = bring_to_inputs(df, detectors).withColumn("split", F.lit("new"))
    placed = with_positions(
        inputs, "machine_id", "timestamp", "sample_id", group_rows, "split_position", "_size"
    ).drop("_size")
    scored = score_detectors(placed, detectors, group_rows)
    drop = ["split", "split_position", *[SCALED.format(n) for n in detectors.features]]
    return scored.drop(*drop).withColumns(
        {f"{m}_health": health(F.col(f"{m}_score")) for m in MODELS}
    )
