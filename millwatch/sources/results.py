"""The result of a run as a folder of datasets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Per-reading datasets stay spread over many files; the others are tiny.
LARGE = ("per_sample", "anomaly_score_ranking")
_ABOUT = "about"


def save_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small text through Spark, so any file system will do."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_text(spark: SparkSession, path: str) -> str:
    return "\n".join(row[0] for row in spark.read.text(path, wholetext=True).collect())


def save_results(
    spark: SparkSession, path: str, frames: dict[str, DataFrame], about: dict[str, object]
) -> None:
    """One JSON-lines dataset per part, plus a small document about the run."""
    for name, frame in frames.items():
        out = frame if name in LARGE else frame.coalesce(1)
        out.write.mode("overwrite").json(f"{path}/{name}", ignoreNullFields=False)
    schemas = {name: frame.schema.jsonValue() for name, frame in frames.items()}
    save_text(spark, f"{path}/{_ABOUT}", json.dumps({**about, "schemas": schemas}))


def load_results(
    spark: SparkSession, path: str
) -> tuple[dict[str, DataFrame], dict[str, object]]:
    """The datasets and the document of a saved run; a missing folder raises."""
    about = json.loads(load_text(spark, f"{path}/{_ABOUT}"))
    schemas = about.pop("schemas")
    frames = {
        name: spark.read.schema(StructType.fromJson(schema)).json(f"{path}/{name}")
        for name, schema in schemas.items()
    }
    return frames, about
