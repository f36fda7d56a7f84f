"""Session helpers: a local session for tests and the shared staging folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: int | str = 8, name: str = "millwatch", **settings: str) -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores).replace("*", "8"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def staging_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    without that setting gets a temporary folder, which goes with the process.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that every executor can reach.")
    own = tempfile.mkdtemp(prefix="millwatch-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context.setCheckpointDir(own)
    return context.getCheckpointDir().rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{staging_folder(spark)}/millwatch/{spark.sparkContext.applicationId}"


def staging_path(spark: SparkSession, label: str) -> str:
    return f"{_own_folder(spark)}/{label}-{uuid4().hex}"


def clear_staging(spark: SparkSession) -> None:
    """Delete what this application has staged, once its frames are done with."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """A block of work whose staged tables go when it ends; frames that outlast it must be written before."""
    try:
        yield
    finally:
        clear_staging(spark)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a frame to the staging folder and read it back.

    Cuts the lineage with a table that survives lost executors and, unlike a
    row checkpoint, still lets later steps read only the columns they use.
    """
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_observed(df: DataFrame, metrics: Mapping[str, Column], label: str = "stage") -> tuple[DataFrame, dict[str, object]]:
    """``stage`` and the values of aggregates over the frame, taken while it is written."""
    seen = Observation()
    staged = stage(df.observe(seen, *[metric.alias(name) for name, metric in metrics.items()]), label)
    return staged, dict(seen.get)
