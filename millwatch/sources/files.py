"""Small steps on whatever file system a path belongs to, through the session's own clients."""

from __future__ import annotations

import time
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):  # noqa: ANN202
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    place, system = _place(spark, path)
    return system.exists(place)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file, of a folder's files or of all that a pattern names; none if nothing is there."""
    place, system = _place(spark, path)
    return sum(system.getContentSummary(found.getPath()).getLength() for found in system.globStatus(place) or [])


def delete_path(spark: SparkSession, path: str) -> None:
    place, system = _place(spark, path)
    system.delete(place, True)


def subfolders(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """Folders in a folder and the seconds since they changed; none if it is not there."""
    place, system = _place(spark, path)
    if not system.exists(place):
        return []
    now = time.time()
    return [
        (status.getPath().toString(), now - status.getModificationTime() / 1000)
        for status in system.listStatus(place) if status.isDirectory()
    ]


def put_text_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole or not at all; False if another was there first.

    The text goes to a hidden file beside it, which a rename that never replaces puts
    in place.
    """
    jvm = spark._jvm
    place, system = _place(spark, path)
    folder = place.getParent()
    system.mkdirs(folder)
    hidden = jvm.org.apache.hadoop.fs.Path(folder, f".{uuid4().hex}")
    out = system.create(hidden, False)
    out.write(bytearray(text.encode()))
    out.close()
    names = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        names.rename(system.makeQualified(hidden), system.makeQualified(place), options)
    except Py4JJavaError as error:
        system.delete(hidden, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True
