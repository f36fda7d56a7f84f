"""Append-only tables under one folder, whose appends count once, when they are published."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from hashlib import md5
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwatch.sources.files import delete_path, path_exists, put_text_once, subfolders


class Commit:
    """Rows for several tables that become visible together, once for each key."""

    def __init__(self, tables: PublishedTables, key: str) -> None:
        self.tables, self.key, self.attempt = tables, key, uuid4().hex
        self.names: list[str] = []

    def append(self, name: str, rows: DataFrame) -> None:
        self.names.append(name)
        self.tables.write(name, rows, self.attempt)


class PublishedTables:
    """Parquet tables of given schemas under one root folder.

    Every append goes to a folder of its own attempt.  It is published by a small file
    that names the attempt, put in place by one rename; readers take published
    attempts only.  The file is named by the append's key, and the first attempt to
    put it there counts: a job that is tried again, after whatever failure, adds its
    rows once.
    """

    def __init__(
        self, spark: SparkSession, root: str, schemas: Mapping[str, str], partitions: Mapping[str, Sequence[str]] | None = None
    ) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.schemas, self.partitions = schemas, partitions or {}

    def _columns(self, name: str) -> list[str]:
        return T.StructType.fromDDL(self.schemas[name]).fieldNames()

    def create(self) -> None:
        """Create the tables that are not there yet."""
        with self.commit("created") as batch:
            for name, schema in self.schemas.items() if batch else ():
                batch.append(name, self.spark.createDataFrame([], schema))

    def write(self, name: str, rows: DataFrame, attempt: str) -> None:
        """Write rows of an attempt, to be published later."""
        schema = T.StructType.fromDDL(self.schemas[name])
        typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema], F.lit(attempt).alias("attempt"))
        partitions = ("attempt", *self.partitions.get(name, ()))
        typed.write.mode("append").partitionBy(*partitions).parquet(f"{self.root}/{name}")

    def _manifest(self, key: str) -> str:
        return f"{self.root}/published/{md5(key.encode()).hexdigest()}.json"

    def is_published(self, key: str) -> bool:
        return path_exists(self.spark, self._manifest(key))

    @contextmanager
    def commit(self, key: str) -> Iterator[Commit | None]:
        """A block whose appends are published at its end, or None if the key has been published before.

        Nothing of a block that fails is ever read.
        """
        if self.is_published(key):
            yield None
            return
        batch = Commit(self, key)
        yield batch
        text = json.dumps({"key": key, "attempt": batch.attempt, "tables": sorted(set(batch.names))})
        put_text_once(self.spark, self._manifest(key), text)

    def append(self, name: str, rows: DataFrame, key: str | None = None) -> bool:
        """Append rows to one table; False if rows of this key are there already."""
        with self.commit(key or uuid4().hex) as batch:
            if batch:
                batch.append(name, rows)
        return batch is not None

    def published(self) -> DataFrame:
        """Key, attempt and tables of every append that counts, a row for each."""
        return self.spark.read.schema("key string, attempt string, tables array<string>").json(f"{self.root}/published")

    def table(self, name: str) -> DataFrame:
        rows = self.spark.read.schema(f"{self.schemas[name]}, attempt string").parquet(f"{self.root}/{name}")
        counted = self.published().where(F.array_contains("tables", name)).select("attempt")
        return rows.join(counted, "attempt", "left_semi").select(*self._columns(name))

    def vacuum(self, older_than: float = 7 * 86_400.0) -> int:
        """Delete attempts that were never published and are older than so many seconds; their number."""
        known = {row["attempt"] for row in self.published().select("attempt").collect()}
        gone = 0
        for name in self.schemas:
            for folder, age in subfolders(self.spark, f"{self.root}/{name}"):
                attempt = folder.rsplit("attempt=", 1)[-1]
                if "attempt=" in folder and attempt not in known and age >= older_than:
                    delete_path(self.spark, folder)
                    gone += 1
        return gone
