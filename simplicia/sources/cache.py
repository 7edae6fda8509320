"""An incremental feature store: what was computed from the same content once isn't computed again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def content_key(*columns: str) -> Column:
    """md5 of the JSON text of the columns."""
    return F.md5(F.to_json(F.struct(*columns)))


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


class FeatureCache:
    """Features under a folder, keyed by content (column content). Each addition is a folder of its own that counts once its
    writer has committed it, so a job that dies leaves nothing that is read; `compacted` replaces the folders by one that is
    written whole before its name takes over. Readers see the folders there were when they began."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        """schema: DDL of the features, without content."""
        self.spark, self.path, self.schema = spark, path.rstrip("/"), f"content string, {schema}"

    def batches(self) -> list[str]:
        """Committed folders."""
        fs, root = _files(self.spark, self.path)
        if not fs.exists(root):
            return []
        found = [s.getPath().toString() for s in fs.listStatus(root) if s.isDirectory()]
        return sorted(p for p in found if fs.exists(_files(self.spark, f"{p}/_SUCCESS")[1]))

    def table(self) -> DataFrame:
        """content and the features of all that is stored, a row for each content."""
        paths = self.batches()
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths).dropDuplicates(["content"])

    def missing(self, keyed: DataFrame) -> DataFrame:
        """The distinct contents of keyed (content, ...) that aren't stored yet, a row for each."""
        return keyed.dropDuplicates(["content"]).join(self.table().select("content"), "content", "left_anti")

    def add(self, rows: DataFrame) -> int:
        """Stores rows (content and features) as a new folder; returns how many."""
        at = f"{self.path}/batch-{uuid.uuid4().hex}"
        names = [c.split()[0] for c in self.schema.split(", ")]
        rows.select(*names).write.parquet(at)
        return self.spark.read.schema(self.schema).parquet(at).count()

    def materialise(self, items: DataFrame, inputs: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """items with the features of their inputs. compute gets content and inputs of what is missing, once for each content,
        and returns content and the features; items without input keep null features."""
        keyed = items.withColumn("content", content_key(*inputs))
        new = self.missing(keyed.select("content", *inputs))
        if not new.isEmpty():
            self.add(compute(new))
        return keyed.join(self.table(), "content", "left").drop("content")

    def compacted(self) -> None:
        """One folder instead of many."""
        old = self.batches()
        if len(old) < 2:
            return
        at = f"{self.path}/batch-{uuid.uuid4().hex}"
        self.table().write.parquet(at)
        for p in old:
            fs, where = _files(self.spark, p)
            fs.delete(where, True)
