"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where it is unset and the master is local (tests) a local one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: it is computed once, has no lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task holds at once where it groups or sorts.
ROWS = 500_000


def partitions(spark: SparkSession, rows: int, most: int = ROWS) -> int:
    """Partitions of so many rows that are grouped or sorted whole: no fewer than shuffles have, and so many that the memory of
    a task doesn't grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))


def stacked(parts: list[DataFrame], *keys: str) -> DataFrame:
    """The rows of all parts, dealt by the keys. A union of parts that are partitioned alike passes for partitioned itself,
    while adaptive execution joins up the partitions of each part in its own way; so what groups a union by such keys needs
    an exchange behind it, as here."""
    return reduce(DataFrame.unionByName, parts).repartition(*keys)
