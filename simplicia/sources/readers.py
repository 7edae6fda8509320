"""Sources and sinks: tables, series in ARFF text, meshes in OFF files, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tolerant_table(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """A pruned Parquet scan of the columns that exist, and the names of those that don't."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in columns if c in df.columns]), [c for c in columns if c not in df.columns]


def restricted_scan(spark: SparkSession, path: str, columns: list[str], keys: DataFrame, key: str, date: str | None = None, since: str | None = None) -> DataFrame:
    """A scan cut down to a key set and a first date before anything else reads it; the date filter reaches the
    files, the keys a semi join that Spark broadcasts by size."""
    df = spark.read.parquet(path).select(*columns)
    if date and since:
        df = df.filter(F.col(date) >= since)
    return df.join(keys.select(key), key, "left_semi")


def batched_scan(spark: SparkSession, path: str, sink: str, checkpoint: str, columns: list[str], keys: DataFrame, key: str, date: str | None = None, since: str | None = None, files: int = 8) -> DataFrame:
    """restricted_scan in batches of so many files: each is filtered before anything is kept, its rows are appended to the sink
    and its files noted in the checkpoint, so a scan that stops goes on where it was and one that is done reads only new
    files. Returns the sink."""
    schema = spark.read.parquet(path).schema
    named = f"{path[:-1]}[{path[-1]}]"  # a pattern for this one name, as a plain name would have to be a folder
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(named).select(*columns)
    if date and since:
        rows = rows.filter(F.col(date) >= since)
    rows = rows.join(keys.select(key), key, "left_semi")
    out = rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.schema(rows.schema).parquet(sink)


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def json_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def arff_series(spark: SparkSession, path: str, positive: str = "1") -> DataFrame:
    """series_id, x and label of ARFF text: comments and declarations skipped, the last field the class. ids follow
    the place of a line in its file; all values of a line stay."""
    text = spark.read.text(path).select(F.trim("value").alias("line"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("id"))
    data = text.filter((F.col("line") != "") & ~F.col("line").startswith("%") & ~F.col("line").startswith("@"))
    parts = F.split("line", ",")
    n = F.size(parts)
    return data.select(F.col("id").alias("series_id"), "file", F.transform(F.slice(parts, F.lit(1), n - 1), lambda v: v.try_cast("double")).alias("x"), (F.trim(F.get(parts, n - 1)) == positive).cast("int").alias("label"))


def off_clouds(spark: SparkSession, path: str, points: int = 256, seed: int = 0, least: int = 100) -> DataFrame:
    """path, points and status of OFF meshes: points drawn uniformly by area from the faces. Unreadable meshes and
    those with fewer than `least` vertices keep a row that says so."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.off").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(frames):
        import zlib

        import numpy as np

        for f in frames:
            out, status = [], []
            for name, raw in zip(f["path"], f["content"], strict=True):
                try:
                    words = bytes(raw).decode("ascii", "replace").replace("OFF", " ", 1).split()
                    nv, nf = int(words[0]), int(words[1])
                    vertices = np.array(words[3 : 3 + 3 * nv], float).reshape(nv, 3)
                    faces, at = [], 3 + 3 * nv
                    for _ in range(nf):
                        k = int(words[at])
                        ring = [int(w) for w in words[at + 1 : at + 1 + k]]
                        faces += [(ring[0], ring[i], ring[i + 1]) for i in range(1, k - 1)]
                        at += 1 + k
                    if nv < least:
                        raise ValueError(f"{nv} vertices")
                    t = vertices[np.array(faces)]
                    area = np.linalg.norm(np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]), axis=1)
                    rng = np.random.default_rng([seed, zlib.crc32(name.encode())])
                    pick = t[rng.choice(len(t), points, p=area / area.sum())]
                    u, v = rng.random((2, points, 1))
                    flip = u + v > 1
                    u, v = np.where(flip, 1 - u, u), np.where(flip, 1 - v, v)
                    out.append((pick[:, 0] + u * (pick[:, 1] - pick[:, 0]) + v * (pick[:, 2] - pick[:, 0])).tolist())
                    status.append("ok")
                except Exception as e:  # noqa: BLE001  the reason goes to the status column
                    out.append([])
                    status.append(f"{type(e).__name__}: {e}"[:200])
            yield f[["path"]].assign(points=out, status=status)

    return files.mapInPandas(run, "path string, points array<array<double>>, status string")


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A report as CSV with a header, or as JSON lines."""
    if kind == "csv":
        df.write.mode("overwrite").csv(path, header=True)
    else:
        df.write.mode("overwrite").json(path)


def write_features(df: DataFrame, path: str, *partitions: str) -> None:
    """The feature store: Parquet, partitioned on request."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partitions) if partitions else w).parquet(path)
