"""The feature store and the resumable scan."""

from pyspark.sql import functions as F

from simplicia.sources.cache import FeatureCache
from simplicia.sources.readers import batched_scan


def test_nothing_is_computed_twice(spark, tmp_path):
    store, seen = FeatureCache(spark, str(tmp_path / "store"), "total double"), []

    def total(new):
        seen.append(sorted(tuple(r["points"]) for r in new.collect()))
        return new.select("content", F.aggregate("points", F.lit(0.0), lambda a, x: a + x).alias("total"))

    first = spark.createDataFrame([(1, [1.0, 2.0]), (2, [5.0]), (3, [1.0, 2.0])], "id int, points array<double>")
    assert sorted((r["id"], r["total"]) for r in store.materialise(first, ["points"], total).collect()) == [(1, 3.0), (2, 5.0), (3, 3.0)]
    more = first.union(spark.createDataFrame([(4, [7.0]), (5, [5.0])], first.schema))
    assert sorted((r["id"], r["total"]) for r in store.materialise(more, ["points"], total).collect()) == [(1, 3.0), (2, 5.0), (3, 3.0), (4, 7.0), (5, 5.0)]
    store.materialise(more, ["points"], total)
    assert seen == [[(1.0, 2.0), (5.0,)], [(7.0,)]]


def test_what_isnt_committed_isnt_read(spark, tmp_path):
    store = FeatureCache(spark, str(tmp_path / "store"), "v int")
    rows = lambda *v: spark.createDataFrame([(f"c{x}", x) for x in v], "content string, v int")
    assert store.add(rows(1, 2)) == 2 and store.add(rows(2, 3)) == 2
    dead = tmp_path / "store" / "batch-dead"
    rows(9).write.parquet(str(dead))
    (dead / "_SUCCESS").unlink()
    assert len(store.batches()) == 2 and sorted(r["v"] for r in store.table().collect()) == [1, 2, 3]
    store.compacted()
    assert len(store.batches()) == 1 and sorted(r["v"] for r in store.table().collect()) == [1, 2, 3]
    assert store.missing(rows(3, 4)).select("content").collect() == [("c4",)]


def test_a_stopped_scan_goes_on(spark, tmp_path):
    source, sink, done = (str(tmp_path / x) for x in ("in", "out", "done"))
    rows = spark.range(100).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    rows.repartition(5).write.parquet(source)
    keys = spark.createDataFrame([(1,), (3,)], "k long")
    scan = lambda: batched_scan(spark, source, sink, done, ["k", "v", "day"], keys, "k", "day", "2020-02-01", files=2)
    want = lambda n: sorted(v for v in range(n) if v % 7 in (1, 3) and v >= 31)
    assert sorted(r["v"] for r in scan().collect()) == want(100)
    batches = len(list((tmp_path / "done" / "commits").glob("[0-9]*")))
    assert batches == 3  # five files, two at a time
    # as if it had stopped before the last batch was noted: the sink and the checkpoint agree again, nothing twice
    (tmp_path / "done" / "commits" / "2").unlink()
    (tmp_path / "done" / "commits" / ".2.crc").unlink(missing_ok=True)
    assert sorted(r["v"] for r in scan().collect()) == want(100)
    spark.range(100, 130).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("day")).coalesce(1).write.mode("append").parquet(source)
    assert sorted(r["v"] for r in scan().collect()) == want(130)
