"""Operators that have no table of their own: sources, generators, streams, learning, edge cases."""

import math

import numpy as np
from pyspark.sql import functions as F

from simplicia.functions import scalars
from simplicia.operators import diagrams, embedding, evaluate, generators, homology, learn, panel
from simplicia.sources import readers
from simplicia.streaming.series import streaming_takens


def test_arff(spark, tmp_path):
    (tmp_path / "a.arff").write_text("% c\n@attribute x numeric\n@data\n1,2,3,1\n4,5,bad,-1\n")
    got = sorted(readers.arff_series(spark, str(tmp_path / "a.arff")).collect(), key=lambda r: r.series_id)
    assert [r.x for r in got] == [[1.0, 2.0, 3.0], [4.0, 5.0, None]] and [r.label for r in got] == [1, 0]


def test_meshes(spark, tmp_path):
    n = 12
    ring = [(math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n), 0.0) for k in range(n)]
    text = f"OFF\n{n + 1} {n} 0\n0 0 0\n" + "\n".join("%f %f %f" % p for p in ring) + "\n" + "\n".join(f"3 0 {k + 1} {(k + 1) % n + 1}" for k in range(n))
    (tmp_path / "good.off").write_text(text)
    (tmp_path / "bad.off").write_text("OFF nonsense")
    got = {r.path.rsplit("/", 1)[-1]: r for r in readers.off_clouds(spark, str(tmp_path), points=50, least=5).collect()}
    p = np.array(got["good.off"].points)
    assert p.shape == (50, 3) and (np.hypot(p[:, 0], p[:, 1]) <= 1 + 1e-9).all() and got["bad.off"].status != "ok"


def test_tolerant_scan_and_reports(spark, tmp_path):
    readers.write_features(spark.range(3).withColumn("v", F.lit(1.5)), str(tmp_path / "f"))
    df, missing = readers.tolerant_table(spark, str(tmp_path / "f"), ["id", "nope"])
    assert df.columns == ["id"] and missing == ["nope"]
    readers.write_report(spark.range(2), str(tmp_path / "r"))
    assert readers.csv_table(spark, str(tmp_path / "r"), "id long").count() == 2


def test_generated_shapes(spark):
    t = generators.torus(spark, 200, seed=1).select((F.pow(F.sqrt(F.col("x0") ** 2 + F.col("x1") ** 2) - 2, 2) + F.col("x2") ** 2).alias("r")).collect()
    assert all(abs(r.r - 1) < 1e-9 for r in t)
    s = generators.sphere(spark, 200, seed=1).select((F.col("x0") ** 2 + F.col("x1") ** 2 + F.col("x2") ** 2).alias("r")).collect()
    assert all(abs(r.r - 1) < 1e-9 for r in s)
    assert generators.double_helix(spark, 30).count() == 60 and generators.porous_block(spark, 50, seed=2).count() == 50
    ar = generators.simulated(spark, "ar1", 3000, series=2, phi=0.8).filter("series = 0").orderBy("i").toPandas()["x"].to_numpy()
    assert abs(np.corrcoef(ar[1:], ar[:-1])[0, 1] - 0.8) < 0.06
    for kind in ("rossler", "lorenz", "hawkes"):
        assert generators.simulated(spark, kind, 100).count() == 100
    mixed = generators.embedded_signal(generators.simulated(spark, "ar1", 256), "square", 2.0)
    assert mixed.count() == 256


def test_circle_has_one_loop(spark):
    c = generators.circle(spark, 40, noise=0.01, clouds=3, seed=4)
    clouds = c.groupBy("cloud").agg(F.collect_list(F.array("x0", "x1", "x2")).alias("points"))
    dgm = homology.diagram(homology.persistence(clouds, 1, keep=("cloud",)), "cloud", dim=1)
    top = diagrams.summary(dgm, "cloud").collect()
    assert len(top) == 3 and all(r.ring_05 == 1 and r.max_pers > 0.7 for r in top)


def test_bad_clouds_keep_a_status(spark):
    df = spark.createDataFrame([(1, [[0.0, 1.0], [float("nan"), 0.0]]), (2, []), (3, None), (4, [[0.0, 0.0], [0.0, 1.0]])], "cloud long, points array<array<double>>")
    got = {r.cloud: r for r in homology.persistence(df, 1, keep=("cloud",)).collect()}
    assert got[1].status != "ok" and got[1].bars == [] and got[2].status == got[3].status == "ok" and len(got[4].bars) == 2


def test_clean_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("nan",), ("inf",), ("x",), (None,), ("-inf",)], "v string")
    assert [r.c for r in df.select(scalars.clean(F.col("v")).alias("c")).collect()] == [1.5, None, None, None, None, None]


def test_short_series(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (2, 1, 1.0), (2, 2, 3.0)], "k long, t long, v double")
    assert embedding.takens(embedding.indexed(df, "k", ["t"], "v"), "k", "v", 3, 2).count() == 0
    assert {r.tau_ac for r in embedding.tau_autocorrelation(embedding.as_arrays(df, "k", ["t"], "v"), "v").collect()} == {1}


def test_purged_folds_keep_their_distance(spark):
    ordered = spark.range(200).select(F.col("id").alias("i"), F.lit(200).alias("n"))
    got = evaluate.purged_folds(ordered, 4, 20, 5).groupBy("k", "role").agg(F.min("i").alias("lo"), F.max("i").alias("hi")).collect()
    by = {(r.k, r.role): r for r in got}
    assert all(by[k, "test"].lo - by[k, "train"].hi > 25 for k in range(1, 5) if (k, "train") in by and (k, "test") in by)


def test_residuals_are_orthogonal(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=60)
    df = spark.createDataFrame([("m", i, float(y[i]), *map(float, x[i])) for i in range(60)], "month string, id long, y double, a double, b double")
    r = evaluate.residuals(df, "month", "id", "y", ["a", "b"]).orderBy("id").toPandas()["residual"].to_numpy()
    assert abs(r.sum()) < 1e-8 and np.abs(x.T @ r).max() < 1e-8


def test_stream_matches_batch(spark, tmp_path):
    df = spark.createDataFrame([(k, t, float(k * 100 + t)) for k in (1, 2) for t in range(12)], "k long, t long, v double")
    df.filter("t < 7").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.filter("t >= 7").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k long, t long, v double").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = streaming_takens(source, "k", "t", "v", 3, 2).writeStream.format("memory").queryName("pts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = embedding.takens(embedding.indexed(df, "k", ["t"], "v"), "k", "v", 3, 2)
    assert sorted(map(tuple, spark.table("pts").collect())) == sorted(map(tuple, want.collect()))


def test_kernel_machine_and_votes(spark):
    rng = np.random.default_rng(1)
    p = rng.normal(size=(120, 2))
    df = spark.createDataFrame([(i, [float(a), float(b)], int(a * a + b * b > 1.2)) for i, (a, b) in enumerate(p)], "id long, x array<double>, y int")
    machine, lifted = learn.kernel_machine(df, "x", 2, "y", 60)
    out = machine.fit(lifted).transform(lifted)
    assert evaluate.accuracy_f1(out, "label", "prediction").collect()[0].accuracy > 0.85
    ready = learn.prepared(df, "x", "y")
    models = [learn.forest(10, seed=s).fit(ready).transform(ready) for s in (1, 2)]
    assert learn.soft_votes(models, "id").count() == 120


def test_least_ratio(spark):
    df = spark.createDataFrame([("a", 50, 0.5, 1.0), ("a", 80, 0.05, 1.0), ("b", 50, 0.5, 1.0)], "k string, ratio int, d double, diam double")
    assert {r.k: r.min_ratio for r in panel.least_ratio(df, "k", "ratio", "d", "diam", 0.1).collect()} == {"a": 80, "b": 100}


def test_zeros_and_constant_series(spark):
    """Divisions by values of the data: zeros give nulls and constant series their stated results, no error."""
    from simplicia.functions import scalars
    from simplicia.operators import classic, diagrams, embedding, panel

    flat = spark.createDataFrame([(k, i, 2.0 if k else 0.0) for k in (0, 1) for i in range(40)], "k int, i int, x double")
    arrays = embedding.as_arrays(flat, "k", ["i"], "x")
    assert [r.tau_ac for r in embedding.tau_autocorrelation(arrays).collect()] == [1, 1]
    assert {r.tau_mi for r in embedding.tau_mutual_information(flat, "k").collect()} == {1}
    assert {r.bin for r in flat.select(scalars.bin_of(F.col("x"), F.col("x"), F.col("x"), 20).alias("bin")).collect()} == {0}
    assert classic.spectrum_features(classic.periodogram(arrays), "k").count() == 2
    assert {r.skew for r in classic.moments(flat, "k", "x").collect()} == {0.0}
    bars = spark.createDataFrame([(1, d, 1.0, 0.0, float(d % 2), 3.0, 4.0) for d in range(4)], "k int, d int, high double, low double, close double, volume double, amount double")
    got = {r.d: (r.ret, r.rng) for r in panel.bar_channels(bars, ["k"], "d").collect()}
    assert got[0] == (None, None) and got[1] == (None, 1.0) and got[2][0] is None
    bars0 = spark.createDataFrame([(1, 0.5, 0.5), (1, 0.2, 0.2)], "k int, birth double, death double")
    assert diagrams.summary(bars0, "k").collect()[0].entropy == 0.0


def test_a_cloud_that_is_too_large_shows(spark):
    """Its status reaches the result, or an error names it; it never passes for an empty diagram."""
    import pytest

    from simplicia.plans import shapes

    rng = np.random.default_rng(0)
    rows = [(1, rng.random((20, 3)).tolist()), (2, rng.random((200, 3)).tolist())]
    got = homology.persistence(spark.createDataFrame(rows, "user_id int, points array<array<double>>"), 2, keep=("user_id",))
    by = {(r.user_id, r.status == "ok") for r in shapes.by_dimension(got).collect()}
    assert by == {(1, True), (2, False)}
    with pytest.raises(Exception, match="cloud 2"):
        homology.diagram(got, "user_id").count()


def test_folds_and_coverage(spark):
    df = spark.createDataFrame([(i, i % 3, f"g{i % 7}") for i in range(300)], "i int, label int, g string")
    out = evaluate.stratified(df, "label", "i", 5, 0.7, seed=1).collect()
    assert {(lab, f): sum(r.label == lab and r.fold == f for r in out) for lab in range(3) for f in range(5)} == {(lab, f): 20 for lab in range(3) for f in range(5)}
    assert [sum(r.train for r in out if r.label == lab) for lab in range(3)] == [70, 70, 70]
    other = {r.i: r.fold for r in evaluate.stratified(df, "label", "i", 5, 0.7, seed=2).collect()}
    assert sum(other[r.i] != r.fold for r in out) > 100
    folds = df.select("g", evaluate.group_fold(F.col("g"), 4).alias("fold")).distinct().collect()
    assert len(folds) == 7
    gaps = spark.createDataFrame([(1.0, None, 2.0), (None, None, 3.0)], "a double, b double, c double")
    assert panel.covered_columns(gaps, ["a", "b", "c"], 0.5) == ["a", "c"] and panel.covered_columns(gaps.limit(0), ["a"], 0.5) == []
    assert [tuple(r) for r in panel.median_imputed(gaps, "a", "b").orderBy("c").collect()] == [(1.0, 0.0, 2.0), (1.0, 0.0, 3.0)]
    assert embedding.dimension_hint() == 4


def test_json_report(spark, tmp_path):
    import json

    (tmp_path / "r.json").write_text(json.dumps({"a": 1, "b": [1, 2]}, indent=2))
    assert readers.json_report(spark, str(tmp_path / "r.json")).first().b == [1, 2]
