"""Learning and feature sets against known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from simplicia.operators import embedding, evaluate, homology, learn, panel
from simplicia.sources import readers


def labelled(spark, n=120, classes=3):
    rng = np.random.default_rng(0)
    rows = [(i, i % classes, (rng.normal(0, 0.3, 2) + [4 * (i % classes), (i % classes) ** 2]).tolist(), i % 5 // 3) for i in range(n)]
    return learn.prepared(spark.createDataFrame(rows, "id int, y int, x array<double>, fold int"), "x", "y").select("id", "vector", "label", "fold")


def test_boosted_classes_and_votes(spark):
    df = labelled(spark)
    out = learn.against_rest(df, learn.boosted(3), [0.0, 1.0, 2.0], "fold", 2, ["id"])
    rows = out.collect()
    assert len(rows) == 120 and all(abs(sum(r["probability"]) - 1) < 1e-9 and r["prediction"] == int(np.argmax(r["probability"])) for r in rows)
    assert np.mean([r["label"] == r["prediction"] for r in rows]) > 0.95
    votes = learn.soft_votes([out, out], "id").collect()
    assert len(votes) == 120 and {(r["id"], r["prediction"]) for r in votes} == {(r["id"], r["prediction"]) for r in rows}


def test_second_phase_starts_where_the_first_ended(spark):
    df = labelled(spark)
    one, two = learn.two_phases(df, [2, 6, 3], 3, 30)
    loss = [learn.log_loss(m.transform(df)).collect()[0] for m in (one, two)]
    assert loss[1]["loss"] <= loss[0]["loss"] + 1e-9 and loss[1]["accuracy"] > 0.9 and loss[0]["n"] == 120
    assert list(learn.perceptron([2, 6, 3], 0).setInitialWeights(one.weights).fit(df).weights) == pytest.approx(list(one.weights))


def test_components_inside_folds(spark):
    df = labelled(spark)
    got = learn.cross_validated(df, learn.forest(5), "fold", 2, ["id"], 1)
    assert got.count() == 120 and got.filter("label = prediction").count() > 60


def test_fold_scores_are_least_squares_of_the_other_folds(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, int(rng.integers(0, 3)), int(rng.integers(0, 2)), float(rng.normal()), float(rng.normal())) for g in "ab" for i in range(40)]
    rows += [("flat", i, i % 2, i % 2, 1.0, float(i)) for i in range(8)] + [("a", 99, 0, 1, None, 1.0)]
    df = spark.createDataFrame(rows, "g string, i int, fold int, y int, a double, b double")
    got = {(r["g"], r["i"]): r["score"] for r in evaluate.fold_scores(df, ["g"], "fold", "y", "a", "b").collect()}
    assert len(got) == len(rows) and got["a", 99] is None and all(got["flat", i] is None for i in range(8))
    for g in "ab":
        mine = [r for r in rows if r[0] == g and r[4] is not None]
        for fold in range(3):
            train = [r for r in mine if r[2] != fold]
            beta = np.linalg.lstsq(np.array([[1, r[4], r[5]] for r in train]), np.array([r[3] for r in train]), rcond=None)[0]
            for r in (r for r in mine if r[2] == fold):
                assert got[g, r[1]] == pytest.approx(beta @ [1, r[4], r[5]])


def test_window_rows_and_edges(spark):
    s = spark.createDataFrame([(k, i, float(i * i % 17)) for k, n in (("a", 30), ("b", 9)) for i in range(n)], "k string, i int, x double")
    rows = panel.window_rows(s, "k", ["x"], 10, 4, 2)
    assert sorted((r["start"], r["count"]) for r in rows.groupBy("k", "start").count().collect()) == [(c, 10) for c in (0, 4, 8, 12, 16)]
    assert rows.filter("at <> i - start or at < 0 or at > 9").isEmpty()
    cloud = embedding.takens(s, "k", "x", 2, 3)
    near = homology.near_in_time(cloud, "k", ["x0", "x1"], 7)
    want = {(k, i, j) for k, n in (("a", 27), ("b", 6)) for i in range(n) for j in range(i + 1, min(n, i + 7))}
    assert {(r["k"], r["i"], r["j"]) for r in near.collect()} == want and near.count() == len(want)
    edges = panel.window_edges(near, s.groupBy("k").agg(F.count("*").alias("n")), "k", 4, 10, 4, 2)
    assert {(r["start"], r["i"], r["j"]) for r in edges.collect()} == {(c, i, j) for c in (0, 4, 8, 12, 16) for i in range(c, c + 7) for j in range(i + 1, c + 7)}


def test_dimension_hint_and_json(spark, tmp_path):
    assert [embedding.dimension_hint(m) for m in (1, 3, 4, 9)] == [3, 3, 4, 4]
    readers.write_report(spark.range(3), str(tmp_path / "r"), "json")
    assert spark.read.json(str(tmp_path / "r")).count() == 3


def test_boosted_votes_fit_whole_ensembles(spark, monkeypatch):
    """four rounds and ten trees left little of the learners to vote."""
    import os

    from simplicia.plans import learning

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    asked, forest = [], learn.forest

    def stop(df, classifier, *_):
        asked.append(classifier.getMaxIter())
        return df.select("o_orderkey", "label", learn.array_to_vector(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).alias("probability"), F.lit(0.0).alias("prediction"))

    monkeypatch.setattr(learn, "against_rest", stop)
    monkeypatch.setattr(learn, "forest", lambda *a: asked.append(forest(*a).getNumTrees()) or forest(2))
    assert learning.boosted_votes(spark, "/root/testdata/sf0.001").count() == 3
    assert asked == [100, 100, 100]
