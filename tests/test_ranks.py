"""Ranks, quantiles and expanding correlations of large groups against plain counting."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from simplicia.operators import evaluate, ranks


def average_ranks(v):
    return pd.Series(v).rank(method="average").to_numpy()


def plain_ic(x, y, least=10):
    if len(x) < least:
        return None
    a, b = average_ranks(x), average_ranks(y)
    return 0.0 if a.std() < 1e-12 or b.std() < 1e-12 else float(np.corrcoef(a, b)[0, 1])


def test_ranks_of_a_million_rows_of_one_feature(spark):
    """A third of them share one value; 200 ranges."""
    x = F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(400_000)) / 1000)
    df = spark.range(1_000_000).select(F.lit("f").alias("feature"), x.alias("x")).repartition(16)
    got = ranks.value_ranks(df, ["feature"], "x", parts=200).toPandas().sort_values("x")
    before = np.append(0, np.cumsum(got["n"].to_numpy())[:-1])
    assert got["n"].sum() == 1_000_000 and (got["before"].to_numpy() == before).all() and (got["rank"].to_numpy() == before + (got["n"].to_numpy() + 1) / 2).all()
    assert got["x"].is_unique and got.loc[got["x"] == 5.0, "n"].item() >= 333_333


def test_a_range_doesnt_hold_a_feature(spark):
    df = spark.range(20_000).select(F.lit("f").alias("feature"), F.rand(1).alias("x"))
    sizes = ranges_of(df)
    assert len(sizes) > 20 and max(sizes) < 3000


def ranges_of(df):
    dealt = ranks.ranges(df.groupBy("feature", "x").agg(F.count("*").alias("n")), ["feature"], "x", 32)
    return [r["count"] for r in dealt.groupBy("_p").count().collect()]


def test_auc_and_spearman_with_ties_and_nulls(spark):
    rng = np.random.default_rng(0)
    rows = [(k, float(rng.integers(0, 9)) if rng.random() > 0.1 else None, float(rng.integers(0, 5)) if rng.random() > 0.1 else None, int(rng.integers(0, 2))) for k in ("a", "b", None) for _ in range(120)]
    rows += [("flat", 1.0, float(i), i % 2) for i in range(12)] + [("few", float(i), float(-i), 1) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, x double, y double, label int")
    ics = {r["k"]: r["ic"] for r in evaluate.spearman(df, ["k"], "x", "y").collect()}
    aucs = {r["k"]: r["auc"] for r in evaluate.auc(df, ["k"], "x", "label").collect()}
    for k in ("a", "b", None):
        full = [(x, y) for q, x, y, _ in rows if q == k and x is not None and y is not None]
        assert ics[k] == pytest.approx(plain_ic(*zip(*full, strict=True)))
        pos, neg = ([x for q, x, _, z in rows if q == k and x is not None and z == lab] for lab in (1, 0))
        assert aucs[k] == pytest.approx(np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]))
    assert ics["flat"] == 0 and ics["few"] is None and aucs["flat"] == 0.5 and aucs["few"] is None
    assert evaluate.spearman(df.filter("false"), ["k"], "x", "y").count() == 0


@pytest.mark.parametrize("kind", ["even", "ties", "outliers", "one", "infinite"])
def test_quantiles(spark, kind):
    rng = np.random.default_rng(7)
    v = {"even": rng.normal(size=3001), "ties": np.repeat([1.0, 2.0, 7.0], [2000, 5, 1]), "outliers": np.append(rng.random(500), [1e300, -1e300, 1e9, 1e-300]), "one": np.array([3.5]), "infinite": np.append(rng.random(50), [np.inf] * 3 + [-np.inf] * 2)}[kind]
    qs = [0.0, 0.25, 0.5, 0.9, 0.995 if kind != "infinite" else 0.5001, 1.0]
    df = spark.createDataFrame([(k, float(x)) for k in ("a", "b") for x in v] + [("a", None), ("b", float("nan"))], "k string, x double")
    got = {(r["k"], r["q"]): r["x"] for r in ranks.quantiles(df, ["k"], "x", qs, bins=16).collect()}
    assert len(got) == 2 * len(qs)
    for (_, q), x in got.items():
        if kind == "infinite" and q in (0.0, 1.0):
            continue  # an infinite end, whose line to itself is not a number
        assert x == pytest.approx(np.quantile(v, q), rel=1e-12)
    whole = {r["q"]: r["x"] for r in ranks.quantiles(df.filter("k = 'a'").drop("k"), [], "x", [0.5]).collect()}
    assert whole[0.5] == pytest.approx(np.quantile(v, 0.5))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "k int, x double")
    assert [tuple(r) for r in ranks.quantiles(df, [], "x", [0.5]).collect()] == [(0.5, None)]
    assert ranks.quantiles(df, ["k"], "x", [0.5]).count() == 0
    assert tuple(ranks.column_quantiles(df, ["x"], 0.5).collect()[0]) == (None,)


@pytest.mark.parametrize("purge", [0, 2])
def test_expanding_correlation(spark, purge):
    """Ties across ranges, months without rows of a feature, and few rows at first."""
    rng = np.random.default_rng(purge)
    rows = [(f, int(m), float(rng.integers(0, 6)) if f == "tied" else float(rng.normal()), float(rng.integers(0, 40))) for f in ("tied", "free") for m in range(9) if (f, m) != ("free", 4) for _ in range(8)]
    df = spark.createDataFrame(rows, "feature string, number int, x double, y double")
    got = {(r["feature"], r["number"]): r["ic"] for r in ranks.expanding_spearman(df, 9, purge).collect()}
    for f in ("tied", "free"):
        for at in range(1 + purge, 10):
            past = [(x, y) for g, m, x, y in rows if g == f and m < at - purge]
            want = plain_ic(*zip(*past, strict=True)) if past else None
            assert got.get((f, at)) == (pytest.approx(want) if want is not None else None)


def test_expanding_ranks_of_more_rows_than_the_cube_root_of_a_long(spark):
    rows = spark.range(2_200_000).selectExpr("'f' AS feature", "cast(id % 2 AS int) AS number", "cast(id % 3 AS double) AS x", "cast(id % 3 + id % 2 AS double) AS y")
    got = {r["number"]: r for r in ranks.expanding_spearman(rows, 2).collect()}
    # the 2 x 3 cells of (parity, x) hold equal numbers of rows; y is x or x + 1, whose ranks go by 1/6, 2/6, 2/6 and 1/6
    x, y = np.array([0, 1, 2, 0, 1, 2]), np.array([0, 1, 2, 1, 2, 3])
    rank = lambda v: np.array([(v < k).sum() + ((v == k).sum() + 1) / 2 for k in v])
    assert got[2]["n"] == 2_200_000 and abs(got[2]["ic"] - np.corrcoef(rank(x), rank(y))[0, 1]) < 1e-5
    assert got[1]["ic"] == pytest.approx(1)


def test_quantiles_of_many_small_keys_take_no_pass(spark, monkeypatch):
    df = spark.range(3000).selectExpr("if(id % 50 = 0, null, id % 50) AS k", "if(id % 7 = 0, null, cast(id * 37 % 101 AS double)) AS v")
    got = ranks.quantiles(df, ["k"], "v", [0.0, 0.37, 0.9])
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    found = lambda d: {(r["k"], r["q"]): r["v"] for r in d.collect()}
    want = {}
    for k, v in df.filter("v IS NOT NULL").toPandas().assign(k=lambda f: f["k"].fillna(-1)).groupby("k")["v"]:
        want |= {(None if k < 0 else int(k), q): np.quantile(v, q) for q in (0.0, 0.37, 0.9)}
    assert found(got) == pytest.approx(want)
    for few in (0, 55):  # by bins: all keys, and no key less than the largest
        monkeypatch.setattr(ranks, "FEW", few)
        assert found(ranks.quantiles(df, ["k"], "v", [0.0, 0.37, 0.9])) == pytest.approx(want)
