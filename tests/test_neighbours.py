"""Neighbours and spanning trees by grid cells against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from simplicia.functions.kernels import distances, rips
from simplicia.operators import neighbours


def clouds(kind, d):
    rng = np.random.default_rng(d)
    even = rng.random((60, d))
    return {
        "even": even, "copies": np.concatenate([np.repeat(even[:1], 40, axis=0), even]), "grid": rng.integers(0, 3, (70, d)).astype(float),
        "far": np.concatenate([even[:30], even[:30] * 1e-4 + 50, [[1e3] * d]]), "line": np.outer(np.arange(40.0), np.ones(d)), "few": even[:3], "one": even[:1], "same": np.ones((5, d)),
    }[kind]


KINDS = ["even", "copies", "grid", "far", "line", "few", "one", "same"]


def frame(spark, d):
    rows = [(k, i, *map(float, p)) for k in KINDS for i, p in enumerate(clouds(k, d))]
    return spark.createDataFrame(rows, "k string, i int, " + ", ".join(f"x{c} double" for c in range(d)))


@pytest.mark.parametrize("d, k", [(1, 2), (3, 5), (5, 3)])
def test_nearest(spark, d, k):
    got = {}
    for r in neighbours.nearest(frame(spark, d), "k", "i", [f"x{c}" for c in range(d)], k).collect():
        got.setdefault((r["k"], r["i"]), []).append((r["rank"], r["j"], r["d"]))
    for kind in KINDS:
        p = clouds(kind, d)
        for i in range(len(p)):
            want = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(p[i], q, strict=True))), j) for j, q in enumerate(p) if j != i)[:k]
            mine = sorted(got.get((kind, i), []))
            assert [r for r, _, _ in mine] == list(range(1, len(want) + 1))
            assert [x for _, _, x in mine] == pytest.approx([x for x, _ in want])
            if kind in ("grid", "copies", "same"):  # exact ties
                assert [j for _, j, _ in mine] == [j for _, j in want]


@pytest.mark.parametrize("d", [1, 3])
def test_spanning_tree(spark, d):
    edges = neighbours.spanning_edges(frame(spark, d), "k", "i", [f"x{c}" for c in range(d)]).collect()
    for kind in KINDS:
        p = clouds(kind, d)
        found = rips(distances(p), 0)[0]
        want = sorted(x for x in found[:, 1] if 0 < x < np.inf) if len(p) > 1 else []
        assert sorted(r["d"] for r in edges if r["k"] == kind) == pytest.approx(want)


def test_no_clouds(spark):
    empty = frame(spark, 3).filter("false")
    assert neighbours.nearest(empty, "k", "i", ["x0", "x1", "x2"], 2).count() == 0 and neighbours.spanning_edges(empty, "k", "i", ["x0", "x1", "x2"]).count() == 0


def test_cells_of_one_cloud_are_many_keys(spark):
    """The joins are dealt by cell: one cloud isn't one key."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([("a", i, *map(float, p)) for i, p in enumerate(rng.random((3000, 3)))], "k string, i int, x0 double, x1 double, x2 double")
    near = neighbours.nearest(df, "k", "i", ["x0", "x1", "x2"], 4)
    assert near.count() == 12_000 and near.groupBy("i").count().filter("count <> 4").isEmpty()
    assert near.filter(F.col("rank") == 1).agg(F.max("d")).collect()[0][0] < 0.3


@pytest.mark.parametrize("most", [0, 50])
def test_kernel_and_grid_agree(spark, monkeypatch, most):
    """All clouds through the grid, and those of up to 50 points through the kernel, against all through the kernel."""
    c, df = ["x0", "x1", "x2"], frame(spark, 3)
    near = lambda: sorted((r["k"], r["i"], r["rank"], r["j"], round(r["d"], 9)) for r in neighbours.nearest(df, "k", "i", c, 4).collect())
    tree = lambda: sorted((r["k"], round(r["d"], 9)) for r in neighbours.spanning_edges(df, "k", "i", c).collect())
    want = near(), tree()
    monkeypatch.setattr(neighbours, "SMALL", most)
    assert (near(), tree()) == want


def test_no_broadcast_of_what_grows(spark):
    """Small clouds are neither joined nor broadcast; the grid's joins sort."""
    c, df = ["x0", "x1", "x2"], frame(spark, 3)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan(neighbours.nearest(df, "k", "i", c, 4)) and "Join" not in plan(neighbours.spanning_edges(df, "k", "i", c))
    assert "BroadcastHashJoin" not in plan(neighbours.nearest_by_cells(df, "k", "i", c, 4))


def test_points_without_a_coordinate_are_left_out(spark):
    df = spark.createDataFrame([(1, 5, 0.0), (1, 6, None), (1, 7, 2.0), (None, 8, 1.0)], "k int, i int, x0 double")
    assert [tuple(r) for r in neighbours.nearest(df, "k", "i", ["x0"], 2).orderBy("i").collect()] == [(1, 5, 7, 2.0, 1), (1, 7, 5, 2.0, 1)]
