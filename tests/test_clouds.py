"""Persistence and weighted filtrations of many clouds: the kernel runs once for each, and no pair of points is a row."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from simplicia.functions import kernels as K
from simplicia.operators import homology
from simplicia.plans import registry, shapes

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bars_by_dimension_run_the_kernel_once(spark):
    """h2_features ran it for the bars and again for the failures."""
    rows = [(1, np.random.default_rng(0).random((20, 3)).tolist()), (2, [[0.0], [float("nan")]]), (3, [[0.0], [2.0]]), (4, [[1.0]]), (5, [])]
    got = homology.persistence(spark.createDataFrame(rows, "user_id int, points array<array<double>>"), 2, keep=("user_id",))
    out = shapes.by_dimension(got)
    assert plan(out).count("MapInPandas") == 1
    found = {(r.user_id, r.dim): (r.n, r.longest, r.total, r.status) for r in out.collect()}
    assert found[2, None] == (None, None, None, "ValueError: not finite") and found[3, 0] == (1, 2.0, 2.0, "ok") and {k for k, _ in found} == {1, 2, 3}
    bars = K.rips(K.distances(rows[0][1]), 2)
    for dim, b in enumerate(bars):
        b = b[np.isfinite(b[:, 1])]
        assert not len(b) and (1, dim) not in found or found[1, dim][:2] == (len(b), pytest.approx((b[:, 1] - b[:, 0]).max(), abs=1e-6))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", [pytest.param("compare_filtrations", id="F4 compare_filtrations"), pytest.param("weighted_h1", id="F7 weighted_h1"), pytest.param("weighted_matrix", id="F8 weighted_matrix")])
def test_no_pair_of_points_is_a_row(spark, monkeypatch, name):
    def pairs(*_, **__):
        raise AssertionError("pairs of points as rows")

    monkeypatch.setattr(homology, "pairwise", pairs)
    monkeypatch.setattr(homology, "matrix_entries", pairs)
    assert registry.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("block", [512, 7])
def test_rows_of_the_weighted_matrix(spark, monkeypatch, block):
    """Whole clouds by a kernel and larger ones by blocks give what the table of pairs gave."""
    rng = np.random.default_rng(1)
    rows = [(k, i, *map(float, p)) for k, n in enumerate([1, 2, 4, 7, 8, 20]) for i, p in enumerate(rng.integers(0, 5, (n, 2)))] + [(2, 99, None, 1.0)]
    cloud = spark.createDataFrame(rows, "k int, i int, x double, y double")
    pairs = homology.pairwise(cloud.dropna(), "k", "i", ["x", "y"])
    entries = homology.matrix_entries(homology.weighted_edges(pairs, homology.dtm_weights(cloud, "k", "i", ["x", "y"]), "k"), "k")
    want = {(r.k, r.i): (r.n, r.total, r.most) for r in entries.groupBy("k", "i").agg(F.count("*").alias("n"), F.sum("d").alias("total"), F.max("d").alias("most")).collect()}
    monkeypatch.setattr(homology, "BLOCK", block)
    found = [(r.k, r.i, r.n, r.total, r.most) for r in homology.weighted_rows(cloud, "k", "i", ["x", "y"]).collect()]
    assert len(found) == len(want) == 41
    assert all((n, total, most) == pytest.approx(want[k, i], abs=1e-9) for k, i, n, total, most in found)


def test_weighted_filtrations_in_the_kernel(spark):
    """As from the table of pairs; both directions of a pair are one number, as the reduction would go round in circles otherwise."""
    rng = np.random.default_rng(2)
    for d in (K.distances(rng.random((n, 3)) * 300) for n in (2, 5, 40)):
        for w in (K.measure_weights(d), K.shape_weights(d)):
            m = K.weighted(d, w)
            assert (m == m.T).all() and not m.diagonal().any() and len(K.rips(m, 1)[0]) == len(d)
    with pytest.raises(ValueError, match="direction"):
        K.rips(np.array([[0, 1, 2], [1, 0, 3], [2, 3.5, 0]]), 1)


def test_loops_of_a_cloud_have_no_bound(spark):
    """beyond 780 points weighted_h1 gave a status without numbers."""
    a = np.random.default_rng(3).random((800, 2))
    got = homology.persistence(spark.createDataFrame([(1, a.tolist())], "user_id int, points array<array<double>>"), 1, keep=("user_id",), weights="measure")
    assert {(r.dim, r.status) for r in shapes.by_dimension(got).collect()} == {(0, "ok"), (1, "ok")}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_noise_runs_the_kernel_once_for_each_copy(spark, monkeypatch):
    """noise_robustness ran it for the clean and a noisy cloud of each of four distances."""
    from simplicia.plans import composed

    calls, plain = [], homology.persistence
    monkeypatch.setattr(homology, "persistence", lambda *a, **k: calls.append(1) or plain(*a, **k))
    out = composed.noise_robustness(spark, SF)
    assert len(calls) == 1 and plan(out).count("MapInPandas") == 1 and len(out.collect()) == 4


def test_groups_of_bars_are_matched_apart():
    """distances of diagrams by groups of bars against a whole matching."""
    rng = np.random.default_rng(5)
    for trial in range(60):
        a, b = (np.column_stack([x, x + rng.exponential(0.3, len(x)).round(1 + trial % 3)]) for x in (rng.random(int(n)) for n in rng.integers(0, 9, 2)))
        half = lambda x: (x[:, 1] - x[:, 0]) / 2
        for order in (1.0, 2.0):
            cost = np.zeros((len(a) + len(b),) * 2)
            cost[: len(a), : len(b)] = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
            cost[: len(a), len(b) :], cost[len(a) :, : len(b)] = half(a)[:, None] * np.sqrt(2), half(b)[None, :] * np.sqrt(2)
            assert K._wasserstein_plane(a, b, order) == pytest.approx(K.assignment(cost**order)[1] ** (1 / order), abs=1e-7)
