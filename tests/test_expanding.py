"""F10 to F13: expanding rank correlations without rows that carry an array of months, and scores without a shuffle of the panel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from simplicia.operators import evaluate, ranks


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def correlation(pairs):
    x, y = (np.array(v) for v in zip(*pairs, strict=True))
    rank = lambda v: np.array([(v < k).sum() + ((v == k).sum() + 1) / 2 for k in v])
    a, b = rank(x), rank(y)
    return None if len(x) < 10 else 0.0 if a.std() < 1e-12 or b.std() < 1e-12 else np.corrcoef(a, b)[0, 1]


def test_rows_are_dealt_without_their_months(spark, monkeypatch):
    """Blocks of few rows, so that one value of y fills several of them, with its rows in blocks before and after."""
    monkeypatch.setattr(ranks, "BLOCK", 12)
    rng = np.random.default_rng(8)
    rows = [(f, int(m), float(rng.integers(0, 9)), 5.0 if rng.random() < 0.5 else float(rng.integers(0, 12))) for f in ("a", "b") for m in range(6) if (f, m) != ("b", 2) for _ in range(30)]
    rows += [("flat", m, float(k), -0.0 if k % 2 else 0.0) for m in range(6) for k in range(9)]
    out = ranks.expanding_spearman(spark.createDataFrame(rows, "feature string, number int, x double, y double"), 6, 1)
    assert "arrays_zip" not in plan(out) and "Generate" not in plan(out)
    got = {(r["feature"], r["number"]): r["ic"] for r in out.collect()}
    for f in ("a", "b", "flat"):
        for at in range(2, 8):
            want = correlation([(x, y) for g, m, x, y in rows if g == f and m < at - 1])
            assert got.get((f, at)) == (pytest.approx(want, abs=1e-9) if want is not None else None)


def test_scores_shuffle_no_panel(spark):
    panel = spark.createDataFrame([("m1", 1, 1.0, 2.0, 0.5), ("m1", 2, None, 3.0, 0.1), ("m1", 3, None, None, 0.2), ("m2", 1, 1.0, 1.0, 0.3), ("m3", 1, 1.0, 1.0, 0.3)], "month string, id int, a double, b double, y double")
    chosen = spark.createDataFrame([(1, "m1", "a", 0.5), (2, "m1", "a", 0.5), (2, "m1", "b", -1.0), (1, "m2", "a", 0.0)], "k int, month string, feature string, ic double")
    out = evaluate.factor_scores(panel, chosen, "id", ["a", "b"], "y", ["k"])
    assert "Generate" not in plan(out) and "Aggregate" not in plan(out)
    got = {(r["k"], r["month"], r["id"]): r["score"] for r in out.collect()}
    assert got == {(1, "m1", 1): 0.5, (1, "m1", 2): None, (1, "m1", 3): None, (2, "m1", 1): -1.5, (2, "m1", 2): -3.0, (2, "m1", 3): None}
    assert out.filter(F.col("y").isNull()).count() == 0
