"""Rank correlations of permuted values: by tasks of whole keys and row by row."""

import pytest
from pyspark.sql import functions as F

from simplicia.operators import evaluate


@pytest.mark.parametrize("x", [None, "x"])
def test_whole_keys_and_rows_agree(spark, monkeypatch, x):
    cells = [(m, i, None if i % 17 == m else float(i * 37 % 11), float(i * 53 % 29), None if i % 19 == 2 else float(i * 7 % 13)) for m, n in ((0, 40), (1, 5), (2, 60), (3, 12)) for i in range(n)]
    df = spark.createDataFrame([*cells, (None, 1, 1.0, 1.0, 1.0)], "m int, id long, v double, y double, x double")
    found = lambda: {(r["seed"], r["m"]): r["ic"] for r in evaluate.permuted_ics(df, "m", "id", "v", "y", 30, x).collect()}
    moved = evaluate.permuted(df, "m", "id", "v", 30).join(df.drop("v"), ["m", "id"])
    value = "v" if x is None else "residual"
    moved = moved if x is None else evaluate.residual_1(moved, ["seed", "m"], "v", "x")
    want = {(r["seed"], r["m"]): r["ic"] for r in evaluate.spearman(moved, ["seed", "m"], value, "y").collect()}
    assert found() == pytest.approx(want) and len(want) >= 90
    monkeypatch.setattr(evaluate, "WHOLE", 30)  # two keys by rows
    assert found() == pytest.approx(want)


def test_rows_arent_repeated_for_each_seed(spark):
    """What is shuffled is a key's rows for every 25 seeds."""
    df = spark.range(1000).select((F.col("id") % 4).alias("m"), "id", F.col("id").cast("double").alias("v"), (F.col("id") * 7 % 31).cast("double").alias("y"))
    plan = evaluate.permuted_ics(df, "m", "id", "v", "y", 50)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
