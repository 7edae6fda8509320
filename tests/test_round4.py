"""Series, ranks and panels at size: kernels against plain code, plans that repeat no row, memory of a task that stays."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from simplicia.functions import series as kernels
from simplicia.operators import classic, embedding

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def series(spark, many):
    return spark.createDataFrame([(k, i, None if v is None else float(v)) for k, x in many.items() for i, v in enumerate(x)], "user_id long, i long, x double")


def arrays(spark, many):
    return spark.createDataFrame([(k, len(x), [None if v is None else float(v) for v in x]) for k, x in many.items()], "user_id long, n int, x array<double>")


def drawn():
    rng = np.random.default_rng(4)
    return {k: rng.normal(size=n).round(1).tolist() for k, n in enumerate([1, 2, 5, 6, 7, 30, 51, 64, 90])} | {20: [3.0] * 60, 21: [1.0, None] * 30, 22: [1.0, 2.0, float("nan")] * 20, 23: np.sin(np.arange(80) / 5).tolist()}


def test_tau_autocorrelation_against_plain_code(spark):
    many = drawn()
    df = embedding.tau_autocorrelation(arrays(spark, many))
    assert "autocov" not in plan(df) and "transform(" not in plan(df)
    got = {r["user_id"]: r["tau_ac"] for r in df.collect()}
    for k, x in many.items():
        want = 1
        if None not in x and not any(map(math.isnan, x)):
            c = [v - sum(x) / len(x) for v in x]
            lags = [t for t in range(1, len(x) // 3) if sum(v * v for v in c) and sum(a * b for a, b in zip(c, c[t:])) <= 0]
            want = lags[0] if lags else 1
        assert got[k] == want


def test_sample_entropy_in_blocks_against_plain_code(spark, monkeypatch):
    many = drawn()
    got = {r[0]: r[1] for r in classic.sample_entropy(arrays(spark, many), "user_id").collect()}
    monkeypatch.setattr(kernels, "CELLS", 500)
    for k, x in many.items():
        want = 0.0
        if len(x) >= 50 and None not in x and not any(map(math.isnan, x)):
            r = 0.2 * np.std(x)
            share = lambda s: sum(all(abs(x[i + q] - x[j + q]) <= r for q in range(s)) for i in range(len(x) - s + 1) for j in range(len(x) - s + 1) if i != j) / ((len(x) - s + 1) * (len(x) - s))  # noqa: B023, E731
            a, b = (share(3), share(2)) if r > 0 else (0, 0)
            want = -math.log(a / b) if a and b else 0.0
            assert abs(kernels.entropy(np.array(x), 2, 0.2, 50) - want) < 1e-12
        assert abs(got[k] - want) < 1e-12


def test_spectrum_against_sums(spark):
    many = {k: x for k, x in drawn().items() if k not in (22,)}
    got = {r["user_id"]: r["power"] for r in classic.periodogram(arrays(spark, many)).collect()}
    for k, x in many.items():
        if None in x:
            assert got[k] == [None] * (len(x) // 2 + 1)
            continue
        n, c = len(x), np.array(x) - np.mean(x)
        want = [abs(sum(c[t] * np.exp(-2j * np.pi * f * t / n) for t in range(n))) ** 2 for f in range(n // 2 + 1)]
        assert np.allclose(got[k], want, atol=1e-9)


def test_tau_mutual_information_repeats_no_row_for_a_delay(spark, monkeypatch):
    df = series(spark, drawn())
    few = embedding.tau_mutual_information(series(spark, {k: x for k, x in drawn().items() if k not in (21, 22)}), "user_id")
    assert "Generate" not in plan(few) and "Join" not in plan(few)
    whole = {r[0]: r[1] for r in embedding.tau_mutual_information(df, "user_id").collect()}
    monkeypatch.setattr(embedding, "WHOLE", 0)
    assert whole == {r[0]: r[1] for r in embedding.tau_mutual_information(df, "user_id").collect()}
    assert 0 not in whole and len(whole) == len(drawn()) - 1


def test_rank_correlations_of_keys_by_kernel_and_by_ranges(spark, monkeypatch):
    from simplicia.operators import evaluate

    rng = np.random.default_rng(9)
    rows = [(k, f, float(a), float(b)) for k, n in enumerate([3, 12, 40, 90]) for f in ("a", None) for a, b in rng.integers(0, 8, (n, 2))]
    rows += [(7, "a", 1.0, float(i)) for i in range(20)] + [(8, "a", None, 1.0)] * 3 + [(9, "a", float("nan") if i % 3 else 1.0, float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, f string, x double, y double")
    run = lambda: {(r["k"], r["f"]): (r["n"], r["ic"]) for r in evaluate.spearman(df, ["k", "f"], "x", "y").collect()}
    whole = run()
    assert "Window" not in plan(evaluate.spearman(df, ["k", "f"], "x", "y")) and whole[7, "a"] == (20, 0.0) and whole[0, "a"] == (3, None)
    monkeypatch.setattr(evaluate, "WHOLE", 30)
    mixed = run()
    monkeypatch.setattr(evaluate, "WHOLE", 0)
    ranged = run()
    assert whole.keys() == mixed.keys() == ranged.keys() and (8, "a") not in whole
    for k, (n, ic) in whole.items():
        for other in (mixed[k], ranged[k]):
            assert other[0] == n and (other[1] is None) == (ic is None) and (ic is None or abs(ic - other[1]) < 1e-12)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_folds_of_the_report_rank_no_row_twice(spark, monkeypatch):
    from simplicia.operators import evaluate
    from simplicia.plans import composed

    asked = []
    whole = evaluate.spearman
    monkeypatch.setattr(evaluate, "spearman", lambda df, keys, *a, **k: asked.append(keys) or whole(df, keys, *a, **k))
    assert composed.ic_report(spark, SF).count() and asked == [["k"]]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_partitions_of_panels_grow_with_the_table(spark, monkeypatch):
    from simplicia.plans import panels
    from simplicia.sources import store

    monkeypatch.setattr(panels, "partitions", lambda s, n: store.partitions(s, n, 500))
    assert store.partitions(spark, 10**9) == 2000 and store.partitions(spark, 1) == 4
    assert panels.daily(spark, SF).rdd.getNumPartitions() >= 12
    assert panels.subsample_scan(spark, SF).count() > 0
    drawn = []
    monkeypatch.setattr(panels, "stored", lambda df, name: drawn.append(plan(df)) or store.stored(df, name))
    panels.subsample_scan(spark, SF)
    assert "AS ratio" not in drawn[0].split("row_number")[-1]  # no order for each ratio


def test_local_surface_counts_angles_as_histograms_do(spark):
    from simplicia.operators import shape

    rng = np.random.default_rng(3)
    clouds = {0: rng.normal(size=(40, 3)), 1: rng.integers(0, 3, (30, 3)).astype(float), 2: np.c_[np.linspace(-1, 1, 25), np.zeros((25, 2))], 3: rng.normal(size=(3, 3))}
    df = spark.createDataFrame([(k, p.tolist()) for k, p in clouds.items()], "user_id long, points array<array<double>>")
    assert not any("histogram" in c.co_names for c in _codes(shape.local_surface.__code__.co_consts))
    got = {r["user_id"]: r["vector"] for r in shape.local_surface(df, "user_id").collect()}
    for k, p in clouds.items():
        assert np.allclose(got[k], _surface(p), atol=1e-12)


def _codes(consts):
    for c in consts:
        if hasattr(c, "co_consts"):
            yield c
            yield from _codes(c.co_consts)


def _surface(p, k=20, bins=11):
    """local_surface with a histogram for each point."""
    n = len(p)
    if n < 4:
        return [0.0] * (3 * bins + 30)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    near = np.argsort(d, 1)[:, 1 : min(k, n - 1) + 1]
    groups = p[np.concatenate([np.arange(n)[:, None], near], 1)]
    centred = groups - groups.mean(1, keepdims=True)
    normals = np.linalg.eigh(np.einsum("nki,nkj->nij", centred, centred))[1][:, :, 0]
    normals *= np.where((normals * (p - p.mean(0))).sum(1, keepdims=True) < 0, -1, 1)
    step = p[near] - p[:, None]
    unit = step / np.maximum(np.linalg.norm(step, axis=2, keepdims=True), 1e-12)
    u = np.repeat(normals[:, None], near.shape[1], 1)
    v = np.cross(unit, u)
    w, other = np.cross(u, v), normals[near]
    angles = [(v * other).sum(2), (u * unit).sum(2), np.arctan2((w * other).sum(2), (u * other).sum(2)) / np.pi]
    simple = np.concatenate([np.stack([np.histogram(row, bins, (-1, 1))[0] for row in a]) / near.shape[1] for a in angles], 1)
    weight = 1 / np.maximum(np.take_along_axis(d, near, 1), 1e-9)
    full = simple + (weight[:, :, None] * simple[near]).sum(1) / weight.sum(1, keepdims=True)
    return np.concatenate([full.mean(0), *(np.histogram(normals[:, i], 10, (-1, 1), density=True)[0] for i in range(3))])


def test_models_against_the_rest_shuffle_no_prediction(spark):
    from simplicia.operators import learn

    rng = np.random.default_rng(2)
    rows = [(i, float(i % 3), [float(i % 3) + rng.normal() * 0.6, rng.normal()], i % 2) for i in range(240)]
    df = learn.prepared(spark.createDataFrame(rows, "id long, y double, x array<double>, fold int"), "x", "y").select("id", "vector", "label", "fold")
    out = learn.against_rest(df, learn.boosted(2), [0.0, 1.0, 2.0], "fold", 2, ["id"])
    assert "Repartition" not in plan(out) and "Aggregate" not in plan(out)
    got = out.select("id", "label", "prediction", learn.vector_to_array("probability").alias("p")).collect()
    assert len(got) == 240 == len({r["id"] for r in got}) and all(abs(sum(r["p"]) - 1) < 1e-9 and r["prediction"] == float(np.argmax(r["p"])) for r in got)
    assert sum(r["label"] == r["prediction"] for r in got) > 120
    vote = learn.soft_votes([out, out.withColumn("probability", learn.array_to_vector(F.array(F.lit(0.2), F.lit(0.2), F.lit(0.6))))], "id")
    assert "Generate" not in plan(vote)
    p = {r["id"]: r["p"] for r in got}
    assert all(r["prediction"] == float(np.argmax(np.array(p[r["id"]]) + [0.2, 0.2, 0.6])) for r in vote.collect())
