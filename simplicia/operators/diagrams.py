"""Diagrams as tables: selection, criteria and vectors by joins, windows and aggregates; distances by kernel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from simplicia.functions.scalars import linspace, soft_mask, total
from simplicia.operators.homology import certain
from simplicia.operators.ranks import column_quantiles


def with_persistence(dgm: DataFrame) -> DataFrame:
    return dgm.withColumn("p", F.col("death") - F.col("birth"))


def top_k(dgm: DataFrame, key: str, k: int) -> DataFrame:
    """key, rank 1..k and persistence, longest first, zero padded."""
    best = with_persistence(dgm).groupBy(key).agg(F.sort_array(F.collect_list("p"), asc=False).alias("p"))
    padded = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda r: F.struct(r.alias("rank"), F.coalesce(F.get("p", r - 1), F.lit(0.0)).alias("persistence")))
    return best.select(key, F.explode(padded).alias("b")).select(key, "b.*")


def summary(dgm: DataFrame, key: str) -> DataFrame:
    """Scalar criteria of every diagram: n_bars, max_pers, mean_pers, sum of the three longest, ring counts above 0.1,
    0.3 and 0.5 of the longest, longest over mean, entropy in nats."""
    w = Window.partitionBy(key)
    p = with_persistence(dgm)
    p = p.withColumns({"top": F.max("p").over(w), "all": F.sum("p").over(w), "rank": F.row_number().over(w.orderBy(F.desc("p")))})
    share = F.try_divide("p", "all")
    ring = lambda r: F.count_if((F.col("p") > r * F.col("top")) & (F.col("top") > 0))
    return p.groupBy(key).agg(
        F.count("*").alias("n_bars"),
        F.max("p").alias("max_pers"),
        F.avg("p").alias("mean_pers"),
        F.sum(F.when(F.col("rank") <= 3, F.col("p")).otherwise(0.0)).alias("top3_pers"),
        ring(0.1).alias("ring_01"),
        ring(0.3).alias("ring_03"),
        ring(0.5).alias("ring_05"),
        F.when(F.avg("p") > 0, F.max("p") / F.avg("p")).otherwise(0.0).alias("top1_over_mean"),
        F.coalesce(-F.sum(F.when(F.col("p") > 0, share * F.ln(share))), F.lit(0.0)).alias("entropy"),
    )


def count_above(dgm: DataFrame, key: str, scale: float) -> DataFrame:
    return with_persistence(dgm).groupBy(key).agg(F.count_if(F.col("p") > scale).alias("n_above"))


def own_grid(dgm: DataFrame, key: str, bins: int, margin: float = 0.1, births_only: bool = False) -> DataFrame:
    """key, b, t: a grid of its own for each diagram, from max(0, least - margin) to greatest + margin. births_only:
    the least is taken over the births alone, as landscapes do."""
    low = F.min("birth") if births_only else F.min(F.least("birth", "death"))
    lo, hi = F.greatest(F.lit(0.0), low - margin), F.max(F.greatest("birth", "death")) + margin
    return dgm.groupBy(key).agg(lo.alias("lo"), hi.alias("hi")).select(key, F.posexplode(linspace(F.col("lo"), F.col("hi"), bins)).alias("b", "t"))


def fixed_range(dgm: DataFrame, q: float = 0.995) -> DataFrame:
    """One row: the shared range (lo, hi) of all diagrams, robust against a few long bars. dgm is read several times: a stored
    one is cheaper."""
    low = dgm.agg(F.min(F.least("birth", "death")).alias("lo"))
    ends = column_quantiles(dgm, ["birth", "death"], q)
    return ends.join(F.broadcast(low)).select("lo", F.greatest("birth", "death", F.col("lo") + 1e-6).alias("hi"))


def fixed_grid(dgm: DataFrame, key: str, bins: int, lo: float, hi: float) -> DataFrame:
    return dgm.select(key).distinct().select(key, F.posexplode(linspace(F.lit(lo), F.lit(hi), bins)).alias("b", "t"))


def betti_curve(dgm: DataFrame, key: str, grid: DataFrame) -> DataFrame:
    """key, b, t, betti: bars alive at the points of a grid."""
    alive = (F.col("birth") <= F.col("t")) & (F.col("t") < F.col("death"))
    return grid.join(dgm.select(key, "birth", "death"), key, "left").groupBy(key, "b", "t").agg(F.count_if(alive).alias("betti"))


def landscape(dgm: DataFrame, key: str, grid: DataFrame, levels: int) -> DataFrame:
    """key, b, t, level, value: the level-th highest tent over each grid point, zeros below."""
    half = (F.col("death") - F.col("birth")) / 2
    tent = F.greatest(F.lit(0.0), half - F.abs(F.col("t") - (F.col("birth") + F.col("death")) / 2))
    heights = grid.join(dgm.select(key, "birth", "death"), key, "left").groupBy(key, "b", "t").agg(F.slice(F.sort_array(F.collect_list(tent), asc=False), 1, levels).alias("h"))
    return heights.select(key, "b", "t", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.coalesce(F.get("h", k), F.lit(0.0)))).alias("level", "value"))


def fixed_vectors(dgm: DataFrame, key: str, lo: float, hi: float, bins: int = 24, levels: int = 4) -> DataFrame:
    """key and vector of bins * (1 + levels) + 8 numbers: Betti curve, landscape levels, eight scalars."""
    grid = fixed_grid(dgm, key, bins, lo, hi)
    in_order = lambda df, by, v: df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(*by, F.col(v).cast("double").alias("v")))), lambda x: x["v"]).alias(v))
    curve = in_order(betti_curve(dgm, key, grid), ["b"], "betti")
    tents = in_order(landscape(dgm, key, grid, levels), ["level", "b"], "value")
    s = summary(dgm, key)
    scalars = F.array(*(F.col(c).cast("double") for c in ("ring_01", "ring_03", "ring_05", "max_pers", "top3_pers", "top1_over_mean", "entropy", "n_bars")))
    return curve.join(tents, key).join(s.select(key, scalars.alias("scalars")), key).select(key, F.concat("betti", "value", "scalars").alias("vector"))


def vectors(dgm: DataFrame, key: str, method: str, bins: int = 20, levels: int = 3, k: int = 5) -> DataFrame:
    """key, pos, v: a diagram as a vector by the name of the method (top_k, betti or landscape, the last two on a grid
    of the diagram's own). An unknown name raises."""
    if method == "top_k":
        return top_k(dgm, key, k).select(key, (F.col("rank") - 1).cast("long").alias("pos"), F.col("persistence").alias("v"))
    if method == "betti":
        return betti_curve(dgm, key, own_grid(dgm, key, bins)).select(key, F.col("b").cast("long").alias("pos"), F.col("betti").cast("double").alias("v"))
    if method == "landscape":
        tents = landscape(dgm, key, own_grid(dgm, key, bins, births_only=True), levels)
        return tents.select(key, (F.col("level") * bins + F.col("b")).cast("long").alias("pos"), F.col("value").alias("v"))
    raise ValueError(f"no such vectorisation: {method}")


def _above(threshold: Column, eta: float) -> dict[str, Column]:
    """Whether a bar is above a threshold: topo by a logistic mask above a half, hard by persistence, stat by the distance to
    the diagonal."""
    p = F.col("death") - F.col("birth")
    return {"topo": soft_mask(p, threshold, eta) > 0.5, "hard": p > threshold, "stat": p / F.sqrt(F.lit(2.0)) > threshold}


def significant(dgm: DataFrame, threshold: float, method: str = "hard", eta: float = 50.0) -> DataFrame:
    """Bars above a threshold by one method (topo, hard or stat)."""
    return dgm.filter(_above(F.lit(threshold), eta)[method])


def selections(dgm: DataFrame, thresholds: list[float], methods: tuple[str, ...] = ("topo", "hard", "stat"), eta: float = 50.0) -> DataFrame:
    """The bars that each method leaves at each threshold, with columns method and threshold, in one pass over the bars."""
    t = dgm.withColumn("threshold", F.explode(F.array(*map(F.lit, map(float, thresholds)))))
    rules = _above(F.col("threshold"), eta)
    kept = F.array(*(F.when(rules[m], F.lit(m)) for m in methods))
    return t.withColumn("method", F.explode(F.filter(kept, lambda m: m.isNotNull())))


def tail_counts(dgm: DataFrame, key: str, steps: int = 5) -> DataFrame:
    """Bars longer than each of `steps` levels from 0.1 to 0.9 of the longest."""
    p = with_persistence(dgm).withColumn("top", F.max("p").over(Window.partitionBy(key)))
    levels = linspace(0.1 * F.col("top"), 0.9 * F.col("top"), steps)
    return p.select(key, "p", F.posexplode(levels).alias("step", "t")).groupBy(key, "step").agg(F.count_if(F.col("p") > F.col("t")).alias("n_longer"))


def longest_ratios(dgm: DataFrame, key: str, k: int = 3) -> DataFrame:
    """The k longest persistences over the longest."""
    top = top_k(dgm, key, k)
    return top.withColumn("ratio", F.col("persistence") / (F.max("persistence").over(Window.partitionBy(key)) + 1e-9))


def separability(scores: DataFrame, cls: str, *criteria: str) -> DataFrame:
    """criterion, class_a, class_b and |mean difference| over the mean of the standard deviations (population)."""
    long = scores.select(cls, F.explode(F.array(*(F.struct(F.lit(c).alias("criterion"), F.col(c).cast("double").alias("v")) for c in criteria))).alias("e")).select(cls, "e.*")
    s = long.groupBy("criterion", cls).agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    a, b = s.alias("a"), s.alias("b")
    got = a.join(b, (F.col("a.criterion") == F.col("b.criterion")) & (F.col(f"a.{cls}") < F.col(f"b.{cls}")))
    value = F.abs(F.col("a.mu") - F.col("b.mu")) / ((F.col("a.sd") + F.col("b.sd")) / 2 + 1e-9)
    return got.select("a.criterion", F.col(f"a.{cls}").alias("class_a"), F.col(f"b.{cls}").alias("class_b"), value.alias("separability"))


def distance_pairs(pairs: DataFrame, keys: list[str], a: str = "bars_a", b: str = "bars_b", order: float = 1.0) -> DataFrame:
    """keys, wasserstein and bottleneck of two columns of bars (arrays of birth, death)."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*keys).schema.fields), "wasserstein double", "bottleneck double"])

    def run(frames):
        import numpy as np

        from simplicia.functions.kernels import bottleneck, wasserstein

        as_array = lambda x: np.array([(r["birth"], r["death"]) for r in x]).reshape(-1, 2) if x is not None else np.zeros((0, 2))
        for f in frames:
            x, y = [as_array(v) for v in f[a]], [as_array(v) for v in f[b]]
            yield f[keys].assign(wasserstein=[wasserstein(p, q, order) for p, q in zip(x, y, strict=True)], bottleneck=[bottleneck(p, q) for p, q in zip(x, y, strict=True)])

    return pairs.select(*keys, a, b).mapInPandas(run, schema)


def images(persisted: DataFrame, key: str, dim: int, birth_range: tuple[float, float], pers_range: tuple[float, float], resolution: int = 20, sigma: float | None = None) -> DataFrame:
    """key and image, the flattened persistence image of one dimension. A cloud without diagram raises (`homology.certain`)."""
    kind = dict(persisted.dtypes)[key]

    def run(frames):
        import numpy as np

        from simplicia.functions.kernels import persistence_image

        for f in frames:
            of = lambda bars: np.array([(x["birth"], x["death"]) for x in bars if x["dim"] == dim]).reshape(-1, 2)
            yield f[[key]].assign(image=[persistence_image(of(b), birth_range, pers_range, resolution, sigma).ravel().tolist() for b in f["bars"]])

    return certain(persisted, key).mapInPandas(run, f"{key} {kind}, image array<double>")


def vector_sum(v: Column) -> Column:
    return total(v)
