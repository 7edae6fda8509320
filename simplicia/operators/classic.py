"""Classical features of series, from arrays (one series a row) or windows; all but SSA in expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from simplicia.functions import series as kernels
from simplicia.functions.scalars import total
from simplicia.operators.neighbours import nearest
from simplicia.sources.store import stored


def moments(df: DataFrame, key: str, value: str) -> DataFrame:
    """mean, sd (population), skew and excess kurtosis with the sd guarded by 1e-9."""
    w = Window.partitionBy(key)
    d = df.select(key, F.col(value).alias("x"), (F.col(value) - F.avg(value).over(w)).alias("c"))
    sd = F.stddev_pop("x") + 1e-9
    return d.groupBy(key).agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"),
        (F.avg(F.col("c") * F.col("c") * F.col("c")) / F.pow(sd, 3)).alias("skew"), (F.avg(F.pow("c", F.lit(4))) / F.pow(sd, 4) - 3).alias("kurtosis"),
    )


def difference_moments(series: DataFrame, key: str, value: str) -> DataFrame:
    d = F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy("i"))
    return series.select(key, d.alias("d")).groupBy(key).agg(F.avg("d").alias("diff_mean"), F.stddev_pop("d").alias("diff_sd"))


def periodogram(arrays: DataFrame, x: str = "x") -> DataFrame:
    """Adds power: squared modulus of the Fourier sums at frequencies 0..n/2 of the centred series."""
    return arrays.withColumn("power", kernels.each(kernels.power, lambda n: [None] * (n // 2 + 1), "array<double>", pa.list_(pa.float64()))(F.col(x)))


def spectrum_features(spectra: DataFrame, key: str) -> DataFrame:
    """peak over median and period of the peak (without the constant), dominant frequency, largest share and the
    shares of three equal bands (the rest of the division is dropped)."""
    tail = F.expr("slice(power, 2, size(power) - 1)")
    df = spectra.filter(F.col("n") >= 4).withColumns({"tail": tail, "all": total(F.col("power")) + 1e-9})
    ordered = F.sort_array("tail")
    m = F.size("tail")
    median = (F.get(ordered, F.floor((m - 1) / 2).cast("int")) + F.get(ordered, F.floor(m / 2).cast("int"))) / 2
    band = F.floor(F.size("power") / 3).cast("int")
    share = lambda k: total(F.slice("power", band * k + 1, band)) / F.col("all")
    at = F.array_position("tail", F.array_max("tail"))
    return df.select(
        key, (F.array_max("tail") / (median + 1e-12)).alias("peak"), (F.col("n") / at).alias("period"),
        ((F.array_position("power", F.array_max("power")) - 1) / F.col("n")).alias("dominant"), (F.array_max("power") / F.col("all")).alias("top_share"),
        *(share(k).alias(f"band_{k}") for k in range(3)),
    )


def sample_entropy(arrays: DataFrame, key: str, x: str = "x", m: int = 2, factor: float = 0.2, min_len: int = 50) -> DataFrame:
    """-log of the share of matching templates of m + 1 among those of m, self-matches left out; 0 for short or
    constant series and where a share is 0."""
    found = kernels.each(lambda v: kernels.entropy(v, m, factor, min_len), lambda n: 0.0, "double", pa.float64())
    return arrays.select(key, found(F.col(x)).alias("sample_entropy"))


def hurst(series: DataFrame, key: str, value: str = "x", sizes: tuple[int, ...] = (8, 16, 32, 64, 128)) -> DataFrame:
    """Slope of log(R/S) on log(block size) over whole, non-overlapping blocks; 0.5 where fewer than two sizes fit."""
    n = F.count("*").over(Window.partitionBy(key))
    rows = series.select(key, "i", F.col(value).alias("x"), n.alias("n")).select("*", F.explode(F.array(*map(F.lit, sizes))).alias("s"))
    rows = rows.filter((F.col("s") <= F.floor(F.col("n") / 2)) & (F.col("n") >= 32)).withColumn("block", F.floor(F.col("i") / F.col("s")))
    rows = rows.filter((F.col("block") + 1) * F.col("s") <= F.col("n"))
    w = Window.partitionBy(key, "s", "block")
    centred = rows.withColumn("c", F.col("x") - F.avg("x").over(w))
    walked = centred.withColumn("y", F.sum("c").over(w.orderBy("i")))
    blocks = walked.groupBy(key, "s", "block").agg((F.max("y") - F.min("y")).alias("r"), F.stddev_pop("x").alias("sd"))
    by_size = blocks.filter(F.col("sd") > 1e-12).groupBy(key, "s").agg(F.avg(F.col("r") / F.col("sd")).alias("rs"))
    fit = by_size.groupBy(key).agg(F.count("*").alias("k"), F.regr_slope(F.ln(F.greatest("rs", F.lit(1e-9))), F.ln("s")).alias("slope"))
    return series.select(key).distinct().join(fit, key, "left").select(key, F.when(F.col("k") >= 2, F.col("slope")).otherwise(0.5).alias("hurst"))


def false_neighbours(cloud: DataFrame, key: str, coordinates: list[str], extra: str, tolerance: float = 10.0, least: int = 20) -> DataFrame:
    """Share of points whose nearest other point is a false neighbour: far apart in the coordinate that the next
    dimension adds. cloud: key, i, the coordinates and that one."""
    near = nearest(cloud, key, "i", coordinates, 1)
    a, b = cloud.select(key, "i", F.col(extra).alias("ea")), cloud.select(key, F.col("i").alias("j"), F.col(extra).alias("eb"))
    joined = near.join(a.hint("merge"), [key, "i"]).join(b.hint("merge"), [key, "j"])  # a stored cloud is small as a file only
    ratio = F.sqrt(F.col("d") * F.col("d") + F.pow(F.col("ea") - F.col("eb"), 2)) / (F.col("d") + 1e-12)
    got = joined.groupBy(key).agg(F.avg((ratio > tolerance).cast("int")).alias("fnn"), F.count("*").alias("n"))
    return got.select(key, F.when(F.col("n") >= least, F.col("fnn")).alias("fnn"))


def neighbour_r2(cloud: DataFrame, coordinates: list[str], targets: DataFrame, key: str, k: int = 5, exclude: int = 3, least: int = 30) -> DataFrame:
    """R2 of predicting a target by the mean target of the k nearest points, those within `exclude` steps left out,
    among the k + exclude + 1 nearest; null for short series or constant targets. cloud: key, i and the coordinates;
    targets: key, i, target. Points without a target don't count as neighbours."""
    w = Window.partitionBy(key, "i").orderBy("r")
    targets = stored(targets, "targets")
    t = targets.select(key, F.col("i").alias("j"), F.col("target").alias("tj")).hint("merge")  # small as a file only
    known = stored(cloud.join(targets.select(key, "i").hint("merge"), [key, "i"]), "known")
    near = nearest(known, key, "i", coordinates, k + exclude + 1).withColumnRenamed("rank", "r").join(t, [key, "j"])
    near = stored(near, "nearest")
    far = near.filter(F.abs(F.col("i") - F.col("j")) > exclude).withColumn("q", F.row_number().over(w)).filter(F.col("q") <= k)
    guess = far.groupBy(key, "i").agg(F.avg("tj").alias("guess"))
    first = near.filter("r = 1").select(key, "i", F.col("tj").alias("first"))
    done = targets.join(guess.hint("merge"), [key, "i"], "left").join(first.hint("merge"), [key, "i"], "left").withColumn("e", F.col("target") - F.coalesce("guess", "first"))
    got = done.groupBy(key).agg(F.avg(F.col("e") * F.col("e")).alias("res"), F.var_pop("target").alias("var"), F.count("*").alias("n"))
    return got.select(key, F.when((F.col("n") >= least) & (F.col("var") > 1e-12), 1 - F.col("res") / F.col("var")).alias("r2"))


def ssa_share(arrays: DataFrame, key: str, x: str = "x") -> DataFrame:
    """Share of the first singular-spectrum eigenvalue of the standardised series (kernel)."""
    kind = dict(arrays.dtypes)[key]

    def run(frames):
        import numpy as np

        from simplicia.functions.kernels import ssa_first_share

        for f in frames:
            out = []
            for v in f[x]:
                a = np.asarray(v, float)
                sd = a.std() if len(a) else 0.0
                out.append(ssa_first_share((a - a.mean()) / sd) if sd > 1e-12 else 0.0)
            yield f[[key]].assign(ssa=out)

    return arrays.select(key, x).mapInPandas(run, f"{key} {kind}, ssa double")
