"""Series as arrays and point clouds: delay embedding, normalisation, cleaning, embedding parameters.

A series or a cloud is one row, so a kernel downstream needs no shuffle; a series is gathered once by its key and
bounded by its own length.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from simplicia.functions import series as kernels
from simplicia.functions.scalars import bin_of, dot, total
from simplicia.operators import ranks
from simplicia.sources.store import stored


def indexed(df: DataFrame, key: str, order: list[str], *values: str) -> DataFrame:
    """key, i (position from 0) and the values, in the given order, ties broken by its last column."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.select(key, (F.row_number().over(w) - 1).alias("i"), *values)


def as_arrays(df: DataFrame, key: str, order: list[str], *values: str) -> DataFrame:
    """One row for each series: key, n and an array for each value column, in order."""
    rows = F.sort_array(F.collect_list(F.struct(*order, *(F.col(v).alias(f"_{v}") for v in values))))
    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)  # a number that stays, as what follows costs more than bytes tell
    got = dealt.groupBy(key).agg(rows.alias("rows"))
    return got.select(key, F.size("rows").alias("n"), *(F.col(f"rows._{v}").alias(v) for v in values))


def takens(series: DataFrame, key: str, value: str, m: int = 3, tau: int = 1) -> DataFrame:
    """Delay embedding of an indexed series: key, i and x0..x(m-1), the value at i and its m - 1 successors tau
    apart; positions without all of them have no point."""
    w = Window.partitionBy(key).orderBy("i")
    lagged = series.select(key, "i", *(F.lead(value, k * tau).over(w).alias(f"x{k}") for k in range(m)), F.lead("i", (m - 1) * tau).over(w).alias("_last"))
    return lagged.filter(F.col("_last").isNotNull()).drop("_last")


def takens_points(x: Column, m: int, tau: int) -> Column:
    """Delay embedding of an array: an array of points."""
    n = F.size(x) - (m - 1) * tau
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array(*(F.get(x, i - 1 + k * tau) for k in range(m))))).otherwise(F.array().cast("array<array<double>>"))


def standardized(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Each column as (x - mean) / population sd within its key; a sd of 0 counts as 1."""
    w = Window.partitionBy(key)
    sd = lambda c: F.stddev_pop(c).over(w)
    return df.withColumns({c: (F.col(c) - F.avg(c).over(w)) / F.when(sd(c) > 0, sd(c)).otherwise(1.0) for c in columns})


def multichannel(series: DataFrame, key: str, channels: list[str], m: int = 3, tau: int = 1) -> DataFrame:
    """Joint embedding of an indexed table of channels: the embeddings side by side, every coordinate standardised
    within its series; columns <channel>_<lag>."""
    w = Window.partitionBy(key).orderBy("i")
    names = [f"{c}_{k}" for c in channels for k in range(m)]
    lagged = series.select(key, "i", *(F.lead(c, k * tau).over(w).alias(f"{c}_{k}") for c in channels for k in range(m)), F.lead("i", (m - 1) * tau).over(w).alias("_last"))
    return standardized(lagged.filter(F.col("_last").isNotNull()).drop("_last"), key, *names)


def cleaned(cloud: DataFrame, key: str, *coordinates: str) -> DataFrame:
    """Points without missing, NaN or infinite coordinates, repeated points once."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in coordinates]
    keep = finite[0]
    for f in finite[1:]:
        keep = keep & f
    return cloud.filter(keep).select(key, *coordinates).dropDuplicates()


def unit_sphere(cloud: DataFrame, key: str, *coordinates: str) -> DataFrame:
    """Centred clouds scaled to a largest radius of 1; a cloud of one place stays at 0."""
    w = Window.partitionBy(key)
    centred = cloud.withColumns({c: F.col(c) - F.avg(c).over(w) for c in coordinates})
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in coordinates[1:]), start=F.col(coordinates[0]) * F.col(coordinates[0])))
    scaled = centred.withColumn("_r", F.max(norm).over(w))
    return scaled.withColumns({c: F.when(F.col("_r") > 0, F.col(c) / F.col("_r")).otherwise(F.col(c)) for c in coordinates}).drop("_r")


def per_channel_unit(df: DataFrame, key: str, *coordinates: str) -> DataFrame:
    """Every coordinate as a z-score, then all scaled by the largest radius: a cloud inside the unit sphere whose
    channels weigh alike."""
    return unit_sphere(standardized(df, key, *coordinates), key, *coordinates)


def cloud_status(cloud: DataFrame, key: str, *coordinates: str, least: int = 3) -> DataFrame:
    """key, n_points (distinct, finite) and status of every cloud: ok, or too few points."""
    n = cleaned(cloud, key, *coordinates).groupBy(key).agg(F.count("*").alias("n_points"))
    counts = cloud.select(key).distinct().join(n, key, "left").withColumn("n_points", F.coalesce("n_points", F.lit(0)))
    return counts.withColumn("status", F.when(F.col("n_points") >= least, "ok").otherwise("too few points"))


def min_max(df: DataFrame, key: str, column: str) -> DataFrame:
    w = Window.partitionBy(key)
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    return df.withColumn(column, (F.col(column) - lo) / (hi - lo + 1e-9))


def autocorrelations(x: Column, lags: Column) -> Column:
    """Autocovariances at lags 1..lags over that at 0, from an array; null for a constant series."""
    mean = F.try_divide(total(x), F.size(x).cast("double"))
    c = F.transform(x, lambda v: v - mean)
    n = F.size(x)
    return F.transform(F.sequence(F.lit(1), lags), lambda k: F.try_divide(dot(F.slice(c, F.lit(1), n - k), F.slice(c, k + 1, n - k)), dot(c, c)))


def tau_autocorrelation(arrays: DataFrame, x: str = "x") -> DataFrame:
    """Adds tau_ac: the first lag below a third of the length with an autocorrelation not above 0, else 1 (so for a
    constant series, and one with a null)."""
    first = kernels.each(kernels.first_zero, lambda n: 1, "bigint", pa.int64())
    return arrays.withColumn("tau_ac", first(F.col(x)))


def mutual_information(pairs: DataFrame, key: list[str], bins: int = 20) -> DataFrame:
    """Mutual information in bits of the columns a and b by equal-width bins, for each key."""
    w = Window.partitionBy(*key)
    binned = pairs.select(*key, *(bin_of(F.col(c), F.min(c).over(w), F.max(c).over(w), bins).alias(c) for c in ("a", "b")))
    cell = binned.groupBy(*key, "a", "b").agg(F.count("*").alias("n"))
    wa, wb, wk = Window.partitionBy(*key, "a"), Window.partitionBy(*key, "b"), Window.partitionBy(*key)
    p = cell.select(*key, *((F.sum("n").over(x) / F.sum("n").over(wk)).alias(k) for x, k in ((wa, "pa"), (wb, "pb"))), (F.col("n") / F.sum("n").over(wk)).alias("p"))
    return p.groupBy(*key).agg(F.sum(F.col("p") * F.log2(F.col("p") / (F.col("pa") * F.col("pb") + 1e-12))).alias("mi"))


#: Rows of a series that a kernel takes whole for its delays.
WHOLE = 100_000


def tau_mutual_information(series: DataFrame, key: str, value: str = "x", most: int = 30, bins: int = 20) -> DataFrame:
    """key, tau_mi: the first delay whose circularly shifted mutual information lies below that of neighbouring
    samples, else 1. The shift is circular and the reference value isn't, as in the published heuristic. Series of up to WHOLE
    finite values go through a kernel, so no row is repeated for each delay; the others go row by row. A series of one row
    gives none."""
    series = series.select(key, "i", F.col(value).cast("double").alias("x"))
    finite = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))
    others = stored(series.groupBy(key).agg(F.count("*").alias("_n"), F.count_if(finite).alias("_f")).filter((F.col("_n") > WHOLE) | (F.col("_f") < F.col("_n"))).select(key), "long")
    none = others.isEmpty()
    spark = series.sparkSession
    # a number of partitions that stays, as a series costs more than its bytes tell
    rows = series if none else ranks.same(series, others.hint("merge"), [key], "left_anti")
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    arrays = rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("x"))
    first = kernels.each(lambda v: kernels.first_below(v, most, bins), lambda n: None, "bigint", pa.int64())
    got = arrays.filter(F.size("x") > 1).select(key, first(F.col("x")).alias("tau_mi"))
    if none:
        return got
    return stored(got.unionByName(_tau_by_rows(ranks.same(series, others.hint("merge"), [key], "left_semi"), key, "x", most, bins)), "delays")


def _tau_by_rows(series: DataFrame, key: str, value: str, most: int, bins: int) -> DataFrame:
    """tau_mutual_information of series of any size and value."""
    w = Window.partitionBy(key).orderBy("i")
    base = series.select(key, "i", F.col(value).alias("a"), F.lead(value).over(w).alias("b"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    near = mutual_information(base.filter(F.col("i") < F.col("n") - 1), [key], bins).withColumnRenamed("mi", "mi_1")
    top = F.least(F.lit(most), F.floor(F.col("n") / 3).cast("int")) - 1
    taus = base.filter(top >= 1).select(key, "i", "a", "n", F.explode(F.sequence(F.lit(1), top)).alias("tau"))
    other = base.select(key, F.col("i").alias("j"), F.col("a").alias("b"))
    shifted = taus.withColumn("j", F.pmod(F.col("i") + F.col("tau"), F.col("n")).cast("int")).join(other, [key, "j"])
    by_tau = mutual_information(shifted.select(key, "tau", "a", "b"), [key, "tau"], bins)
    first = by_tau.join(near, key).filter(F.col("mi") < F.col("mi_1")).groupBy(key).agg(F.min("tau").alias("tau"))
    return near.join(first, key, "left").select(key, F.coalesce("tau", F.lit(1)).cast("long").alias("tau_mi"))


def dimension_hint(max_m: int = 10) -> int:
    """The published rule of thumb for the embedding dimension."""
    return max(3, min(max_m, 4))
