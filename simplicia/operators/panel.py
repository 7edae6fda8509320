"""Panels keyed by entity and date: eligibility, joins, labels, windows, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from simplicia.operators.ranks import column_quantiles


def eligible(panel: DataFrame, entity: str, date: str, columns: list[str], min_days: int, min_coverage: float) -> DataFrame:
    """entity, n_days and the coverage of each column (values a day), for entities with enough of both."""
    days = F.greatest(F.count_distinct(date), F.lit(1))
    got = panel.groupBy(entity).agg(F.count_distinct(date).alias("n_days"), *((F.count(c) / days).alias(f"cov_{c}") for c in columns))
    keep = F.col("n_days") >= min_days
    for c in columns:
        keep = keep & (F.col(f"cov_{c}") >= min_coverage)
    return got.filter(keep)


def top_entities(eligible_: DataFrame, entity: str, n: int) -> DataFrame:
    """The n entities with most days, ties by id."""
    return eligible_.orderBy(F.desc("n_days"), entity).limit(n)


def restricted(panel: DataFrame, entities: DataFrame, entity: str) -> DataFrame:
    """Rows of the given entities (semi join; Spark decides on a broadcast by size)."""
    return panel.join(entities.select(entity), entity, "left_semi")


def column_coverage(panel: DataFrame, columns: list[str], share: float = 0.6) -> DataFrame:
    """column, coverage (share of rows with a value; 0 without rows) and kept, whether that reaches `share`: one aggregate."""
    shares = panel.agg(*(F.coalesce(F.avg(F.col(c).isNotNull().cast("int")), F.lit(0.0)).alias(c) for c in columns)).unpivot([], columns, "column", "coverage")
    return shares.withColumn("kept", (F.col("coverage") >= share).cast("int"))


def covered_columns(panel: DataFrame, columns: list[str], share: float = 0.6) -> list[str]:
    """The kept columns of column_coverage, a row for each of them to the driver."""
    kept = {r["column"] for r in column_coverage(panel, columns, share).filter("kept = 1").collect()}
    return [c for c in columns if c in kept]


def any_present(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a value in at least one of the columns."""
    return df.filter(F.coalesce(*columns).isNotNull())


def complete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a finite value in all of the columns."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.filter(ok)


def median_imputed(df: DataFrame, *columns: str) -> DataFrame:
    """Missing values replaced by the column's exact median over all rows, 0 where a column has no value; the medians are
    one row, joined to all."""
    medians = column_quantiles(df, list(columns), 0.5).select(*(F.coalesce(c, F.lit(0.0)).alias(f"_m_{c}") for c in columns))
    filled = df.join(F.broadcast(medians)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in columns})
    return filled.drop(*medians.columns)


def missing_profile(panel: DataFrame, columns: list[str]) -> DataFrame:
    """column and share of missing values."""
    shares = panel.agg(*(F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns))
    return shares.unpivot([], columns, "column", "missing")


def whole_groups(df: DataFrame, keys: list[str], size: int, valid: Column) -> DataFrame:
    """Rows of groups that have exactly `size` rows, all valid."""
    w = Window.partitionBy(*keys)
    marked = df.withColumns({"_n": F.count("*").over(w), "_ok": F.min(valid.cast("int")).over(w)})
    return marked.filter((F.col("_n") == size) & (F.col("_ok") == 1)).drop("_n", "_ok")


def bar_channels(bars: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Channels of bars (open, high, low, close, volume, amount): log return to the bar before (0 for the first),
    log volume, relative range, log amount. What a price of 0 leaves undefined is null."""
    w = Window.partitionBy(*keys).orderBy(order)
    return bars.select(
        *keys, order, F.ln(F.try_divide(F.col("close"), F.coalesce(F.lag("close").over(w), "close"))).alias("ret"), F.log1p("volume").alias("logvol"),
        F.try_divide(F.col("high") - F.col("low"), F.col("close")).alias("rng"), F.log1p("amount").alias("lamt"),
    )


def trailing_mean(df: DataFrame, keys: list[str], order: str, value: str, rows: int = 60) -> Column:
    """Mean of the row and up to `rows` before it among rows of equal keys (for a seasonal pattern: entity, bar)."""
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-rows, 0))


def forward_volatility(entity: str, order: list[str], ret: str, h: int, least: int = 3) -> Column:
    """Sample standard deviation of the next h returns, null with fewer than `least`."""
    w = Window.partitionBy(entity).orderBy(*order).rowsBetween(1, h)
    return F.when(F.count(ret).over(w) >= least, F.stddev_samp(ret).over(w))


def forward_mean(entity: str, order: list[str], value: str, h: int) -> Column:
    """Mean of the next h values."""
    return F.avg(value).over(Window.partitionBy(entity).orderBy(*order).rowsBetween(1, h))


def forward_sum(entity: str, order: list[str], value: str, h: int) -> Column:
    """Sum of the next h values, null with fewer than max(2, h // 2)."""
    w = Window.partitionBy(entity).orderBy(*order).rowsBetween(1, h)
    return F.when(F.count(value).over(w) >= max(2, h // 2), F.sum(value).over(w))


def sliding_windows(series: DataFrame, key: str, win: int, stride: int, horizon: int, longest: int, values: list[str] = ()) -> DataFrame:
    """key, start, and the slices of the array columns of every window that leaves `horizon` rows behind it; series
    shorter than win + longest + 5 have none. series: key, n and arrays."""
    last = F.col("n") - win - horizon
    starts = F.when((F.col("n") >= win + longest + 5) & (last >= 0), F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return series.select(key, "n", *values, F.explode(starts).alias("start")).select(key, "start", *(F.slice(v, F.col("start") + 1, win).alias(v) for v in values))


def window_rows(series: DataFrame, key: str, values: list[str], win: int, stride: int, horizon: int = 0) -> DataFrame:
    """The rows of every sliding window of an indexed series (key, i, values), with start and their place in it (at): each
    row finds its own windows, so no series is gathered. Windows end `horizon` rows before the series does at the latest."""
    n = series.groupBy(key).agg(F.count("*").alias("_n"))
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - win + 1) / stride)) * stride
    last = F.floor(F.least(F.col("i"), F.col("_n") - horizon - win) / stride) * stride
    starts = F.when(last >= first, F.sequence(first, last, F.lit(stride).cast("long")))
    rows = series.join(n, key).select(key, "i", *values, F.explode(starts).alias("start"))
    return rows.withColumn("at", F.col("i") - F.col("start"))


def window_edges(edges: DataFrame, sizes: DataFrame, key: str, span: int, win: int, stride: int, horizon: int = 0) -> DataFrame:
    """edges (key, i, j, d; i < j) with the starts of all windows that hold both ends: distances are computed once for a
    series and shared by its overlapping windows. A point covers `span` rows; sizes: key and n, the rows of the series."""
    first = F.greatest(F.lit(0), F.ceil((F.col("j") + span - win) / stride)) * stride
    last = F.floor(F.least(F.col("i"), F.col("n") - horizon - win) / stride) * stride
    starts = F.when(last >= first, F.sequence(first, last, F.lit(stride).cast("long")))
    return edges.join(sizes, key).select(key, F.explode(starts).alias("start"), "i", "j", "d")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def interpolated(series: DataFrame, key: str, value: str, min_share: float = 0.8) -> DataFrame:
    """Gaps filled on the line between neighbours, constant at the ends; series with too few values or without
    spread are dropped. series: key, i and the value."""
    w = Window.partitionBy(key)
    before, after = w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0), w.orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col("i"))
    df = series.withColumns({
        "_x0": F.last(value, ignorenulls=True).over(before), "_i0": F.last(at, ignorenulls=True).over(before),
        "_x1": F.first(value, ignorenulls=True).over(after), "_i1": F.first(at, ignorenulls=True).over(after),
        "_share": F.avg(F.col(value).isNotNull().cast("int")).over(w),
    })
    line = F.when(F.col("_i1") == F.col("_i0"), F.col("_x0")).otherwise(F.col("_x0") + (F.col("_x1") - F.col("_x0")) * (F.col("i") - F.col("_i0")) / (F.col("_i1") - F.col("_i0")))
    df = df.withColumn(value, F.coalesce(line, F.col("_x0"), F.col("_x1"))).filter(F.col("_share") >= min_share)
    return df.withColumn("_sd", F.stddev_pop(value).over(w)).filter(F.col("_sd") >= 1e-12).drop("_x0", "_i0", "_x1", "_i1", "_share", "_sd")


def least_ratio(scan: DataFrame, key: str, ratio: str, distance: str, diameter: str, tolerance: float) -> DataFrame:
    """The least subsample ratio whose distance stays below tolerance * diameter, 100 where none does."""
    good = F.when(F.col(distance) < tolerance * F.col(diameter), F.col(ratio))
    return scan.groupBy(key).agg(F.coalesce(F.min(good), F.lit(100)).alias("min_ratio"))


def monotone(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Whether a value never rises along an order."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return df.select(key, step.alias("s")).groupBy(key).agg((F.coalesce(F.max("s"), F.lit(0.0)) <= 0).alias("monotone"))
