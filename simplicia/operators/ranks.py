"""Ranks, quantiles and expanding ranks of large groups.

A group is never sorted as a whole: its distinct values, counted before the shuffle, are dealt by ranges of (keys, value),
counted inside each range and moved by the counts of the ranges before. So a key of any size, and a value that a third of
all rows share, are spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from simplicia.sources.store import stored

#: Bins of a pass over the values of a key.
BINS = 1024
#: Values of a key that are sorted as one array for its quantiles.
FEW = 4096
#: Expanding ranks (distinct values times months) that are counted at once in a range, on average.
RANGE = 16_384 * 84


def same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined to the columns that b adds; null keys are equal, as they are in a grouping."""
    named = b.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in b.columns if c not in keys))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return a.join(named, on, how).drop(*(f"_k_{k}" for k in keys))


def ranges(counted: DataFrame, keys: list[str], value: str, parts: int | None = None) -> DataFrame:
    """counted, in ranges of (keys, value) numbered by _p; stored, as the borders of a range partitioning are drawn anew each
    time."""
    n = parts or int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(counted.repartitionByRange(n, *keys, value).withColumn("_p", F.spark_partition_id()), "ranges")


def value_ranks(df: DataFrame, keys: list[str], value: str, weight: str | None = None, parts: int | None = None) -> DataFrame:
    """keys, value, n (rows with it), before (rows of the key with a smaller one) and rank (from 1, ties at their mean), a row
    for each distinct value. weight: a column that counts rows."""
    n = F.sum(weight) if weight else F.count("*")
    dealt = ranges(df.groupBy(*keys, value).agg(n.alias("n")), keys, value, parts)
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("_p", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = dealt.groupBy(*keys, "_p").agg(F.sum("n").alias("_t"))  # a row for each key and range
    moved = F.coalesce(F.sum("_t").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.withColumn("_o", moved).drop("_t")
    placed = same(dealt.withColumn("_in", inside), offsets, [*keys, "_p"]).withColumn("before", F.col("_in") + F.col("_o"))
    return placed.select(*keys, value, "n", "before", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def _places(n: Column, q: float) -> Column:
    """The two order statistics (from 0) that a quantile lies between, and its share of the way."""
    at = q * (n - 1)
    low = F.floor(at)
    return F.struct(low.alias("low"), F.ceil(at).alias("high"), (at - low).alias("share"))


def quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], bins: int = BINS) -> DataFrame:
    """keys, q and the exact quantile (linear between order statistics, as percentile() gives) of the values other than null
    and NaN. df is read once a pass; store it if it is dear. Keys of up to FEW values take one shuffle (`_sorted_quantiles`), so
    that their number, which grows with the table, costs no passes and nothing on the driver; the others go by bins."""
    if not keys:
        return _binned_quantiles(df, keys, value, qs, bins)
    rows = df.select(*keys, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull() & ~F.isnan(value))
    large = stored(rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > FEW).select(*keys), "large")
    if large.isEmpty():
        return _sorted_quantiles(rows, keys, value, qs)
    few, many = _sorted_quantiles(same(rows, large, keys, "left_anti"), keys, value, qs), _binned_quantiles(same(rows, large, keys, "left_semi"), keys, value, qs, bins)
    return stored(few.unionByName(many), "quantiles")


def _sorted_quantiles(rows: DataFrame, keys: list[str], value: str, qs: list[float]) -> DataFrame:
    got = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_s"))
    each = got.select(*keys, "_s", F.explode(F.array(*(F.struct(F.lit(q).alias("q"), _places(F.size("_s"), q).alias("at")) for q in qs))).alias("w"))
    a, b = F.get("_s", F.col("w.at.low").cast("int")), F.get("_s", F.col("w.at.high").cast("int"))
    return each.select(*keys, "w.q", (a + (b - a) * F.col("w.at.share")).alias(value))


def _binned_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], bins: int) -> DataFrame:
    """Quantiles of keys of any size.

    Each pass counts the values of a key in equal bins of what is left of its range and keeps the bin of the wanted place,
    cut to its least and largest value; it ends when they are equal. A pass sends at most `bins` rows for each key and place
    from a task, whatever the number of distinct values, and three passes part a billion of them; far outliers cost one
    more. Without keys, and with no values, the quantile of the one group is null."""
    spark = df.sparkSession
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    first = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    wanted = first.select("*", F.explode(F.array(*(F.struct(F.lit(q).alias("q"), _places(F.col("_n"), q).alias("at")) for q in qs))).alias("w")).select(*keys, "lo", "hi", "w.q", "w.at")
    ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("at.low").alias("place")), F.struct(F.lit(1).alias("end"), F.col("at.high").alias("place"))))
    state = stored(wanted.select(*keys, "q", F.col("at.share").alias("share"), "lo", "hi", F.lit(0).cast("long").alias("below"), ends.alias("e")).select(*keys, "q", "share", "lo", "hi", "below", "e.end", "e.place"), "quantiles")
    while not (open_ := state.filter("lo < hi")).isEmpty():
        # keys and places that look at the same range share its bins
        searched = open_.select(*keys, "lo", "hi", "below").distinct()
        met = same(rows, searched, keys) if keys else rows.join(F.broadcast(searched))
        share = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves, as a width can be too large
        # the ends have bins of their own, so every pass gets on, whatever lies between
        bin_ = F.when(F.col("_v") == F.col("lo"), -1).when(F.col("_v") == F.col("hi"), bins).otherwise(F.least(F.floor(F.nanvl(share, F.lit(0.0)) * bins), F.lit(bins - 1)))
        counted = met.filter((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))).groupBy(*keys, "lo", "hi", "below", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "lo", "hi", "below").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        placed = counted.withColumn("upto", F.col("below") + upto)
        held = same(open_, placed.drop("bin"), [*keys, "lo", "hi", "below"]).filter((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
        smaller = held.select(*keys, "q", "share", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("upto") - F.col("n")).alias("below"), "end", "place")
        state = stored(smaller.unionByName(state.filter("lo = hi")), "quantiles")
    both = F.max(F.when(F.col("end") == 0, F.col("lo"))), F.max(F.when(F.col("end") == 1, F.col("lo")))
    found = state.repartition(*keys, "q").groupBy(*keys, "q", "share").agg(both[0].alias("a"), both[1].alias("b"))
    out = found.select(*keys, "q", (F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias(value))
    if keys:
        return out
    return spark.createDataFrame([(q,) for q in qs], "q double").join(out, "q", "left")


def column_quantiles(df: DataFrame, columns: list[str], q: float) -> DataFrame:
    """One row: the exact quantile of each column, null where it has no value."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))
    long = stored(df.select(F.explode(cells).alias("c")).select("c.*"), "columns")
    found = quantiles(long, ["column"], "v", [q])
    return found.agg(*(F.max(F.when(F.col("column") == c, F.col("v"))).alias(c) for c in columns))


def paired_ranks(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, rx, ry: the pairs of ranks that occur for each key and how often. Rows without x or y don't count."""
    both = stored(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("n")), "pairs")
    rx = value_ranks(both, keys, "_x", "n").select(*keys, "_x", F.col("rank").alias("rx"))
    ry = value_ranks(both, keys, "_y", "n").select(*keys, "_y", F.col("rank").alias("ry"))
    return same(same(both, rx, [*keys, "_x"]), ry, [*keys, "_y"]).select(*keys, "n", "rx", "ry")


def rank_correlation(n: Column, xy: Column, xx: Column, yy: Column) -> Column:
    """From the number of rows and the sums of products of ranks around their mean; 0 where a side is constant."""
    flat = (xx <= 1e-9 * n) | (yy <= 1e-9 * n)
    return F.when(flat, F.lit(0.0)).otherwise(F.try_divide(xy, F.sqrt(xx) * F.sqrt(yy)))


def _month_ranks(value: str, months: int) -> Callable:
    """Twice the rank of every distinct value among the rows of the months before each month, less one."""

    def run(rows, offsets):
        import numpy as np
        import pyarrow as pa

        f, v, m, n = (rows[c].to_numpy() for c in ("feature", value, "number", "n"))
        if not len(f):
            return pa.table({"feature": pa.array([], pa.string()), value: pa.array([], pa.float64()), "ranks": pa.array([], pa.list_(pa.int64()))})
        before = {}
        for g, k, o in zip(offsets["feature"].to_pylist(), offsets["number"].to_pylist(), offsets["o"].to_pylist(), strict=True):
            before.setdefault(g, np.zeros(months, np.int64))[k] = o
        order = np.lexsort((v, f.astype(str)))
        f, v, m, n = f[order], v[order], m[order], n[order]
        new = np.append(True, (f[1:] != f[:-1]) | (v[1:] != v[:-1]))
        at = np.cumsum(new) - 1
        equal = np.zeros((at[-1] + 1, months), np.int64)
        np.add.at(equal, (at, m), n)
        f, v = f[new], v[new]
        below = np.cumsum(equal, axis=0) - equal
        for i in np.flatnonzero(np.append(True, f[1:] != f[:-1])):
            of = f == f[i]
            below[of] += before.get(f[i], np.zeros(months, np.int64)) - below[i]
        ranks = np.cumsum(2 * below + equal, axis=1)  # up to and including each month
        return pa.table({"feature": pa.array(f.tolist(), pa.string()), value: v, "ranks": pa.ListArray.from_arrays(np.arange(0, len(f) * months + 1, months, dtype=np.int32), pa.array(ranks.ravel()))})

    return run


def month_ranks(rows: DataFrame, value: str, months: int, weight: str | None = None) -> DataFrame:
    """feature, value and ranks, for each distinct value of a feature: at place k twice its mean-tie rank, less one, among the
    rows of the months 0..k. rows: feature, number (of the month, from 0), the value and on request a column that counts rows. One sort of the distinct values by
    ranges and cumulative counts give all of them, so the panel isn't repeated for each later month."""
    counted = rows.groupBy("feature", value, "number").agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    parts = max(counted.count() * months // RANGE, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = ranges(counted, ["feature"], value, parts)
    totals = dealt.groupBy("feature", "number", "_p").agg(F.sum("n").alias("t"))  # a row for each month of a range
    here = dealt.select("feature", "_p").distinct()
    first = Window.partitionBy("feature", "number").orderBy("_p")
    reached = same(here, dealt.select("feature", "number").distinct(), ["feature"]).join(totals, ["feature", "number", "_p"], "left")
    offsets = reached.select("feature", "number", "_p", F.coalesce(F.sum("t").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    a, b = (d.select(*(F.col(c).alias(c) for c in d.columns)) for d in (dealt, offsets))
    return a.groupBy("_p").cogroup(b.groupBy("_p")).applyInArrow(_month_ranks(value, months), f"feature string, {value} double, ranks array<bigint>")


#: Rows of a block of the expanding rank correlation.
BLOCK = 200_000


def _edges(months: int) -> Callable:
    """What the blocks of a feature, in the order of y, need of each other, by month: rows in earlier ones (before), those of them that
    share the block's least y (level), and rows of later ones that share its greatest y (after)."""

    def run(rows):
        import numpy as np
        import pyarrow as pa

        blocks, at = np.unique(rows["_p"].to_numpy(), return_inverse=True)
        table = {c: np.zeros((len(blocks), months), np.int64) for c in ("n", "n_lo", "n_hi")}
        for c, t in table.items():
            np.add.at(t, (at, rows["number"].to_numpy()), rows[c].to_numpy())
        lo, hi = np.zeros(len(blocks)), np.zeros(len(blocks))
        lo[at], hi[at] = rows["lo"].to_numpy(), rows["hi"].to_numpy()
        before = np.cumsum(table["n"], axis=0) - table["n"]
        level, after = np.zeros_like(before), np.zeros_like(before)
        for k in range(1, len(blocks)):  # a block's greatest y is its only one where it equals the least
            if hi[k - 1] == lo[k]:
                level[k] = table["n_hi"][k - 1] + (level[k - 1] if lo[k - 1] == hi[k - 1] else 0)
        for k in range(len(blocks) - 2, -1, -1):
            if lo[k + 1] == hi[k]:
                after[k] = table["n_lo"][k + 1] + (after[k + 1] if lo[k + 1] == hi[k + 1] else 0)
        whole = np.concatenate([before, level, after], axis=1)
        ends = np.arange(0, whole.size + 1, 3 * months, dtype=np.int32)
        return pa.table({"_p": pa.array(blocks, pa.int32()), "feature": pa.array([rows["feature"][0].as_py()] * len(blocks), pa.string()), "x": pa.nulls(len(blocks), pa.float64()), "ranks": pa.ListArray.from_arrays(ends, pa.array(whole.ravel()))})

    return run


def _block_sums(months: int) -> Callable:
    """Sums of products of twice the ranks, less one, over the rows of a block, for each feature and last month."""

    def run(rows, tables):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        out = []
        for feature in pc.unique(rows["feature"]).to_pylist():
            own = rows.filter(pc.equal(rows["feature"], feature) if feature is not None else pc.is_null(rows["feature"]))
            known = tables.filter(pc.equal(tables["feature"], feature) if feature is not None else pc.is_null(tables["feature"])).combine_chunks()
            edges, values = known.filter(pc.is_null(known["x"])), known.filter(pc.is_valid(known["x"]))
            before, level, after = edges["ranks"].combine_chunks().flatten().to_numpy().reshape(3, months)
            flat = values["ranks"].combine_chunks()
            rx = flat.flatten().to_numpy().reshape(-1, months)
            at_x = values["x"].to_numpy()
            x_order = np.argsort(at_x, kind="stable")
            x, y, m, n = (own[c].to_numpy() for c in ("x", "y", "number", "n"))
            order = np.argsort(y, kind="stable")
            x, y, m, n = x[order], y[order], m[order], n[order]
            of_x = x_order[np.searchsorted(at_x[x_order], x)]
            of_y = np.cumsum(np.append(False, y[1:] != y[:-1]))
            sums = np.zeros((4, months))
            below, start = before.copy(), 0
            while start < len(y):  # some thousand values at a time
                stop = int(np.searchsorted(of_y, of_y[start] + 4096))
                v = of_y[start:stop] - of_y[start]
                equal = np.zeros((v[-1] + 1, months), np.int64)
                np.add.at(equal, (v, m[start:stop]), n[start:stop])
                under = np.cumsum(equal, axis=0) - equal + below
                below = below + equal.sum(axis=0)
                if of_y[start] == 0:
                    under[0] -= level
                    equal[0] += level
                if stop == len(y):
                    equal[-1] += after
                ry = np.cumsum(2 * under + equal, axis=1)
                for at in range(start, stop, 16384):
                    part = slice(at, min(at + 16384, stop))
                    counted = np.where(np.arange(months) >= m[part, None], n[part, None], 0).astype(float)
                    a, b = rx[of_x[part]].astype(float), ry[of_y[part] - of_y[start]].astype(float)
                    sums += np.stack([counted.sum(0), (counted * a * b).sum(0), (counted * a * a).sum(0), (counted * b * b).sum(0)])
                start = stop
            out.append((feature, sums))
        kept = [np.flatnonzero(s[0] > 0) for _, s in out]
        column = lambda k: pa.array(np.concatenate([s[k][i] for (_, s), i in zip(out, kept, strict=True)]))
        names = pa.array([f for (f, _), i in zip(out, kept, strict=True) for _ in i], pa.string())
        return pa.table({"feature": names, "last": pa.array(np.concatenate(kept).astype(np.int32)), "n": column(0), "ab": column(1), "aa": column(2), "bb": column(3)})

    return run


def expanding_spearman(rows: DataFrame, months: int, purge: int = 0, least: int = 10) -> DataFrame:
    """feature, number and ic: for each month the rank correlation of x and y over all rows of the months before it (less the
    latest `purge` of them), null with fewer than `least` rows. rows: feature, number (from 0), x, y, none of them null.

    Rows are dealt by ranges of y into blocks, which count their ranks in y themselves; only the ranks of the distinct values of x in
    a block are sent to it. So no row is shuffled with an array of months, and a y that many rows share is no one task's."""
    typed = rows.select("feature", "number", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    # -0.0 is 0.0
    counted = stored(typed.select("feature", "number", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y")).groupBy("feature", "number", "x", "y").agg(F.count("*").alias("n")), "expanding")
    shuffles = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(counted.repartitionByRange(max(shuffles, counted.count() // BLOCK), "feature", "y", "x", "number").withColumn("_p", F.spark_partition_id()), "ranges")
    ends = dealt.groupBy("feature", "_p").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    of = lambda end: F.sum(F.when(F.col("y").eqNullSafe(F.col(end)), F.col("n")).otherwise(0)).alias(f"n_{end}")
    # a row for each month of a feature's block
    totals = same(dealt, ends, ["feature", "_p"]).groupBy("feature", "_p", "number").agg(F.sum("n").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), of("lo"), of("hi"))
    schema = "_p int, feature string, x double, ranks array<bigint>"
    edges = totals.groupBy("feature").applyInArrow(_edges(months), schema)
    rx = month_ranks(counted, "x", months, "n")
    needed = same(dealt.select("_p", "feature", "x").distinct(), rx, ["feature", "x"]).select("_p", "feature", "x", "ranks")
    tables = stored(needed.unionByName(edges), "tables")
    parts = dealt.groupBy("_p").cogroup(tables.groupBy("_p")).applyInArrow(_block_sums(months), "feature string, last int, n double, ab double, aa double, bb double")
    s = parts.groupBy("feature", "last").agg(*(F.sum(c).alias(c) for c in ("n", "ab", "aa", "bb")))
    n = F.col("n")
    about = lambda c: (F.col(c) - n * n * n) / 4  # noqa: E731  a and b are 2 * rank - 1, whose mean is n
    return s.select("feature", (F.col("last") + 1 + purge).alias("number"), n.cast("long").alias("n"), F.when(n >= least, rank_correlation(n, about("ab"), about("aa"), about("bb"))).alias("ic"))
