"""Evaluation algebra: folds, rank statistics, factor selection and tests as joins, windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from simplicia.functions.scalars import seed_of
from simplicia.operators import ranks
from simplicia.sources.store import partitions, stored

#: Rows of a key that one task sorts or permutes at once.
WHOLE = 1_000_000


def purged_folds(ordered: DataFrame, splits: int, horizon: int, embargo: int) -> DataFrame:
    """k and role (train, test) of each row i of n: train [0, fold k - horizon), test [fold k + horizon + embargo,
    + fold), fold = n // (splits + 1); folds with fewer than five training rows are left out. Where a fold would have
    fewer than two rows there is one split: all rows but the last train, the last one tests. ordered: i, n."""
    fold = F.floor(F.col("n") / (splits + 1))
    rows = ordered.select("*", F.explode(F.sequence(F.lit(1), F.lit(splits))).alias("k"))
    start = fold * F.col("k")
    role = F.when(F.col("i") < start - horizon, "train").when((F.col("i") >= start + horizon + embargo) & (F.col("i") < start + horizon + embargo + fold), "test")
    single = F.when(F.col("k") == 1, F.when(F.col("i") == F.col("n") - 1, "test").otherwise("train"))
    several = F.when(start - horizon >= 5, role)
    return rows.withColumn("role", F.when(fold < 2, single).otherwise(several)).filter(F.col("role").isNotNull())


def dealt_rank(df: DataFrame, key: str, id_: str, seed: int = 0, buckets: int = 256) -> DataFrame:
    """df with rank (from 0, in the order of a seeded hash of the id) and size within each key. Ranks are counted in buckets
    of the hash first and moved by the buckets before, so that a key of few values isn't sorted in one task."""
    h = seed_of(F.lit(str(seed)), F.col(id_).cast("string"))
    df = df.withColumn("_h", h).withColumn("_b", F.floor(F.col("_h") / ((1 << 31) // buckets)))
    counts = df.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "size": F.sum("_n").over(Window.partitionBy(key))}).drop("_n")
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_b").orderBy("_h", id_)))
    return ranked.join(counts, [key, "_b"]).withColumn("rank", F.col("_before") + F.col("_r") - 1).drop("_h", "_b", "_r", "_before")


def stratified(df: DataFrame, label: str, id_: str, k: int, train_share: float, seed: int = 0) -> DataFrame:
    """df with fold (0..k-1) and train (boolean), both with equal shares of each label, shuffled by the seed."""
    ranked = dealt_rank(df, label, id_, seed)
    return ranked.withColumns({"fold": F.pmod("rank", F.lit(k)), "train": F.col("rank") < F.floor(F.col("size") * train_share)}).drop("rank", "size")


def group_fold(group: Column, k: int, seed: int = 0) -> Column:
    """Fold 0..k-1 of a group: all its rows share it, whatever partition they lie in."""
    return F.pmod(seed_of(F.lit(str(seed)), group.cast("string")), F.lit(k))


def auc(scores: DataFrame, keys: list[str], score: str, label: str, least: int = 6) -> DataFrame:
    """Area under the curve of a score against a 0/1 label, ties at a half; null below `least` rows or with one
    class only. Ranks come from the counts of distinct scores, so rows aren't sorted or joined back."""
    rows = stored(scores.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count("*").alias("_all"), F.count_if(F.col(label) == 1).alias("_pos")), "auc")
    ranked = ranks.same(rows, ranks.value_ranks(rows, keys, score, "_all").drop("n", "before"), [*keys, score])
    n1, n = F.sum("_pos"), F.sum("_all")
    u = F.sum(F.col("rank") * F.col("_pos")) - n1 * (n1 + 1) / 2
    return ranked.groupBy(*keys).agg(F.when((n1 > 0) & (n1 < n) & (n >= least), u / (n1 * (n - n1))).alias("auc"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, least: int = 10) -> DataFrame:
    """ic (rank correlation) and n for each key; null with few rows, 0 for a constant column. Keys of up to WHOLE rows are sorted
    in a task, so their rows are shuffled once; larger keys go by ranges of their values (`_spearman_by_ranges`)."""
    kinds = dict(df.dtypes)
    if not keys or not {kinds[x], kinds[y]} <= {"double", "float", "int", "smallint", "tinyint"}:  # what a double holds exactly
        return _spearman_by_ranges(df, keys, x, y, least)
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = stored(known.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")), "pairs")
    large = stored(rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > WHOLE).select(*keys), "large")
    none = large.isEmpty()
    few = rows if none else ranks.same(rows, large, keys, "left_anti")
    # a number of partitions that stays and grows with the rows, so that a task's memory doesn't
    got = few.repartition(partitions(few.sparkSession, rows.count()), *keys).groupBy(*keys).applyInArrow(_whole_spearman(keys, least), _schema(df, keys) + ", ic double, n bigint")
    if none:
        return got
    return stored(got.unionByName(_spearman_by_ranges(ranks.same(rows, large, keys, "left_semi"), keys, "_x", "_y", least)), "ics")


def _schema(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema.fields)


def _whole_spearman(keys: list[str], least: int):
    def run(rows):
        import numpy as np
        import pyarrow as pa

        def ranks_of(a):
            _, at, n = np.unique(a, return_inverse=True, return_counts=True)
            return (np.cumsum(n) - (n - 1) / 2)[at] - (len(a) + 1) / 2

        a, b = ranks_of(rows["_x"].to_numpy()), ranks_of(rows["_y"].to_numpy())
        n, aa, bb = len(a), (a * a).sum(), (b * b).sum()
        ic = None if n < least else 0.0 if aa <= 1e-9 * n or bb <= 1e-9 * n else float((a * b).sum() / (np.sqrt(aa) * np.sqrt(bb)))
        return pa.table({**{k: rows[k].slice(0, 1) for k in keys}, "ic": pa.array([ic], pa.float64()), "n": pa.array([n], pa.int64())})

    return run


def _spearman_by_ranges(df: DataFrame, keys: list[str], x: str, y: str, least: int) -> DataFrame:
    """spearman of keys of any size."""
    pairs = ranks.paired_ranks(df, keys, x, y)
    centre = pairs.groupBy(*keys).agg(F.sum("n").alias("_all"))
    c = ranks.same(pairs, centre, keys) if keys else pairs.join(F.broadcast(centre))
    a, b = F.col("rx") - (F.col("_all") + 1) / 2, F.col("ry") - (F.col("_all") + 1) / 2
    got = c.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(a * b * F.col("n")).alias("_xy"), F.sum(a * a * F.col("n")).alias("_xx"), F.sum(b * b * F.col("n")).alias("_yy"))
    return got.select(*keys, F.when(F.col("n") >= least, ranks.rank_correlation(F.col("n"), F.col("_xy"), F.col("_xx"), F.col("_yy"))).alias("ic"), "n")


def long_features(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, feature, x."""
    return df.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))).alias("f")).select(*keys, "f.*")


def selected(ics: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k features with the largest |ic| of each key, ties by name."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.abs("ic")), "feature")
    return ics.filter(F.col("ic").isNotNull()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def expanding_selection(panel: DataFrame, months: DataFrame, features: list[str], label: str, k: int, min_months: int, min_rows: int, purge: int = 0) -> DataFrame:
    """month, feature, ic, rank: for each month the features chosen on all earlier ones. months: month, number (from 1). purge
    leaves out as many of the latest earlier months, for labels that reach into the month. Ranks among all earlier rows are
    sums of counts by month (`ranks.expanding_spearman`), so the panel is sorted once."""
    size = months.count()
    numbered = panel.join(months.select("month", (F.col("number") - 1).cast("int").alias("number")), "month")
    long = long_features(numbered, ["number", label], features).filter(F.col("x").isNotNull() & F.col(label).isNotNull())
    ics = ranks.expanding_spearman(long.select("feature", "number", "x", F.col(label).alias("y")), size, purge)
    by_month = numbered.groupBy("number").agg(F.count("*").alias("rows"))  # a row for each month
    past = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = by_month.select((F.col("number") + 1 + purge).alias("number"), F.sum("rows").over(past).alias("rows"), F.count("*").over(past).alias("n_months"))
    enough = seen.filter((F.col("rows") >= min_rows) & (F.col("n_months") >= min_months)).select("number")
    named = months.select("month", (F.col("number") - 1).cast("int").alias("number"))
    return selected(ics.join(enough, "number", "left_semi").join(named, "number").drop("number"), ["month"], k)


def factor_scores(panel: DataFrame, chosen: DataFrame, id_: str, features: list[str], label: str, by: list[str] = ()) -> DataFrame:
    """month, id, label and score: the chosen features (raw, unstandardised) weighted by their past ic. A month without
    choice, and a sum of weights of zero, give no rows. by: further columns of the choice that keep scores apart."""
    held = chosen.groupBy(*by, "month").agg(F.sum(F.abs("ic")).alias("_all"), F.map_from_entries(F.collect_list(F.struct("feature", "ic"))).alias("_w"))
    # a row for each month, so the panel isn't shuffled
    scored = panel.join(F.broadcast(stored(held.filter("_all >= 1e-12").drop("_all"), "weights")), "month")
    terms = [F.col(f).cast("double") * F.try_element_at("_w", F.lit(f)) for f in features]
    score = F.when(F.coalesce(*terms).isNotNull(), sum((F.coalesce(t, F.lit(0.0)) for t in terms), start=F.lit(0.0)))
    return scored.select(*by, "month", id_, label, score.alias("score"))


def expanding_ic(panel: DataFrame, chosen: DataFrame, id_: str, features: list[str], label: str, least: int, by: list[str] = ()) -> DataFrame:
    """month and ic of factor_scores."""
    return spearman(factor_scores(panel, chosen, id_, features, label, by), [*by, "month"], "score", label, least)


def newey_west(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """mean, nw_t, sd and n of an ordered series: Bartlett weights up to lag floor(4 (n / 100)^(2/9)); null t below
    four values."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct(order, F.col(value).alias("v")))), lambda r: r["v"])
    got = series.filter(F.col(value).isNotNull()).groupBy(*keys).agg(rows.alias("v"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count("*").alias("n"))
    e = got.withColumn("e", F.transform("v", lambda x: x - F.col("mean")))
    cov = lambda lag: F.aggregate(F.zip_with(F.slice("e", F.lit(1), F.col("n").cast("int") - lag), F.slice("e", lag + 1, F.col("n").cast("int") - lag), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) / F.col("n")
    lags = F.floor(4 * F.pow(F.col("n") / 100.0, F.lit(2 / 9))).cast("int")
    weights = F.when(lags >= 1, F.transform(F.sequence(F.lit(1), lags), lambda k: 2 * (1 - k / (lags + 1)) * cov(k))).otherwise(F.array().cast("array<double>"))
    s = cov(F.lit(0)) + F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return e.select(*keys, "n", "mean", "sd", F.when(F.col("n") >= 4, F.col("mean") / F.sqrt(F.greatest(s, F.lit(1e-18)) / F.col("n"))).alias("nw_t"))


def ic_summary(ics: DataFrame, keys: list[str], value: str = "ic") -> DataFrame:
    """n, mean ic, icir, t and the share above 0 (beyond rounding); null below three values."""
    good = ics.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.avg((F.col(value) > 1e-12).cast("int")).alias("p"))
    ok = F.col("n") >= 3
    spread = ok & (F.col("s") > 0)
    return good.select(*keys, "n", F.when(ok, F.col("m")).alias("ic"), F.when(spread, F.col("m") / F.col("s")).alias("icir"), F.when(spread, F.col("m") / (F.col("s") / F.sqrt("n"))).alias("t"), F.when(ok, F.col("p")).alias("positive"))


def paired(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """n, mean difference, t and wins of a over b."""
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, (F.col(a) - F.col(b)).alias("d"))
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("d").alias("diff"), F.when(F.stddev_samp("d") > 0, F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("*")))).alias("t"), F.count_if(F.col("d") > 0).alias("wins"))


def paired_pvalues(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, t_p and wilcoxon_p of paired differences (kernel; one key's pairs are a series of months or folds)."""
    kind = dict(df.dtypes)[key]

    def run(f):
        import numpy as np
        import pandas as pd

        from simplicia.functions.kernels import t_pvalue, wilcoxon_pvalue

        d = (f[a] - f[b]).dropna().to_numpy()
        sd = d.std(ddof=1) if len(d) > 1 else 0.0
        t = d.mean() / (sd / np.sqrt(len(d))) if sd > 0 else np.nan
        return pd.DataFrame({key: [f[key].iloc[0]], "t_p": [t_pvalue(t, len(d) - 1) if sd > 0 else None], "wilcoxon_p": [wilcoxon_pvalue(d)]})

    return df.select(key, a, b).groupBy(key).applyInPandas(run, f"{key} {kind}, t_p double, wilcoxon_p double")


def residual_1(df: DataFrame, keys: list[str], y: str, x: str, least: int = 6) -> DataFrame:
    """Residual of y on one factor with intercept within each key, by an aggregate joined back."""
    good = F.col(x).isNotNull() & F.col(y).isNotNull()
    fit = df.filter(good).groupBy(*keys).agg(F.regr_slope(y, x).alias("_slope"), F.regr_intercept(y, x).alias("_icept"), F.count("*").alias("_n"))
    value = F.when(good & (F.col("_n") >= least), F.col(y) - F.col("_icept") - F.col("_slope") * F.col(x))
    return df.join(fit, keys, "left").withColumn("residual", value).drop("_slope", "_icept", "_n")


def residuals(df: DataFrame, key: str, id_: str, y: str, factors: list[str]) -> DataFrame:
    """key, id and the least-squares residual of y on several factors with intercept within each key; null below
    p + 5 complete rows. The cross-section of a key is solved through its normal equations, which Spark sums, so no
    task gathers one."""
    import_cols = ["_one", *factors]
    rows = df.select(key, id_, F.col(y).alias("_y"), *factors).dropna(subset=["_y", *factors]).withColumn("_one", F.lit(1.0))
    pairs = [(i, j) for i in range(len(import_cols)) for j in range(i + 1)]
    sums = rows.groupBy(key).agg(F.count("*").alias("n"), *(F.sum(F.col(import_cols[i]) * F.col(import_cols[j])).alias(f"c{i}_{j}") for i, j in pairs), *(F.sum(F.col(c) * F.col("_y")).alias(f"b{i}") for i, c in enumerate(import_cols)))
    kind = dict(df.dtypes)[key]
    p = len(import_cols)

    def solve(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            out = []
            for r in f.to_dict("records"):
                a = np.zeros((p, p))
                for i, j in pairs:
                    a[i, j] = a[j, i] = r[f"c{i}_{j}"]
                beta = np.linalg.lstsq(a, np.array([r[f"b{i}"] for i in range(p)]), rcond=None)[0] if r["n"] >= len(factors) + 5 else None
                out.append((r[key], None if beta is None else beta.tolist()))
            yield pd.DataFrame(out, columns=[key, "beta"])

    betas = sums.mapInPandas(solve, f"{key} {kind}, beta array<double>")
    fit = sum((F.col("beta")[i] * F.col(c) for i, c in enumerate(import_cols)), start=F.lit(0.0))
    return rows.join(betas, key).select(key, id_, (F.col("_y") - fit).alias("residual"))


def fold_scores(rows: DataFrame, keys: list[str], fold: str, y: str, a: str, b: str) -> DataFrame:
    """rows with score: least squares of y on a and b with intercept, fitted within each key on the other folds; null where
    those don't determine it. One aggregate of sums by (keys, fold) gives all fits, as a fold's training sums are the key's
    less its own."""
    x = {"a": F.col(a).cast("double"), "b": F.col(b).cast("double"), "y": F.col(y).cast("double")}
    full = F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(y).isNotNull()
    names = ["a", "b", "y", "aa", "ab", "bb", "ay", "by"]
    own = rows.filter(full).groupBy(*keys, fold).agg(F.count("*").alias("_n"), *(F.sum(x[n] if len(n) == 1 else x[n[0]] * x[n[1]]).alias(f"_{n}") for n in names))
    rest = own.select(*keys, fold, *((F.sum(f"_{n}").over(Window.partitionBy(*keys)) - F.col(f"_{n}")).alias(f"_{n}") for n in ["n", *names]))
    about = lambda p, q: F.col(f"_{p}{q}") - F.col(f"_{p}") * F.col(f"_{q}") / F.col("_n")
    fit = rest.filter("_n > 2").withColumns({"_saa": about("a", "a"), "_sab": about("a", "b"), "_sbb": about("b", "b"), "_say": about("a", "y"), "_sby": about("b", "y")})
    det = F.col("_saa") * F.col("_sbb") - F.col("_sab") * F.col("_sab")
    fit = fit.withColumn("_det", F.when(det > 1e-9 * F.col("_saa") * F.col("_sbb"), det)).select(
        *keys, fold, (F.col("_a") / F.col("_n")).alias("_ma"), (F.col("_b") / F.col("_n")).alias("_mb"), (F.col("_y") / F.col("_n")).alias("_my"),
        ((F.col("_say") * F.col("_sbb") - F.col("_sby") * F.col("_sab")) / F.col("_det")).alias("_ca"), ((F.col("_sby") * F.col("_saa") - F.col("_say") * F.col("_sab")) / F.col("_det")).alias("_cb"),
    )
    score = F.col("_my") + F.col("_ca") * (F.col(a) - F.col("_ma")) + F.col("_cb") * (F.col(b) - F.col("_mb"))
    return ranks.same(rows, fit, [*keys, fold], "left").withColumn("score", score).drop("_ma", "_mb", "_my", "_ca", "_cb")


def permuted(df: DataFrame, key: str, id_: str, value: str, seeds: int) -> DataFrame:
    """seed, key, id and the value of another row of the same key, one random permutation for each seed."""
    rows = df.select(key, id_, value, F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    a, b = Window.partitionBy("seed", key).orderBy(id_), Window.partitionBy("seed", key).orderBy(seed_of(F.col("seed").cast("string"), F.col(id_).cast("string")), id_)
    n = rows.select("seed", key, id_, F.row_number().over(a).alias("r"))
    m = rows.select("seed", key, F.col(value), F.row_number().over(b).alias("r"))
    return n.join(m, ["seed", key, "r"]).select("seed", key, id_, value)


#: Seeds that a task takes for a key that it permutes at once.
SEEDS = 25


def permuted_ics(df: DataFrame, key: str, id_: str, value: str, y: str, seeds: int, x: str | None = None, least: int = 10) -> DataFrame:
    """seed, key, ic: the rank correlation of y with the value permuted within each key, one permutation (as `permuted` gives) for each
    seed; with x that of its residual on x. Keys without a pair give no row. A key of up to WHOLE rows goes with SEEDS seeds to a task,
    so what is shuffled is the rows once for each SEEDS seeds; larger keys are permuted and ranked row by row for every seed."""
    df = stored(df.select(key, id_, value, y, *([x] if x else [])).filter(F.col(key).isNotNull()), "permuted")
    large = stored(df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > WHOLE).select(key), "large")
    none = large.isEmpty()
    rows = df if none else df.join(large, key, "left_anti")
    rows = rows.select(key, id_, F.col(id_).cast("string").alias("_id"), F.col(value).cast("double").alias("_v"), F.col(y).cast("double").alias("_y"), F.col(x).cast("double").alias("_x") if x else F.lit(0.0).alias("_x"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit((seeds - 1) // SEEDS))).alias("_chunk"))
    # a number of partitions that stays: adaptive execution would join groups of few bytes up, though their seeds are their cost
    spark = df.sparkSession
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key, "_chunk")
    got = rows.groupBy(key, "_chunk").applyInArrow(_permuted_ics(key, id_, seeds, x is not None, least), f"seed int, {key} {dict(df.dtypes)[key]}, ic double")
    if none:
        return got
    moved = permuted(df.join(large, key, "left_semi"), key, id_, value, seeds).join(df.drop(value), [key, id_])
    by = ["seed", key]
    if x:
        moved, value = residual_1(moved, by, value, x), "residual"
    return stored(got.unionByName(spearman(moved, by, value, y, least).select("seed", key, "ic")), "ics")


def _permuted_ics(key: str, id_: str, seeds: int, residual: bool, least: int):
    def run(rows):
        import hashlib

        import numpy as np
        import pyarrow as pa

        rows = rows.sort_by(id_)  # nulls last
        names = [None if i is None else b"|" + i.encode() for i in rows["_id"].to_pylist()]
        number = lambda c: (rows[c].to_numpy(), np.asarray(rows[c].is_valid()))
        (v, has_v), (y, has_y), (x, has_x) = number("_v"), number("_y"), number("_x")
        md5 = hashlib.md5

        def ranks_of(a):
            _, at, n = np.unique(a, return_inverse=True, return_counts=True)
            return (np.cumsum(n) - (n - 1) / 2)[at] - (len(a) + 1) / 2

        full = not residual and has_v.all() and has_y.all()
        rv, ry = (ranks_of(v), ranks_of(y)) if full else (None, None)
        chunk = rows["_chunk"][0].as_py()
        out = []
        for seed in range(chunk * SEEDS, min(seeds, (chunk + 1) * SEEDS)):
            start = str(seed).encode()
            h = np.frombuffer(b"".join(b"\xff\xff\xff\xff" if i is None else md5(start + i).digest()[:4] for i in names), ">u4").astype(np.int64)
            h = np.where([i is None for i in names], 1 << 31, h & 0x7FFFFFFF) if None in names else h & 0x7FFFFFFF
            order = np.argsort(h, kind="stable")
            if full:
                a, b = rv[order], ry
            else:
                w, good = v[order], has_v[order]
                if residual:
                    good = good & has_x
                    if good.sum() < 6:
                        continue
                    dx, dw = x[good] - x[good].mean(), w[good] - w[good].mean()
                    if not (dx * dx).sum() > 0:
                        continue
                    slope = (dx * dw).sum() / (dx * dx).sum()
                    w = w - (w[good].mean() - slope * x[good].mean()) - slope * x
                good = good & has_y
                if not good.any():
                    continue
                a, b = ranks_of(w[good]), ranks_of(y[good])
            n, aa, bb = len(a), (a * a).sum(), (b * b).sum()
            out.append((seed, None if n < least else 0.0 if aa <= 1e-9 * n or bb <= 1e-9 * n else float((a * b).sum() / (np.sqrt(aa) * np.sqrt(bb)))))
        return pa.table({"seed": pa.array([s for s, _ in out], pa.int32()), key: pa.array([rows[key][0].as_py()] * len(out), rows.schema.field(key).type), "ic": pa.array([i for _, i in out], pa.float64())})

    return run


def confusion(df: DataFrame, keys: list[str], label: str, predicted: str) -> DataFrame:
    return df.groupBy(*keys, label, predicted).agg(F.count("*").alias("n"))


def accuracy_f1(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """accuracy and macro F1 over the classes that occur as a label or a prediction."""
    cells = confusion(df, [], label, predicted)
    cls = cells.select(F.explode(F.array(F.struct(F.col(label).alias("c"), F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col(predicted).alias("c"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")))).alias("e")).select("e.*")
    by = cls.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p"))
    return by.agg((F.sum("tp") / F.sum("t")).alias("accuracy"), F.avg(2 * F.col("tp") / (F.col("t") + F.col("p"))).alias("macro_f1"))
