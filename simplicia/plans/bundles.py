"""Queries of ingestion filters and of whole feature bundles: what other queries give one by one, joined by entity,
window or sample, and compared by method."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from simplicia.functions import scalars
from simplicia.operators import classic, diagrams, embedding, evaluate, generators, homology, panel, ranks, shape
from simplicia.plans import series, shapes
from simplicia.plans.evaluation import seed_sql
from simplicia.plans.panels import DAILY, daily, read
from simplicia.plans.series import EMB, ORDER, S, arrays, events, indexed, rounded, takens
from simplicia.plans.shapes import TREE, h0
from simplicia.sources import readers
from simplicia.sources.cache import FeatureCache
from simplicia.sources.store import shared_dir, stacked, stored

union = lambda parts: reduce(DataFrame.unionByName, parts)
joined = lambda parts: reduce(lambda x, y: x.join(y, "user_id"), parts)


def bar_codes(spark, sf_dir):
    """Events and mean value of each bar of the day."""
    e = events(spark, sf_dir).withColumn("bar", scalars.bar_code(F.date_format("ts", "yyyyMMddHHmmss")))
    return rounded(e.groupBy("bar").agg(F.count("*").alias("n"), F.avg("x").alias("mean")), "bar", "n")


def any_present(spark, sf_dir):
    """Days of a supplier with a bought or a returned quantity, out of all."""
    d = daily(spark, sf_dir)
    some = panel.any_present(d, "buy", "sell").groupBy("supp").agg(F.count("*").alias("n_any"))
    full = panel.complete(d, "buy", "sell", "price").groupBy("supp").agg(F.count("*").alias("n_all"))
    return some.join(full, "supp", "left").select("supp", "n_any", F.coalesce("n_all", F.lit(0)).alias("n_all"))


def coverage(spark, sf_dir):
    return rounded(panel.column_coverage(daily(spark, sf_dir), ["buy", "sell", "other", "price"], 0.3), "column", "kept")


def imputed(spark, sf_dir):
    return rounded(panel.median_imputed(daily(spark, sf_dir), "buy", "sell").select("supp", F.col("day").cast("string").alias("day"), "buy", "sell"), "supp", "day")


def restricted(spark, sf_dir):
    """Lines of the first suppliers of the table from a date on."""
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_suppkey <= 5").select(F.col("s_suppkey").alias("l_suppkey"))
    li = readers.restricted_scan(spark, f"{sf_dir}/lineitem.parquet", ["l_suppkey", "l_shipdate", "l_quantity"], keys, "l_suppkey", "l_shipdate", "1995-01-01")
    return rounded(li.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")), "l_suppkey", "n")


def restricted_in_batches(spark, sf_dir):
    """The rows of restricted_scan, read a few files at a time into a sink of their own."""
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_suppkey <= 5").select(F.col("s_suppkey").alias("l_suppkey"))
    at = f"{shared_dir(spark).rstrip('/')}/scan-{uuid.uuid4().hex}"
    li = readers.batched_scan(spark, f"{sf_dir}/lineitem.parquet", f"{at}/rows", f"{at}/done", ["l_suppkey", "l_shipdate", "l_quantity"], keys, "l_suppkey", "l_shipdate", "1995-01-01", files=4)
    return rounded(li.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")), "l_suppkey", "n")


def cached_bars(spark, sf_dir):
    """Summaries of the H0 bars of every cloud by way of a feature store: half of the clouds first, then all of them, of which
    only the other half is computed."""
    clouds = shapes.clouds(spark, sf_dir)
    store = FeatureCache(spark, f"{shared_dir(spark).rstrip('/')}/features-{uuid.uuid4().hex}", "n_bars long, longest double")

    def bars(new):
        got = homology.persistence(new, 0, keep=("content",))
        finite = F.filter("bars", lambda b: b["death"] < float("inf"))
        return got.select("content", F.size(finite).cast("long").alias("n_bars"), F.array_max(F.transform(finite, lambda b: b["death"])).alias("longest"))

    store.materialise(clouds.filter("user_id % 2 = 0"), ["points"], bars)
    return rounded(store.materialise(clouds, ["points"], bars).drop("points"), "user_id", "n_bars")


def density(spark, sf_dir):
    """Density of the values of each event type, mapped to [-1, 1] and clipped, in ten bins."""
    e = events(spark, sf_dir).select("event_type", scalars.clip(F.col("x") / 50 - 1, -1.0, 1.0).alias("v"))
    b = e.select("event_type", scalars.bin_of(F.col("v"), F.lit(-1.0), F.lit(1.0), 10).alias("bin")).groupBy("event_type", "bin").agg(F.count("*").alias("n"))
    all_ = b.groupBy("event_type").agg(F.sum("n").alias("all"))
    return b.join(all_, "event_type").select("event_type", "bin", F.round(F.col("n") / (F.col("all") * 0.2), 6).alias("density"))


def histogram_2d(spark, sf_dir):
    """Counts in 20 x 20 equal bins of a value and the next one of its user."""
    p = embedding.takens(indexed(spark, sf_dir), "user_id", "x", 2, 1)
    ends = p.agg(F.min("x0").alias("a0"), F.max("x0").alias("b0"), F.min("x1").alias("a1"), F.max("x1").alias("b1"))
    cell = lambda c, k: scalars.bin_of(F.col(c), F.col(f"a{k}"), F.col(f"b{k}"), 20)
    return p.join(F.broadcast(ends)).select(cell("x0", 0).alias("bin_0"), cell("x1", 1).alias("bin_1")).groupBy("bin_0", "bin_1").agg(F.count("*").alias("n"))


_CELL = "CASE WHEN max({c}) OVER () > min({c}) OVER () THEN least(floor(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 20), 19) ELSE 0 END::INT"
HISTOGRAM_2D_SQL = f"""
WITH {S}, p AS (SELECT x AS x0, lead(x) OVER (PARTITION BY user_id ORDER BY i) AS x1 FROM s), q AS (SELECT * FROM p WHERE x1 IS NOT NULL),
c AS (SELECT {_CELL.format(c='x0')} AS bin_0, {_CELL.format(c='x1')} AS bin_1 FROM q) SELECT bin_0, bin_1, count(*) AS n FROM c GROUP BY 1, 2"""


def per_channel_unit(spark, sf_dir):
    return rounded(embedding.per_channel_unit(takens(spark, sf_dir), "user_id", "x0", "x1", "x2"), "user_id", "i")


_Z = ", ".join(f"(x{k} - avg(x{k}) OVER w) / CASE WHEN stddev_pop(x{k}) OVER w > 0 THEN stddev_pop(x{k}) OVER w ELSE 1 END AS x{k}" for k in range(3))
PER_CHANNEL_SQL = f"""
WITH {EMB}, z AS (SELECT user_id, i, {_Z} FROM e WINDOW w AS (PARTITION BY user_id)), c AS (SELECT user_id, i, x0 - avg(x0) OVER w AS x0, x1 - avg(x1) OVER w AS x1, x2 - avg(x2) OVER w AS x2 FROM z WINDOW w AS (PARTITION BY user_id)),
r AS (SELECT *, max(sqrt(x0 * x0 + x1 * x1 + x2 * x2)) OVER (PARTITION BY user_id) AS r FROM c)
SELECT user_id, i, round(x0 / CASE WHEN r > 0 THEN r ELSE 1 END, 6) AS x0, round(x1 / CASE WHEN r > 0 THEN r ELSE 1 END, 6) AS x1, round(x2 / CASE WHEN r > 0 THEN r ELSE 1 END, 6) AS x2 FROM r"""


def cloud_status(spark, sf_dir):
    """Clouds of the first rows of each series, some of them too small."""
    few = takens(spark, sf_dir).filter("i < 1 + pmod(user_id, 5)")
    return embedding.cloud_status(few, "user_id", "x0", "x1", "x2")


def rotated(spark, sf_dir):
    """Distances of points from the mean of their cloud after a random rotation, which keeps them."""
    turned = generators.rotated(takens(spark, sf_dir), ["x0", "x1", "x2"], 7)
    w = Window.partitionBy("user_id")
    square = sum(((F.col(c) - F.avg(c).over(w)) ** 2 for c in ("x0", "x1", "x2")), start=F.lit(0.0))
    return turned.select("user_id", "i", F.round(F.sqrt(square), 6).alias("radius"))


def scaled(spark, sf_dir):
    """Prices and sizes of parts as z-scores by population moments."""
    from simplicia.operators import learn

    p = read(spark, sf_dir, "part", "p_partkey", "p_retailprice", "p_size").withColumn("p_size", F.col("p_size").cast("double"))
    return rounded(learn.scaled_population(p, ["p_retailprice", "p_size"]), "p_partkey")


METHODS = ("top_k", "betti", "landscape")


def vectors(spark, sf_dir):
    """The H0 diagram of every cloud as a vector, by each method."""
    d = h0(spark, sf_dir)
    return union([rounded(diagrams.vectors(d, "user_id", m), "user_id", "pos").withColumn("method", F.lit(m)) for m in METHODS])


_VECTORS = f"""(SELECT user_id, 'top_k' AS method, rank - 1 AS pos, persistence AS v FROM ({shapes.QUERIES['h0_topk'][1]})
UNION ALL SELECT user_id, 'betti', b, betti::DOUBLE FROM ({shapes.QUERIES['h0_betti_curve'][1]})
UNION ALL SELECT user_id, 'landscape', level * 20 + b, value FROM ({shapes.LANDSCAPE_SQL}))"""


def compare_vectors(spark, sf_dir):
    """What the methods give: numbers of a vector, clouds, mean sum of a vector."""
    v = stacked([diagrams.vectors(h0(spark, sf_dir), "user_id", m).withColumn("method", F.lit(m)) for m in METHODS], "method", "user_id")
    each = v.groupBy("method", "user_id").agg(F.count("*").alias("dims"), F.sum(F.round("v", 6)).alias("total"))
    return each.groupBy("method").agg(F.max("dims").alias("dims"), F.count("*").alias("clouds"), F.round(F.avg("total"), 3).alias("mean_total"))


def component_vectors(spark, sf_dir):
    """The 17 numbers of loop_vectors, of the components instead."""
    v = shape.loop_vector(shapes.persisted(spark, sf_dir), "user_id", 0)
    return v.select("user_id", F.posexplode("vector").alias("pos", "v")).select("user_id", "pos", F.round("v", 6).alias("v"))


COMPONENTS_SQL = f"""
WITH {TREE}, p AS (SELECT user_id, list(death ORDER BY death DESC) AS p FROM h0 GROUP BY 1),
v AS (SELECT user_id, list_concat([len(list_filter(p, lambda x: x > 0.3 * p[1]))::DOUBLE, len(p)::DOUBLE, p[1], p[1] / (list_avg(p) + 1e-9)], list_transform(range(1, 6), lambda k: coalesce(p[k], 0.0)),
  list_transform(range(0, 5), lambda k: len(list_filter(p, lambda x: x > p[1] * (0.1 + 0.2 * k)))::DOUBLE), list_transform(range(1, 4), lambda k: coalesce(p[k], 0.0) / (p[1] + 1e-9))) AS v FROM p)
SELECT user_id, k - 1 AS pos, round(v[k], 6) AS v FROM v, unnest(range(1, 18)) AS u(k)"""


def selection_counts(spark, sf_dir):
    """Bars that three ways of choosing leave at ten thresholds, and how far the entropy moves."""
    d = h0(spark, sf_dir)
    total = diagrams.summary(d, "user_id").select("user_id", F.col("entropy").alias("all"))
    chosen = diagrams.selections(d, [5.0 + 5 * k for k in range(10)])
    s = diagrams.summary(chosen.withColumn("k", F.struct("user_id", "method", "threshold")), "k").select("k.*", "n_bars", "entropy").join(total, "user_id")
    return s.select("user_id", "method", "threshold", "n_bars", F.round(F.abs(F.col("entropy") - F.col("all")), 6).alias("entropy_gap"))


_ENTROPY = "SELECT {k}, count(*) AS n_bars, -sum(death / tot * ln(death / tot)) AS entropy FROM (SELECT *, sum(death) OVER (PARTITION BY {k}) AS tot FROM {t}) GROUP BY {k}"
SELECTION_SQL = f"""
WITH {TREE}, t AS (SELECT user_id, death, 5.0::DOUBLE + 5 * k AS threshold FROM h0, unnest(range(0, 10)) AS u(k)),
k AS (SELECT 'topo' AS method, * FROM t WHERE 1 / (1 + exp(least(700, -50.0 * (death - threshold)))) > 0.5 UNION ALL SELECT 'hard', * FROM t WHERE death > threshold UNION ALL SELECT 'stat', * FROM t WHERE death / sqrt(2) > threshold),
en AS ({_ENTROPY.format(k='user_id, method, threshold', t='k')}), a AS ({_ENTROPY.format(k='user_id', t='h0')})
SELECT en.user_id, method, threshold, en.n_bars, round(abs(en.entropy - a.entropy), 6) AS entropy_gap FROM en JOIN a USING (user_id)"""


def classical_bundle(spark, sf_dir):
    """The classical vector of a series, all but the share of its first singular component."""
    a, s = arrays(spark, sf_dir), indexed(spark, sf_dir)
    return rounded(joined([embedding.tau_autocorrelation(a).select("user_id", "tau_ac"), classic.spectrum_features(classic.periodogram(a), "user_id").select("user_id", "peak", "period"), classic.sample_entropy(a, "user_id"), classic.hurst(s, "user_id"), classic.moments(s, "user_id", "x").select("user_id", "sd")]), "user_id", "tau_ac")


CLASSICAL_SQL = f"SELECT user_id, tau_ac, peak, period, sample_entropy, hurst, sd FROM ({series.TAU_AC_SQL}) JOIN ({series.SPECTRUM_SQL}) USING (user_id) JOIN ({series.SAMPEN_SQL}) USING (user_id) JOIN ({series.HURST_SQL}) USING (user_id) JOIN ({series.MOMENTS_SQL}) USING (user_id)"


def sample_bundle(spark, sf_dir):
    """One row for each series: predictability, false neighbours, criteria of the H0 diagram, moments."""
    return joined([series.knn_r2(spark, sf_dir), series.fnn(spark, sf_dir), shapes.flagship(spark, sf_dir), series.moments(spark, sf_dir)])


SAMPLE_SQL = f"SELECT * FROM ({series.R2_SQL}) JOIN ({series.FNN_SQL}) USING (user_id) JOIN ({shapes.FLAGSHIP_SQL}) USING (user_id) JOIN ({series.MOMENTS_SQL}) USING (user_id)"


def entity_bundle(spark, sf_dir):
    """Entities with at least 60 rows: their rows, H0 criteria, moments and Hurst exponent."""
    long = arrays(spark, sf_dir).filter("n >= 60").select("user_id", "n")
    criteria = rounded(diagrams.summary(h0(spark, sf_dir), "user_id"), "user_id", "n_bars", "ring_01", "ring_03", "ring_05")
    return joined([long, criteria, series.moments(spark, sf_dir), series.hurst(spark, sf_dir)])


ENTITY_SQL = f"SELECT * FROM (WITH {S} SELECT user_id, any_value(n) AS n FROM s WHERE n >= 60 GROUP BY 1) JOIN ({shapes.CRITERIA_SQL}) USING (user_id) JOIN ({series.MOMENTS_SQL}) USING (user_id) JOIN ({series.HURST_SQL}) USING (user_id)"


def window_bundle(spark, sf_dir):
    """Every sliding window of two channels: mean, sd, range and net change of each; a channel without spread in the window
    is invalid and has nulls."""
    e = events(spark, sf_dir).withColumn("y", F.hour("ts").cast("double"))
    w = panel.sliding_windows(embedding.as_arrays(e, "user_id", ORDER, "x", "y"), "user_id", 24, 8, 5, 5, ["x", "y"])
    long = w.select("user_id", "start", F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in ("x", "y")))).alias("c")).select("user_id", "start", "c.channel", "c.v")
    mean = scalars.total(F.col("v")) / 24
    long = long.withColumn("sd", F.sqrt(F.greatest(scalars.total(F.transform("v", lambda x: (x - mean) * (x - mean))) / 24, F.lit(0.0))))
    ok = lambda c: F.when(F.col("sd") > 1e-9, c)
    return long.select("user_id", "start", "channel", *(F.round(ok(c), 6).alias(n) for n, c in (("mean", mean), ("sd", F.col("sd")), ("range", F.array_max("v") - F.array_min("v")), ("change", F.get("v", F.lit(23)) - F.get("v", F.lit(0))))))


WINDOW_SQL = """
WITH s AS (SELECT user_id, value AS x, hour(ts)::DOUBLE AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
w AS (SELECT DISTINCT user_id, st FROM s, unnest(range(0, (SELECT max(n) FROM s), 8)) AS u(st) WHERE st + 29 <= n AND n >= 34),
l AS (SELECT w.user_id, w.st AS start, s.i, c.channel, CASE WHEN c.channel = 'x' THEN x ELSE y END AS v FROM w JOIN s ON s.user_id = w.user_id AND s.i BETWEEN st AND st + 23, unnest(['x', 'y']) AS c(channel)),
g AS (SELECT user_id, start, channel, avg(v) AS mean, stddev_pop(v) AS sd, max(v) - min(v) AS r, arg_max(v, i) - arg_min(v, i) AS d FROM l GROUP BY 1, 2, 3)
SELECT user_id, start, channel, CASE WHEN sd > 1e-9 THEN round(mean, 6) END AS mean, CASE WHEN sd > 1e-9 THEN round(sd, 6) END AS sd, CASE WHEN sd > 1e-9 THEN round(r, 6) END AS range, CASE WHEN sd > 1e-9 THEN round(d, 6) END AS change FROM g"""

WIN, STRIDE = 52, 8
CHANNELS = ("x", "y")


def window_vectors(spark, sf_dir):
    """The whole vector of every sliding window and channel: moments, criteria of the H0 diagram of the window's delay
    embedding, and the classical vector. A window's distances are made where its diagram is, from its own values. A channel without spread in a window is invalid and has nulls."""
    e = events(spark, sf_dir).withColumn("y", F.hour("ts").cast("double"))
    both = embedding.indexed(e, "user_id", ORDER, *CHANNELS)
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("channel"), F.col(c).alias("v")) for k, c in enumerate(CHANNELS)))).alias("c")
    # a series for each user and channel
    s = stored(both.select("user_id", "i", cells).select((F.col("user_id") * 2 + F.col("c.channel")).alias("series"), "i", F.col("c.v").alias("x")), "channels")
    name = (F.col("series") * 100_000 + F.col("start")).alias("w")
    rows = panel.window_rows(s, "series", ["x"], WIN, STRIDE).select(name, "series", "start", F.col("at").cast("int").alias("i"), "x")
    spread = rows.groupBy("w", "series", "start").agg(F.stddev_pop("x").alias("_sd"))
    windows = stored(spread, "windows")
    rows = stored(rows.drop("series", "start").join(windows.filter("_sd > 1e-9").select("w"), "w"), "window-rows")
    a = stored(embedding.as_arrays(rows, "w", ["i"], "x"), "window-arrays")
    got = homology.persistence(a.select("w", embedding.takens_points(F.col("x"), series.M, series.TAU).alias("points")), 0, keep=("w",))
    criteria = diagrams.summary(homology.diagram(got, "w", dim=0), "w")
    parts = [
        classic.moments(rows, "w", "x"), classic.difference_moments(rows, "w", "x"), embedding.tau_autocorrelation(a).select("w", "tau_ac"),
        classic.spectrum_features(classic.periodogram(a), "w").select("w", "peak", "period"), classic.sample_entropy(a, "w"), classic.hurst(rows, "w"), criteria,
    ]
    out = reduce(lambda x, y: x.join(y, "w", "left"), [windows.drop("_sd"), *parts])
    channel = F.element_at(F.array(*map(F.lit, CHANNELS)), (F.pmod("series", F.lit(2)) + 1).cast("int"))
    out = out.withColumns({"user_id": F.floor(F.col("series") / 2), "channel": channel}).drop("w", "series")
    return rounded(out, "user_id", "start", "channel", "n_bars", "ring_01", "ring_03", "ring_05", "tau_ac")


#: The windows as series of their own, under the name the other queries' SQL gives a series.
_WINDOWS = f"""ev AS (SELECT user_id, value AS x, hour(ts)::DOUBLE AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
ws AS (SELECT DISTINCT user_id, st, channel FROM ev, unnest(range(0, (SELECT max(n) FROM ev), {STRIDE})) AS u(st), unnest([0, 1]) AS c(channel) WHERE st + {WIN} <= n),
wr AS (SELECT (ws.user_id * 2 + channel) * 100000 + st AS w, ws.user_id AS owner, st, channel, ev.i - st AS i, CASE WHEN channel = 0 THEN x ELSE y END AS x FROM ws JOIN ev ON ev.user_id = ws.user_id AND ev.i BETWEEN st AND st + {WIN - 1}),
s AS (SELECT w AS user_id, x, i, {WIN} AS n FROM wr QUALIFY stddev_pop(x) OVER (PARTITION BY w) > 1e-9)"""
_of = lambda sql: sql.replace(S, _WINDOWS)
WINDOW_VECTORS_SQL = f"""
WITH {_WINDOWS}, names AS (SELECT DISTINCT w, owner, st, channel FROM wr)
SELECT owner AS user_id, st AS start, CASE WHEN channel = 0 THEN 'x' ELSE 'y' END AS channel, m.* EXCLUDE (user_id), t.* EXCLUDE (user_id), sp.peak, sp.period, en.* EXCLUDE (user_id), hu.* EXCLUDE (user_id), cr.* EXCLUDE (user_id)
FROM names LEFT JOIN ({_of(series.MOMENTS_SQL)}) m ON m.user_id = w LEFT JOIN ({_of(series.TAU_AC_SQL)}) t ON t.user_id = w LEFT JOIN ({_of(series.SPECTRUM_SQL)}) sp ON sp.user_id = w
LEFT JOIN ({_of(series.SAMPEN_SQL)}) en ON en.user_id = w LEFT JOIN ({_of(series.HURST_SQL)}) hu ON hu.user_id = w LEFT JOIN ({_of(shapes.CRITERIA_SQL)}) cr ON cr.user_id = w"""

SYSTEMS = {"topology": ("max_pers", "ring_03", "entropy"), "moments": ("mean", "skew", "kurtosis"), "dynamics": ("diff_mean", "diff_sd", "hurst")}


def cell_comparison(spark, sf_dir):
    """Nine methods in three cells of series: how well each tells volatile series from the others (area under the curve,
    from a half up), and the best method of a cell with ties by name."""
    parts = joined([shapes.flagship(spark, sf_dir), series.moments(spark, sf_dir), series.hurst(spark, sf_dir)])
    parts = stored(parts, "parts")
    cut = ranks.column_quantiles(parts, ["sd"], 0.5).select(F.col("sd").alias("cut"))
    cells = parts.join(F.broadcast(cut)).withColumns({"cell": F.pmod("user_id", F.lit(3)).cast("int"), "volatile": (F.col("sd") > F.col("cut")).cast("int")})
    long = evaluate.long_features(cells, ["cell", "volatile"], [m for s in SYSTEMS.values() for m in s])
    scored = evaluate.auc(long, ["cell", "feature"], "x", "volatile").filter("auc IS NOT NULL").select("cell", F.col("feature").alias("method"), F.round(F.greatest("auc", 1 - F.col("auc")), 6).alias("auc"))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("auc"), "method"))
    system = F.coalesce(*(F.when(F.col("method").isin(*m), F.lit(s)) for s, m in SYSTEMS.items()))
    return scored.select("cell", "method", system.alias("system"), "auc", (rank == 1).cast("int").alias("best"))


_NAMES = [m for s in SYSTEMS.values() for m in s]
_SYSTEM = "CASE " + " ".join(f"WHEN method IN ({', '.join(map(repr, m))}) THEN '{s}'" for s, m in SYSTEMS.items()) + " END"
CELL_SQL = f"""
WITH f AS (SELECT * FROM ({shapes.FLAGSHIP_SQL}) JOIN ({series.MOMENTS_SQL}) USING (user_id) JOIN ({series.HURST_SQL}) USING (user_id)),
l AS (SELECT user_id % 3 AS cell, volatile, method, v FROM (SELECT user_id, (sd > (SELECT quantile_cont(sd, 0.5) FROM f)) AS volatile, {', '.join(f'{m}::DOUBLE AS {m}' for m in _NAMES)} FROM f) UNPIVOT (v FOR method IN ({', '.join(_NAMES)}))),
r AS (SELECT *, rank() OVER (PARTITION BY cell, method ORDER BY v) + (count(*) OVER (PARTITION BY cell, method, v) - 1) / 2 AS r FROM l),
a AS (SELECT cell, method, count(*) FILTER (WHERE volatile) AS n1, count(*) FILTER (WHERE NOT volatile) AS n0, sum(r) FILTER (WHERE volatile) AS s FROM r GROUP BY 1, 2),
b AS (SELECT cell, method, (s - n1 * (n1 + 1) / 2) / (n1 * n0) AS auc FROM a WHERE n1 > 0 AND n0 > 0 AND n1 + n0 >= 6), c AS (SELECT cell, method, round(greatest(auc, 1 - auc), 6) AS auc FROM b)
SELECT cell, method, {_SYSTEM} AS system, auc, (row_number() OVER (PARTITION BY cell ORDER BY auc DESC, method) = 1)::INT AS best FROM c"""

PAIRS_OF = {f"{s}:{a}+{b}": (s, a, b) for s, m in SYSTEMS.items() for k, a in enumerate(m) for b in m[k + 1 :]}


def method_comparison(spark, sf_dir):
    """Nine methods of three systems, each a set of features, in three cells of series: out-of-fold scores of a linear fit to
    whether a series is volatile, their area under the curve, and the best method of a cell with ties by name."""
    parts = stored(joined([shapes.flagship(spark, sf_dir), series.moments(spark, sf_dir), series.hurst(spark, sf_dir)]), "parts")
    cut = ranks.column_quantiles(parts, ["sd"], 0.5).select(F.col("sd").alias("cut"))
    cells = parts.join(F.broadcast(cut)).withColumns({"cell": F.pmod("user_id", F.lit(3)).cast("int"), "y": (F.col("sd") > F.col("cut")).cast("int"), "fold": evaluate.group_fold(F.col("user_id"), 3, seed=5)})
    sets = F.array(*(F.struct(F.lit(name).alias("method"), F.lit(s).alias("system"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")) for name, (s, a, b) in PAIRS_OF.items()))
    long = cells.select("user_id", "cell", "y", "fold", F.explode(sets).alias("m")).select("user_id", "cell", "y", "fold", "m.*")
    scored = evaluate.fold_scores(long, ["cell", "method", "system"], "fold", "y", "a", "b").withColumn("score", F.round("score", 9))
    a = evaluate.auc(scored, ["cell", "method", "system"], "score", "y").filter("auc IS NOT NULL").withColumn("auc", F.round("auc", 6))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("auc"), "method"))
    return a.select("cell", "method", "system", "auc", (rank == 1).cast("int").alias("best"))


_SETS = " UNION ALL ".join(f"SELECT user_id, cell, y, fold, '{name}' AS method, '{s}' AS system, {a}::DOUBLE AS a, {b}::DOUBLE AS b FROM c" for name, (s, a, b) in PAIRS_OF.items())
METHOD_SQL = f"""
WITH f AS (SELECT * FROM ({shapes.FLAGSHIP_SQL}) JOIN ({series.MOMENTS_SQL}) USING (user_id) JOIN ({series.HURST_SQL}) USING (user_id)),
c AS (SELECT *, user_id % 3 AS cell, (sd > (SELECT quantile_cont(sd, 0.5) FROM f))::INT AS y, {seed_sql("'5'", 'user_id')} % 3 AS fold FROM f), l AS ({_SETS}),
t AS (SELECT u.cell, u.method, u.fold, covar_pop(o.a, o.a) AS aa, covar_pop(o.a, o.b) AS ab, covar_pop(o.b, o.b) AS bb, covar_pop(o.a, o.y) AS ay, covar_pop(o.b, o.y) AS by_, avg(o.a) AS ma, avg(o.b) AS mb, avg(o.y) AS my
  FROM (SELECT DISTINCT cell, method, fold FROM l) u JOIN l o ON o.cell = u.cell AND o.method = u.method AND o.fold <> u.fold GROUP BY 1, 2, 3 HAVING count(*) > 2),
s AS (SELECT l.*, round(my + (ay * bb - by_ * ab) / d * (a - ma) + (by_ * aa - ay * ab) / d * (b - mb), 9) AS score FROM l JOIN (SELECT *, CASE WHEN aa * bb - ab * ab > 1e-9 * aa * bb THEN aa * bb - ab * ab END AS d FROM t) USING (cell, method, fold)),
r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY cell, method, score) - 1) / 2 AS r FROM s WHERE score IS NOT NULL WINDOW w AS (PARTITION BY cell, method ORDER BY score)),
g AS (SELECT cell, method, system, sum(y) AS n1, count(*) - sum(y) AS n0, sum(r) FILTER (WHERE y = 1) AS s FROM r GROUP BY 1, 2, 3),
x AS (SELECT cell, method, system, round((s - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc FROM g WHERE n1 > 0 AND n0 > 0 AND n1 + n0 >= 6)
SELECT cell, method, system, auc, (row_number() OVER (PARTITION BY cell ORDER BY auc DESC, method) = 1)::INT AS best FROM x"""

_COVER = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", avg(({c} IS NOT NULL)::INT) AS c FROM daily" for c in ("buy", "sell", "other", "price"))
QUERIES = {
    "bar_codes": (bar_codes, "SELECT strftime(ts, '%H%M') AS bar, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1"),
    "any_present": (any_present, f"WITH {DAILY} SELECT supp, count(*) AS n_any, count(*) FILTER (WHERE buy IS NOT NULL AND sell IS NOT NULL AND price IS NOT NULL) AS n_all FROM daily WHERE coalesce(buy, sell) IS NOT NULL GROUP BY 1"),
    "column_coverage": (coverage, f"WITH {DAILY}, c AS ({_COVER}) SELECT \"column\", round(c, 6) AS coverage, (c >= 0.3)::INT AS kept FROM c"),
    "median_imputed": (imputed, f"WITH {DAILY}, m AS (SELECT coalesce(median(buy), 0) AS b, coalesce(median(sell), 0) AS s FROM daily) SELECT supp, day::VARCHAR AS day, round(coalesce(buy, b), 6) AS buy, round(coalesce(sell, s), 6) AS sell FROM daily, m"),
    "restricted_scan": (restricted, "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem WHERE l_shipdate >= DATE '1995-01-01' AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey <= 5) GROUP BY 1"),
    "batched_scan": (restricted_in_batches, "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem WHERE l_shipdate >= DATE '1995-01-01' AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey <= 5) GROUP BY 1"),
    "cached_bars": (cached_bars, f"WITH {TREE} SELECT user_id, count(*) AS n_bars, round(max(death), 6) AS longest FROM h0 GROUP BY 1"),
    "density": (density, "WITH b AS (SELECT event_type, least(floor((least(greatest(value / 50 - 1, -1), 1) + 1) / 2 * 10), 9)::INT AS bin FROM events) SELECT event_type, bin, round(count(*) / (sum(count(*)) OVER (PARTITION BY event_type) * 0.2), 6) AS density FROM b GROUP BY 1, 2"),
    "histogram_2d": (histogram_2d, HISTOGRAM_2D_SQL),
    "per_channel_unit": (per_channel_unit, PER_CHANNEL_SQL),
    "cloud_status": (cloud_status, f"WITH {EMB}, c AS (SELECT DISTINCT user_id, x0, x1, x2 FROM e WHERE i < 1 + user_id % 5) SELECT user_id, count(*) AS n_points, CASE WHEN count(*) >= 3 THEN 'ok' ELSE 'too few points' END AS status FROM c GROUP BY 1"),
    "rotated": (rotated, f"WITH {EMB} SELECT user_id, i, round(sqrt((x0 - avg(x0) OVER w) ** 2 + (x1 - avg(x1) OVER w) ** 2 + (x2 - avg(x2) OVER w) ** 2), 6) AS radius FROM e WINDOW w AS (PARTITION BY user_id)"),
    "scaled_population": (scaled, "SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size FROM part"),
    "h0_vectors": (vectors, f"SELECT user_id, pos, round(v, 6) AS v, method FROM {_VECTORS}"),
    "compare_vectors": (compare_vectors, f"SELECT method, max(dims) AS dims, count(*) AS clouds, round(avg(total), 3) AS mean_total FROM (SELECT method, user_id, count(*) AS dims, sum(v) AS total FROM {_VECTORS} GROUP BY 1, 2) GROUP BY 1"),
    "component_vectors": (component_vectors, COMPONENTS_SQL),
    "selection_counts": (selection_counts, SELECTION_SQL),
    "classical_bundle": (classical_bundle, CLASSICAL_SQL),
    "sample_bundle": (sample_bundle, SAMPLE_SQL),
    "entity_bundle": (entity_bundle, ENTITY_SQL),
    "window_bundle": (window_bundle, WINDOW_SQL),
    "window_vectors": (window_vectors, WINDOW_VECTORS_SQL),
    "cell_comparison": (cell_comparison, CELL_SQL),
    "method_comparison": (method_comparison, METHOD_SQL),
}
