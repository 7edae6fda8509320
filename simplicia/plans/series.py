"""Queries over event series: one series for each user, ordered by (ts, event_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplicia.operators import classic, embedding, homology, neighbours, ranks
from simplicia.sources.store import stored

M, TAU = 3, 4
ORDER = ["ts", "event_id"]
POINT = ["x0", "x1", "x2"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", F.col("value").alias("x"), "event_type")


def indexed(spark, sf_dir) -> DataFrame:
    return embedding.indexed(events(spark, sf_dir), "user_id", ORDER, "x")


def arrays(spark, sf_dir) -> DataFrame:
    return embedding.as_arrays(events(spark, sf_dir), "user_id", ORDER, "x")


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(F.round(c, 6).alias(c) for c in df.columns if c not in keys))


S = "s AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
EMB = f"{S}, e AS (SELECT a.user_id, a.i, a.x AS x0, b.x AS x1, c.x AS x2 FROM s a JOIN s b ON a.user_id = b.user_id AND b.i = a.i + 4 JOIN s c ON a.user_id = c.user_id AND c.i = a.i + 8)"
PAIRS = f"{EMB}, d AS (SELECT a.user_id, a.i, b.i AS j, sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2) AS d FROM e a JOIN e b ON a.user_id = b.user_id AND a.i <> b.i)"


def takens(spark, sf_dir):
    return embedding.takens(indexed(spark, sf_dir), "user_id", "x", M, TAU)


def pairs(spark, sf_dir):
    return homology.pairwise(takens(spark, sf_dir), "user_id", "i", POINT)


def dtm_of(spark, sf_dir):
    return homology.dtm_weights(stored(takens(spark, sf_dir), "cloud"), "user_id", "i", POINT)


def multichannel(spark, sf_dir):
    df = embedding.indexed(events(spark, sf_dir).withColumn("y", F.hour("ts").cast("double")), "user_id", ORDER, "x", "y")
    return rounded(embedding.multichannel(df, "user_id", ["x", "y"], 2, 3), "user_id", "i")


MULTI_SQL = """
WITH s AS (SELECT user_id, value AS x, hour(ts)::DOUBLE AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
e AS (SELECT a.user_id, a.i, a.x AS x_0, b.x AS x_1, a.y AS y_0, b.y AS y_1 FROM s a JOIN s b ON a.user_id = b.user_id AND b.i = a.i + 3)
SELECT user_id, i, round((x_0 - avg(x_0) OVER w) / CASE WHEN stddev_pop(x_0) OVER w > 0 THEN stddev_pop(x_0) OVER w ELSE 1 END, 6) AS x_0,
  round((x_1 - avg(x_1) OVER w) / CASE WHEN stddev_pop(x_1) OVER w > 0 THEN stddev_pop(x_1) OVER w ELSE 1 END, 6) AS x_1,
  round((y_0 - avg(y_0) OVER w) / CASE WHEN stddev_pop(y_0) OVER w > 0 THEN stddev_pop(y_0) OVER w ELSE 1 END, 6) AS y_0,
  round((y_1 - avg(y_1) OVER w) / CASE WHEN stddev_pop(y_1) OVER w > 0 THEN stddev_pop(y_1) OVER w ELSE 1 END, 6) AS y_1
FROM e WINDOW w AS (PARTITION BY user_id)"""

UNIT_SQL = f"""
WITH {EMB}, c AS (SELECT user_id, i, x0 - avg(x0) OVER w AS x0, x1 - avg(x1) OVER w AS x1, x2 - avg(x2) OVER w AS x2 FROM e WINDOW w AS (PARTITION BY user_id)),
r AS (SELECT *, max(sqrt(x0 * x0 + x1 * x1 + x2 * x2)) OVER (PARTITION BY user_id) AS r FROM c)
SELECT user_id, i, round(x0 / CASE WHEN r > 0 THEN r ELSE 1 END, 6) AS x0, round(x1 / CASE WHEN r > 0 THEN r ELSE 1 END, 6) AS x1, round(x2 / CASE WHEN r > 0 THEN r ELSE 1 END, 6) AS x2 FROM r"""

ZSCORE_SQL = f"""
WITH {EMB} SELECT user_id, i, round((x0 - avg(x0) OVER w) / stddev_pop(x0) OVER w, 6) AS x0, round((x1 - avg(x1) OVER w) / stddev_pop(x1) OVER w, 6) AS x1,
  round((x2 - avg(x2) OVER w) / stddev_pop(x2) OVER w, 6) AS x2 FROM e WINDOW w AS (PARTITION BY user_id)"""

TAU_AC_SQL = f"""
WITH {S}, c AS (SELECT user_id, i, n, x - avg(x) OVER (PARTITION BY user_id) AS c FROM s),
l AS (SELECT a.user_id, b.i - a.i AS lag, sum(a.c * b.c) AS v FROM c a JOIN c b ON a.user_id = b.user_id AND b.i > a.i AND b.i - a.i < a.n // 3 GROUP BY 1, 2)
SELECT u.user_id, coalesce(min(lag), 1) AS tau_ac FROM (SELECT DISTINCT user_id FROM s) u LEFT JOIN l ON l.user_id = u.user_id AND v <= 0 GROUP BY 1"""

_MI = """SELECT user_id, tau, sum(p * log2(p / (pa * pb + 1e-12))) AS mi FROM (
  SELECT DISTINCT user_id, tau, a, b, count(*) OVER (PARTITION BY user_id, tau, a, b) / count(*) OVER (PARTITION BY user_id, tau) AS p,
    count(*) OVER (PARTITION BY user_id, tau, a) / count(*) OVER (PARTITION BY user_id, tau) AS pa, count(*) OVER (PARTITION BY user_id, tau, b) / count(*) OVER (PARTITION BY user_id, tau) AS pb
  FROM (SELECT user_id, tau, least(floor((a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w) * 20), 19) AS a, least(floor((b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) * 20), 19) AS b
        FROM %s WINDOW w AS (PARTITION BY user_id, tau))) GROUP BY 1, 2"""
TAU_MI_SQL = f"""
WITH {S}, near AS (SELECT a.user_id, 0 AS tau, a.x AS a, b.x AS b FROM s a JOIN s b ON a.user_id = b.user_id AND b.i = a.i + 1),
far AS (SELECT a.user_id, t.tau, a.x AS a, b.x AS b FROM s a JOIN (SELECT unnest(range(1, 30)) AS tau) t ON t.tau < least(30, a.n // 3) JOIN s b ON a.user_id = b.user_id AND b.i = (a.i + t.tau) % a.n),
m1 AS ({_MI % 'near'}), mt AS ({_MI % 'far'})
SELECT m1.user_id, coalesce(min(mt.tau), 1) AS tau_mi FROM m1 LEFT JOIN mt ON mt.user_id = m1.user_id AND mt.mi < m1.mi GROUP BY 1"""


def moments(spark, sf_dir):
    s = indexed(spark, sf_dir)
    return rounded(classic.moments(s, "user_id", "x").join(classic.difference_moments(s, "user_id", "x"), "user_id"), "user_id")


MOMENTS_SQL = f"""
WITH {S}, c AS (SELECT *, x - avg(x) OVER (PARTITION BY user_id) AS c, x - lag(x) OVER (PARTITION BY user_id ORDER BY i) AS d FROM s)
SELECT user_id, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, round(avg(c * c * c) / (stddev_pop(x) + 1e-9) ** 3, 6) AS skew,
  round(avg(c ** 4) / (stddev_pop(x) + 1e-9) ** 4 - 3, 6) AS kurtosis, round(avg(d), 6) AS diff_mean, round(stddev_pop(d), 6) AS diff_sd FROM c GROUP BY 1"""


def autocorrelation(spark, sf_dir):
    a = arrays(spark, sf_dir).filter("n > 3")
    return a.select("user_id", F.posexplode(embedding.autocorrelations(F.col("x"), F.lit(3))).alias("lag", "ac")).select("user_id", (F.col("lag") + 1).alias("lag"), F.round("ac", 6).alias("ac"))


AC_SQL = f"""
WITH {S}, c AS (SELECT user_id, i, n, x - avg(x) OVER (PARTITION BY user_id) AS c FROM s), z AS (SELECT user_id, sum(c * c) AS z FROM c GROUP BY 1)
SELECT a.user_id, b.i - a.i AS lag, round(sum(a.c * b.c) / any_value(z), 6) AS ac FROM c a JOIN c b ON a.user_id = b.user_id AND b.i - a.i BETWEEN 1 AND 3 JOIN z ON z.user_id = a.user_id WHERE a.n > 3 GROUP BY 1, 2"""


def spectrum(spark, sf_dir):
    return rounded(classic.spectrum_features(classic.periodogram(arrays(spark, sf_dir)), "user_id"), "user_id")


SPECTRUM_SQL = f"""
WITH {S}, c AS (SELECT user_id, i, n, x - avg(x) OVER (PARTITION BY user_id) AS c FROM s),
p AS (SELECT user_id, n, k, sum(c * cos(2 * pi() * k * i / n)) ** 2 + sum(c * sin(2 * pi() * k * i / n)) ** 2 AS p FROM c, unnest(range(0, n // 2 + 1)) AS u(k) WHERE n >= 4 GROUP BY 1, 2, 3),
t AS (SELECT *, sum(p) OVER (PARTITION BY user_id) + 1e-9 AS tot, count(*) OVER (PARTITION BY user_id) // 3 AS band FROM p)
SELECT user_id, round(max(p) FILTER (WHERE k > 0) / (median(p) FILTER (WHERE k > 0) + 1e-12), 6) AS peak,
  round(any_value(n) / arg_max(k, p) FILTER (WHERE k > 0), 6) AS period, round(arg_max(k, p) / any_value(n), 6) AS dominant, round(max(p) / any_value(tot), 6) AS top_share,
  round(sum(p) FILTER (WHERE k // band = 0) / any_value(tot), 6) AS band_0, round(sum(p) FILTER (WHERE k // band = 1) / any_value(tot), 6) AS band_1, round(sum(p) FILTER (WHERE k // band = 2) / any_value(tot), 6) AS band_2
FROM t GROUP BY 1"""


def sample_entropy(spark, sf_dir):
    return rounded(classic.sample_entropy(arrays(spark, sf_dir), "user_id"), "user_id")


SAMPEN_SQL = f"""
WITH {S}, r AS (SELECT user_id, any_value(n) AS n, 0.2 * stddev_pop(x) AS r FROM s GROUP BY 1),
v2 AS (SELECT a.user_id, a.i, a.x AS a, b.x AS b FROM s a JOIN s b ON b.user_id = a.user_id AND b.i = a.i + 1),
v3 AS (SELECT v2.*, c.x AS c FROM v2 JOIN s c ON c.user_id = v2.user_id AND c.i = v2.i + 2),
m2 AS (SELECT p.user_id, count(*) / ((any_value(n) - 1) * (any_value(n) - 2)) AS m FROM v2 p JOIN v2 q ON p.user_id = q.user_id AND p.i <> q.i JOIN r ON r.user_id = p.user_id WHERE abs(p.a - q.a) <= r AND abs(p.b - q.b) <= r GROUP BY 1),
m3 AS (SELECT p.user_id, count(*) / ((any_value(n) - 2) * (any_value(n) - 3)) AS m FROM v3 p JOIN v3 q ON p.user_id = q.user_id AND p.i <> q.i JOIN r ON r.user_id = p.user_id WHERE abs(p.a - q.a) <= r AND abs(p.b - q.b) <= r AND abs(p.c - q.c) <= r GROUP BY 1)
SELECT r.user_id, round(CASE WHEN n >= 50 AND r > 0 AND m2.m > 0 AND m3.m > 0 THEN -ln(m3.m / m2.m) ELSE 0 END, 6) AS sample_entropy FROM r LEFT JOIN m2 USING (user_id) LEFT JOIN m3 USING (user_id)"""


def hurst(spark, sf_dir):
    return rounded(classic.hurst(indexed(spark, sf_dir), "user_id"), "user_id")


HURST_SQL = f"""
WITH {S}, b AS (SELECT user_id, x, i, z, i // z AS blk FROM s, unnest([8, 16, 32, 64, 128]) AS u(z) WHERE z <= n // 2 AND n >= 32 AND (i // z + 1) * z <= n),
c AS (SELECT *, x - avg(x) OVER (PARTITION BY user_id, z, blk) AS c FROM b), y AS (SELECT *, sum(c) OVER (PARTITION BY user_id, z, blk ORDER BY i) AS y FROM c),
q AS (SELECT user_id, z, blk, (max(y) - min(y)) / stddev_pop(x) AS rs FROM y GROUP BY 1, 2, 3 HAVING stddev_pop(x) > 1e-12), m AS (SELECT user_id, z, avg(rs) AS rs FROM q GROUP BY 1, 2),
f AS (SELECT user_id, count(*) AS k, regr_slope(ln(greatest(rs, 1e-9)), ln(z)) AS h FROM m GROUP BY 1)
SELECT u.user_id, round(CASE WHEN k >= 2 THEN h ELSE 0.5 END, 6) AS hurst FROM (SELECT DISTINCT user_id FROM s) u LEFT JOIN f USING (user_id)"""


def fnn(spark, sf_dir):
    s = indexed(spark, sf_dir)
    cloud = embedding.takens(s, "user_id", "x", M + 1, TAU)
    return rounded(classic.false_neighbours(stored(cloud, "cloud"), "user_id", POINT, "x3"), "user_id")


FNN_SQL = f"""
WITH {S}, e AS (SELECT a.user_id, a.i, a.x AS x0, b.x AS x1, c.x AS x2, d.x AS x3 FROM s a JOIN s b ON a.user_id = b.user_id AND b.i = a.i + 4 JOIN s c ON a.user_id = c.user_id AND c.i = a.i + 8 JOIN s d ON a.user_id = d.user_id AND d.i = a.i + 12),
d AS (SELECT a.user_id, a.i, a.x3 - b.x3 AS extra, sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2) AS d, row_number() OVER (PARTITION BY a.user_id, a.i ORDER BY (a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2, b.i) AS r FROM e a JOIN e b ON a.user_id = b.user_id AND a.i <> b.i)
SELECT user_id, CASE WHEN count(*) >= 20 THEN round(avg(CASE WHEN sqrt(d * d + extra * extra) / (d + 1e-12) > 10 THEN 1 ELSE 0 END), 6) END AS fnn FROM d WHERE r = 1 GROUP BY 1"""


def knn_r2(spark, sf_dir):
    s = indexed(spark, sf_dir)
    targets = s.select("user_id", (F.col("i") - M * TAU).alias("i"), F.col("x").alias("target")).filter("i >= 0")
    return rounded(classic.neighbour_r2(takens(spark, sf_dir), POINT, targets, "user_id"), "user_id")


R2_SQL = f"""
WITH {EMB}, t AS (SELECT e.*, s.x AS target FROM e JOIN s ON s.user_id = e.user_id AND s.i = e.i + 12),
d AS (SELECT a.user_id, a.i, b.i AS j, a.target, b.target AS tj, row_number() OVER (PARTITION BY a.user_id, a.i ORDER BY sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2), b.i) AS r FROM t a JOIN t b ON a.user_id = b.user_id AND a.i <> b.i),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, i ORDER BY r) AS q FROM d WHERE r <= 9 AND abs(i - j) > 3),
g AS (SELECT user_id, i, avg(tj) AS g FROM f WHERE q <= 5 GROUP BY 1, 2), h AS (SELECT t.user_id, t.target, t.target - coalesce(g.g, d.tj) AS e FROM t LEFT JOIN g USING (user_id, i) LEFT JOIN d ON d.user_id = t.user_id AND d.i = t.i AND d.r = 1)
SELECT user_id, CASE WHEN count(*) >= 30 AND var_pop(target) > 1e-12 THEN round(1 - avg(e * e) / var_pop(target), 6) END AS r2 FROM h GROUP BY 1"""


def ssa(spark, sf_dir):
    return rounded(classic.ssa_share(arrays(spark, sf_dir), "user_id"), "user_id")


def cleaned_cloud(spark, sf_dir):
    cloud = takens(spark, sf_dir).select("user_id", *(F.round(F.col(c) / 50).alias(c) for c in ("x0", "x1", "x2")))
    return embedding.cleaned(cloud, "user_id", "x0", "x1", "x2")


def knn_stats(spark, sf_dir):
    n = stored(neighbours.nearest(stored(takens(spark, sf_dir), "cloud"), "user_id", "i", POINT, 1), "nearest")
    p90 = ranks.quantiles(n, ["user_id"], "d", [0.9]).select("user_id", F.col("d").alias("nn_p90"))
    return rounded(n.groupBy("user_id").agg(F.avg("d").alias("nn_mean"), F.stddev_pop("d").alias("nn_sd")).join(p90, "user_id"), "user_id")


QUERIES = {
    "takens_events": (takens, f"WITH {EMB} SELECT user_id, i, x0, x1, x2 FROM e"),
    "multichannel": (multichannel, MULTI_SQL),
    "unit_sphere": (lambda s, d: rounded(embedding.unit_sphere(takens(s, d), "user_id", "x0", "x1", "x2"), "user_id", "i"), UNIT_SQL),
    "zscore_cloud": (lambda s, d: rounded(embedding.standardized(takens(s, d), "user_id", "x0", "x1", "x2"), "user_id", "i"), ZSCORE_SQL),
    "min_max": (lambda s, d: rounded(embedding.min_max(indexed(s, d), "user_id", "x"), "user_id", "i"), f"WITH {S} SELECT user_id, i, round((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w + 1e-9), 6) AS x FROM s WINDOW w AS (PARTITION BY user_id)"),
    "cleaned_cloud": (cleaned_cloud, f"WITH {EMB} SELECT DISTINCT user_id, round(x0 / 50) AS x0, round(x1 / 50) AS x1, round(x2 / 50) AS x2 FROM e"),
    "tau_ac": (lambda s, d: embedding.tau_autocorrelation(arrays(s, d)).select("user_id", "tau_ac"), TAU_AC_SQL),
    "tau_mi": (lambda s, d: embedding.tau_mutual_information(indexed(s, d), "user_id"), TAU_MI_SQL),
    "autocorrelation": (autocorrelation, AC_SQL),
    "pairwise_diameter": (lambda s, d: pairs(s, d).groupBy("user_id").agg(F.round(F.max("d"), 6).alias("diameter")), f"WITH {PAIRS} SELECT user_id, round(max(d), 6) AS diameter FROM d GROUP BY 1"),
    "knn_stats": (knn_stats, f"WITH {PAIRS}, n AS (SELECT user_id, i, min(d) AS d FROM d GROUP BY 1, 2) SELECT user_id, round(avg(d), 6) AS nn_mean, round(stddev_pop(d), 6) AS nn_sd, round(quantile_cont(d, 0.9), 6) AS nn_p90 FROM n GROUP BY 1"),
    "moments": (moments, MOMENTS_SQL),
    "spectrum": (spectrum, SPECTRUM_SQL),
    "sample_entropy": (sample_entropy, SAMPEN_SQL),
    "hurst": (hurst, HURST_SQL),
    "false_neighbours": (fnn, FNN_SQL),
    "knn_r2": (knn_r2, R2_SQL),
    "ssa_share": (ssa, None),
}
