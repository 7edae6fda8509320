"""Queries over panels: entities with dated rows, from lineitem, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from simplicia.functions import scalars
from simplicia.operators import embedding, panel
from simplicia.plans.series import ORDER, S, events, rounded
from simplicia.sources.store import partitions, stored


def read(spark, sf_dir, name, *columns) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def daily(spark, sf_dir) -> DataFrame:
    """Supplier panel: one row for each supplier and ship date. buy, sell and other are the quantities by return flag
    (A, R, N); price is the mean unit price."""
    li = read(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate", "l_returnflag", "l_quantity", "l_extendedprice")
    li = li.withColumnRenamed("l_suppkey", "supp").withColumn("day", F.to_date("l_shipdate")).drop("l_shipdate")
    q = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))
    # nearly every line is a group of its own, so rows are dealt before they are summed, over partitions that grow with the table
    return li.repartition(partitions(spark, li.count()), "supp", "day").groupBy("supp", "day").agg(
        q("A").alias("buy"), q("R").alias("sell"), q("N").alias("other"), F.avg(F.try_divide("l_extendedprice", "l_quantity")).alias("price")
    )


DAILY = """daily AS (SELECT l_suppkey AS supp, l_shipdate::DATE AS day, sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS buy, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS sell,
  sum(l_quantity) FILTER (WHERE l_returnflag = 'N') AS other, avg(l_extendedprice / nullif(l_quantity, 0)) AS price FROM lineitem GROUP BY 1, 2)"""


def imbalance(spark, sf_dir):
    d = daily(spark, sf_dir)
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return rounded(d.select("supp", F.col("day").cast("string").alias("day"), scalars.imbalance(z("buy"), z("sell")).alias("imb_ar"), scalars.imbalance(z("buy"), z("other")).alias("imb_an")), "supp", "day")


IMBALANCE_SQL = f"WITH {DAILY} SELECT supp, day::VARCHAR AS day, round((coalesce(buy, 0) - coalesce(sell, 0)) / (coalesce(buy, 0) + coalesce(sell, 0) + 1e-9), 6) AS imb_ar, round((coalesce(buy, 0) - coalesce(other, 0)) / (coalesce(buy, 0) + coalesce(other, 0) + 1e-9), 6) AS imb_an FROM daily"


def eligibility(spark, sf_dir):
    return rounded(panel.eligible(daily(spark, sf_dir), "supp", "day", ["buy", "sell", "other"], 30, 0.1), "supp", "n_days")


ELIGIBLE = "el AS (SELECT supp, count(DISTINCT day) AS n_days, count(buy) / greatest(count(DISTINCT day), 1) AS cov_buy, count(sell) / greatest(count(DISTINCT day), 1) AS cov_sell, count(other) / greatest(count(DISTINCT day), 1) AS cov_other FROM daily GROUP BY 1 HAVING count(DISTINCT day) >= 30 AND cov_buy >= 0.1 AND cov_sell >= 0.1 AND cov_other >= 0.1)"


def top_panel(spark, sf_dir):
    d = daily(spark, sf_dir)
    top = panel.top_entities(panel.eligible(d, "supp", "day", ["buy", "sell", "other"], 30, 0.1), "supp", 20)
    return rounded(panel.restricted(d, top, "supp").groupBy("supp").agg(F.count("*").alias("n"), F.avg("price").alias("price")), "supp", "n")


def panel_join(spark, sf_dir):
    """Three inputs joined on (entity, date): shipped quantity, ordered value, returned value (left)."""
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag", "l_extendedprice")
    a = li.groupBy("l_suppkey", F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("shipped"))
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_totalprice")
    b = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("l_suppkey", F.to_date("o_orderdate").alias("day")).agg(F.sum("l_extendedprice").alias("ordered"))
    c = li.filter("l_returnflag = 'R'").groupBy("l_suppkey", F.to_date("l_shipdate").alias("day")).agg(F.sum("l_extendedprice").alias("returned"))
    out = a.join(b, ["l_suppkey", "day"]).join(c, ["l_suppkey", "day"], "left").withColumnRenamed("l_suppkey", "supp")
    return rounded(out.withColumn("day", F.col("day").cast("string")), "supp", "day")


PANEL_JOIN_SQL = """
WITH a AS (SELECT l_suppkey, l_shipdate::DATE AS day, sum(l_quantity) AS shipped FROM lineitem GROUP BY 1, 2),
b AS (SELECT l_suppkey, o_orderdate::DATE AS day, sum(l_extendedprice) AS ordered FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
c AS (SELECT l_suppkey, l_shipdate::DATE AS day, sum(l_extendedprice) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT l_suppkey AS supp, day::VARCHAR AS day, round(shipped, 6) AS shipped, round(ordered, 6) AS ordered, round(returned, 6) AS returned FROM a JOIN b USING (l_suppkey, day) LEFT JOIN c USING (l_suppkey, day)"""


def forward_labels(spark, sf_dir):
    """Returns of each user's series and labels looking ahead: volatility of the next 5 log returns, mean and sum of
    the next 5. A value of 0 has no log return to or from it."""
    w = Window.partitionBy("user_id").orderBy("i")
    s = embedding.indexed(events(spark, sf_dir), "user_id", ORDER, "x").withColumn("ret", F.ln(F.try_divide(F.col("x"), F.lag("x").over(w))))
    out = s.select("user_id", "i", "ret", panel.forward_volatility("user_id", ["i"], "ret", 5).alias("fwd_rv"), panel.forward_mean("user_id", ["i"], "x", 5).alias("fwd_mean"), panel.forward_sum("user_id", ["i"], "ret", 5).alias("fwd_ret"))
    return rounded(out, "user_id", "i")


FORWARD_SQL = f"""
WITH {S}, q AS (SELECT user_id, i, x, x / nullif(lag(x) OVER (PARTITION BY user_id ORDER BY i), 0) AS q FROM s), r AS (SELECT user_id, i, x, CASE WHEN q > 0 THEN ln(q) END AS ret FROM q)
SELECT user_id, i, round(ret, 6) AS ret, CASE WHEN count(ret) OVER w >= 3 THEN round(stddev_samp(ret) OVER w, 6) END AS fwd_rv, round(avg(x) OVER w, 6) AS fwd_mean,
  CASE WHEN count(ret) OVER w >= 2 THEN round(sum(ret) OVER w, 6) END AS fwd_ret FROM r WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"""


def seasonal(spark, sf_dir):
    """Value less the trailing mean of the same event type of the same user, the current row and 10 before it."""
    e = events(spark, sf_dir).withColumn("at", F.struct("ts", "event_id"))
    return rounded(e.select("event_id", (F.col("x") - panel.trailing_mean(e, ["user_id", "event_type"], "at", "x", 10)).alias("adjusted")), "event_id")


SEASONAL_SQL = "SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW), 6) AS adjusted FROM events"


def windows(spark, sf_dir):
    a = embedding.as_arrays(events(spark, sf_dir), "user_id", ORDER, "x")
    w = panel.sliding_windows(a, "user_id", 24, 8, 5, 5, ["x"])
    return rounded(w.select("user_id", "start", (F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / 24).alias("mean"), F.array_max("x").alias("most")), "user_id", "start")


WINDOWS_SQL = f"""
WITH {S}, w AS (SELECT DISTINCT user_id, n, st FROM s, unnest(range(0, (SELECT max(n) FROM s), 8)) AS u(st) WHERE st + 24 <= n AND st + 24 + 5 <= n AND n >= 34)
SELECT w.user_id, st AS start, round(avg(x), 6) AS mean, round(max(x), 6) AS most FROM w JOIN s ON s.user_id = w.user_id AND s.i BETWEEN st AND st + 23 GROUP BY 1, 2"""


def latest(spark, sf_dir):
    """The last row of each supplier and month."""
    d = daily(spark, sf_dir).withColumn("month", scalars.month_key(F.col("day")))
    got = panel.latest(d, ["supp", "month"], F.desc("day"))
    return got.select("supp", "month", F.col("day").cast("string").alias("day"), F.round(F.col("price") + 1e-7, 4).alias("price"))  # off the halves, which averages meet often


def interpolated(spark, sf_dir):
    """Series with every fifth value missing, filled in."""
    s = embedding.indexed(events(spark, sf_dir), "user_id", ORDER, "x", "event_id").withColumn("x", F.when(F.col("event_id") % 5 != 0, F.col("x")))
    return rounded(panel.interpolated(s.drop("event_id"), "user_id", "x", 0.5), "user_id", "i")


INTERPOLATED_SQL = f"""
WITH {S.replace('value AS x', 'CASE WHEN event_id % 5 <> 0 THEN value END AS x')},
q AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i0,
  first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1, avg(CASE WHEN x IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY user_id) AS share FROM s),
f AS (SELECT q.user_id, q.i, CASE WHEN i0 IS NULL THEN b.x WHEN i1 IS NULL THEN a.x WHEN i0 = i1 THEN a.x ELSE a.x + (b.x - a.x) * (q.i - i0) / (i1 - i0) END AS x FROM q LEFT JOIN s a ON a.user_id = q.user_id AND a.i = i0 LEFT JOIN s b ON b.user_id = q.user_id AND b.i = i1 WHERE share >= 0.5),
z AS (SELECT *, stddev_pop(x) OVER (PARTITION BY user_id) AS sd FROM f)
SELECT user_id, i, round(x, 6) AS x FROM z WHERE sd >= 1e-12"""


def limit_labels(spark, sf_dir):
    """Whether a series jumps beyond 0.98 of the limit of its board (by the prefix of its padded id)."""
    w = Window.partitionBy("user_id").orderBy("i")
    s = embedding.indexed(events(spark, sf_dir), "user_id", ORDER, "x")
    sym = F.col("user_id").cast("string")
    r = s.withColumn("r", F.try_divide(F.col("x"), F.lag("x").over(w)) - 1).filter(F.col("r").isNotNull())
    return r.select("user_id", "i", scalars.padded_id(sym).alias("code"), scalars.exchange_code(scalars.padded_id(sym)).alias("market"), (F.col("r") > 0.98 * scalars.price_limit(sym)).cast("int").alias("limit_up"))


LIMIT_SQL = f"""
WITH {S}, r AS (SELECT user_id, i, x / nullif(lag(x) OVER (PARTITION BY user_id ORDER BY i), 0) - 1 AS r, CASE WHEN length(user_id::VARCHAR) < 6 THEN lpad(user_id::VARCHAR, 6, '0') ELSE user_id::VARCHAR END AS code FROM s)
SELECT user_id, i, code, CASE WHEN code[1] = '6' THEN 'sh.' || code WHEN code[1] IN ('0', '3') THEN 'sz.' || code END AS market,
  (r > 0.98 * CASE WHEN user_id::VARCHAR LIKE '3%' OR user_id::VARCHAR LIKE '688%' THEN 0.2 ELSE 0.1 END)::INT AS limit_up FROM r WHERE r IS NOT NULL"""


def bars(spark, sf_dir):
    """Channels of daily supplier bars: open, high, low, close by order of line, volume and amount."""
    li = read(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").withColumn("p", F.try_divide("l_extendedprice", "l_quantity"))
    key = F.struct("l_orderkey", "l_linenumber", "p")
    day = li.groupBy(F.col("l_suppkey").alias("supp"), F.to_date("l_shipdate").alias("day")).agg(F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", key).alias("close"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"))
    return rounded(panel.bar_channels(day, ["supp"], "day").withColumn("day", F.col("day").cast("string")), "supp", "day")


BARS_SQL = """
WITH l AS (SELECT l_suppkey AS supp, l_shipdate::DATE AS day, l_extendedprice / nullif(l_quantity, 0) AS p, l_quantity AS q, l_extendedprice AS e, l_orderkey AS o, l_linenumber AS n FROM lineitem),
d AS (SELECT supp, day, max(p) AS high, min(p) AS low, last(p ORDER BY o, n, p) AS close, sum(q) AS volume, sum(e) AS amount FROM l GROUP BY 1, 2)
SELECT supp, day::VARCHAR AS day, CASE WHEN close / nullif(coalesce(lag(close) OVER (PARTITION BY supp ORDER BY day), close), 0) > 0 THEN round(ln(close / coalesce(lag(close) OVER (PARTITION BY supp ORDER BY day), close)), 6) END AS ret, round(ln(1 + volume), 6) AS logvol, round((high - low) / nullif(close, 0), 6) AS rng, round(ln(1 + amount), 6) AS lamt FROM d"""


def whole_orders(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return panel.whole_groups(li, ["l_orderkey"], 4, F.col("l_quantity") > 2).select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 6).alias("price"))


def cleaned_props(spark, sf_dir):
    """Numbers out of text: the value in props and a text that isn't always one."""
    e = read(spark, sf_dir, "events", "event_id", "props", "event_type")
    raw = F.get_json_object("props", "$.k")
    mixed = F.when(F.col("event_id") % 3 == 0, F.lit("nan")).when(F.col("event_id") % 7 == 0, F.lit("inf")).otherwise(raw)
    return e.select("event_id", scalars.clean(raw).alias("k"), scalars.clean(mixed).alias("mixed"), scalars.clean(F.col("event_type")).alias("bad"))


CLEAN_SQL = """
SELECT event_id, (props ->> '$.k')::DOUBLE AS k, CASE WHEN event_id % 3 <> 0 AND event_id % 7 <> 0 THEN (props ->> '$.k')::DOUBLE END AS mixed, NULL::DOUBLE AS bad FROM events"""


def histogram(spark, sf_dir):
    """Counts in 20 equal bins of the values of each event type, the last bin closed."""
    e = events(spark, sf_dir)
    ends = e.groupBy("event_type").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # a row for each type, no window over all rows of one
    b = e.join(ends, "event_type").select("event_type", scalars.bin_of(F.col("x"), F.col("lo"), F.col("hi"), 20).alias("bin"))
    return b.groupBy("event_type", "bin").agg(F.count("*").alias("n"))


def seeds(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    return o.select("o_orderkey", scalars.seed_of(F.col("o_orderstatus"), F.col("o_orderkey").cast("string")).alias("seed"))


RATIOS, SEEDS = (20, 40, 60, 80, 100), 3


def subsample_scan(spark, sf_dir):
    """A grid of subsample ratios and seeds, exact in size: the least ratio at which the mean value of a user stays near
    that of the whole series, averaged over the seeds, and whether the gap never grows with the ratio."""
    e = events(spark, sf_dir)
    # one shuffle for all windows, over partitions that grow with the table; the ratios of a seed cut one order
    dealt = e.repartition(partitions(spark, SEEDS * e.count()), "user_id")
    s = embedding.indexed(dealt, "user_id", ORDER, "x").withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    drawn = s.withColumn("seed", F.explode(F.array(*map(F.lit, range(SEEDS)))))
    order = Window.partitionBy("user_id", "seed").orderBy(scalars.seed_of(F.col("seed").cast("string"), F.col("i").cast("string")), "i")
    ranked = drawn.withColumn("r", F.row_number().over(order))
    cut = lambda ratio: F.col("r") <= F.greatest(F.lit(10), F.floor(F.col("n") * ratio / 100))
    each = ranked.groupBy("user_id", "seed").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), *(F.avg(F.when(cut(r), F.col("x"))).alias(f"m{r}") for r in RATIOS))
    gaps = each.groupBy("user_id").agg(F.max("sd").alias("sd"), *(F.round(F.avg(F.abs(F.col(f"m{r}") - F.col("mean"))), 6).alias(f"m{r}") for r in RATIOS))
    long = F.explode(F.array(*(F.struct(F.lit(r).alias("ratio"), F.col(f"m{r}").alias("gap")) for r in RATIOS)))
    scan = stored(gaps.select("user_id", "sd", long.alias("g")).select("user_id", "g.ratio", "g.gap", "sd"), "scan")  # read by both
    return panel.least_ratio(scan, "user_id", "ratio", "gap", "sd", 0.1).join(panel.monotone(scan, "user_id", "ratio", "gap"), "user_id")


SUBSAMPLE_SQL = f"""
WITH {S}, d AS (SELECT user_id, i, x, n, ratio, seed, row_number() OVER (PARTITION BY user_id, ratio, seed ORDER BY ('0x' || md5(seed || '|' || i)[1:8])::BIGINT % 2147483648, i) AS r FROM s, unnest({list(RATIOS)}) AS a(ratio), unnest(range(0, {SEEDS})) AS b(seed)),
e AS (SELECT user_id, ratio, seed, avg(x) AS m FROM d WHERE r <= greatest(10, floor(n * ratio / 100)) GROUP BY 1, 2, 3), f AS (SELECT user_id, avg(x) AS mean, stddev_pop(x) AS sd FROM s GROUP BY 1),
g AS (SELECT user_id, ratio, round(avg(abs(m - mean)), 6) AS gap, any_value(sd) AS sd FROM e JOIN f USING (user_id) GROUP BY 1, 2), h AS (SELECT *, gap - lag(gap) OVER (PARTITION BY user_id ORDER BY ratio) AS step FROM g)
SELECT user_id, coalesce(min(ratio) FILTER (WHERE gap < 0.1 * sd), 100) AS min_ratio, coalesce(max(step), 0) <= 0 AS monotone FROM h GROUP BY 1"""


def missing(spark, sf_dir):
    return panel.missing_profile(daily(spark, sf_dir), ["buy", "sell", "other", "price"]).select("column", F.round("missing", 6).alias("missing"))


def cumulative(spark, sf_dir):
    s = embedding.indexed(events(spark, sf_dir), "user_id", ORDER, "x")
    w = Window.partitionBy("user_id").orderBy("i")
    return rounded(s.select("user_id", "i", F.sum("x").over(w).alias("total"), (F.col("x") - F.lag("x").over(w)).alias("diff")), "user_id", "i")


QUERIES = {
    "imbalance": (imbalance, IMBALANCE_SQL),
    "eligibility": (eligibility, f"WITH {DAILY}, {ELIGIBLE} SELECT supp, n_days, round(cov_buy, 6) AS cov_buy, round(cov_sell, 6) AS cov_sell, round(cov_other, 6) AS cov_other FROM el"),
    "top_panel": (top_panel, f"WITH {DAILY}, {ELIGIBLE}, t AS (SELECT supp FROM el ORDER BY n_days DESC, supp LIMIT 20) SELECT supp, count(*) AS n, round(avg(price), 6) AS price FROM daily WHERE supp IN (SELECT supp FROM t) GROUP BY 1"),
    "panel_join": (panel_join, PANEL_JOIN_SQL),
    "forward_labels": (forward_labels, FORWARD_SQL),
    "seasonal_adjust": (seasonal, SEASONAL_SQL),
    "sliding_windows": (windows, WINDOWS_SQL),
    "dedup_latest": (latest, f"WITH {DAILY}, r AS (SELECT supp, strftime(day, '%Y-%m') AS month, day, price, row_number() OVER (PARTITION BY supp, strftime(day, '%Y-%m') ORDER BY day DESC) AS r FROM daily) SELECT supp, month, day::VARCHAR AS day, round(price + 1e-7, 4) AS price FROM r WHERE r = 1"),
    "interpolate": (interpolated, INTERPOLATED_SQL),
    "limit_label": (limit_labels, LIMIT_SQL),
    "bar_channels": (bars, BARS_SQL),
    "whole_groups": (whole_orders, "WITH w AS (SELECT *, count(*) OVER w AS n, min(l_quantity) OVER w AS q FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)) SELECT l_orderkey, l_linenumber, round(l_extendedprice, 6) AS price FROM w WHERE n = 4 AND q > 2"),
    "clean_numbers": (cleaned_props, CLEAN_SQL),
    "histogram": (histogram, "WITH w AS (SELECT event_type, CASE WHEN max(value) OVER w > min(value) OVER w THEN least(floor((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * 20), 19) ELSE 0 END::INT AS bin FROM events WINDOW w AS (PARTITION BY event_type)) SELECT event_type, bin, count(*) AS n FROM w GROUP BY 1, 2"),
    "seeds": (seeds, "SELECT o_orderkey, ('0x' || md5(o_orderstatus || '|' || o_orderkey)[1:8])::BIGINT % 2147483648 AS seed FROM orders"),
    "subsample_scan": (subsample_scan, SUBSAMPLE_SQL),
    "missing_profile": (missing, f"WITH {DAILY} SELECT 'buy' AS column, round(avg((buy IS NULL)::INT), 6) AS missing FROM daily UNION ALL SELECT 'sell', round(avg((sell IS NULL)::INT), 6) FROM daily UNION ALL SELECT 'other', round(avg((other IS NULL)::INT), 6) FROM daily UNION ALL SELECT 'price', round(avg((price IS NULL)::INT), 6) FROM daily"),
    "cumulative": (cumulative, f"WITH {S} SELECT user_id, i, round(sum(x) OVER w, 6) AS total, round(x - lag(x) OVER w, 6) AS diff FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i)"),
}
