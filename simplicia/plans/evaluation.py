"""Queries of the evaluation algebra over a monthly supplier panel: features of a month and the label of the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from simplicia.operators import classic, diagrams, evaluate
from simplicia.plans.panels import read
from simplicia.plans.series import S, indexed, rounded
from simplicia.sources.store import stored

FEATURES = ["f_qty", "f_disc", "f_tax", "f_rows", "f_ret"]


def monthly(spark, sf_dir) -> DataFrame:
    """supp, month, features and y, the mean unit price of the supplier's next month."""
    li = read(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice")
    m = li.groupBy(F.col("l_suppkey").alias("supp"), F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(
        F.avg("l_quantity").alias("f_qty"), F.round(F.avg("l_discount"), 6).alias("f_disc"), F.round(F.avg("l_tax"), 6).alias("f_tax"), F.count("*").cast("double").alias("f_rows"),
        F.avg((F.col("l_returnflag") == "R").cast("int")).alias("f_ret"), F.avg(F.try_divide("l_extendedprice", "l_quantity")).alias("price"),
    )
    w = Window.partitionBy("supp").orderBy("month")
    return m.withColumn("y", F.round(F.lead("price").over(w), 6)).drop("price")


MONTHLY = """m0 AS (SELECT l_suppkey AS supp, strftime(l_shipdate, '%Y-%m') AS month, avg(l_quantity) AS f_qty, round(avg(l_discount), 6) AS f_disc, round(avg(l_tax), 6) AS f_tax, count(*)::DOUBLE AS f_rows,
  avg((l_returnflag = 'R')::INT) AS f_ret, avg(l_extendedprice / nullif(l_quantity, 0)) AS price FROM lineitem GROUP BY 1, 2),
m AS (SELECT * EXCLUDE (price), round(lead(price) OVER (PARTITION BY supp ORDER BY month), 6) AS y FROM m0)"""
LONG = "long AS (SELECT supp, month, y, feature, x FROM (SELECT supp, month, y, f_qty, f_disc, f_tax, f_rows, f_ret FROM m) UNPIVOT (x FOR feature IN (f_qty, f_disc, f_tax, f_rows, f_ret)))"


def rank_sql(source: str, keys: str, x: str, y: str, least: int) -> str:
    """Rank correlation in DuckDB, 0 for a constant column."""
    part = f"PARTITION BY {keys}"
    return f"""(SELECT {keys}, count(*) AS n, CASE WHEN count(*) >= {least} THEN CASE WHEN stddev_pop(rx) >= 1e-12 AND stddev_pop(ry) >= 1e-12 THEN corr(rx, ry) ELSE 0 END END AS ic FROM (
      SELECT {keys}, rank() OVER ({part} ORDER BY {x}) + (count(*) OVER ({part}, {x}) - 1) / 2 AS rx, rank() OVER ({part} ORDER BY {y}) + (count(*) OVER ({part}, {y}) - 1) / 2 AS ry
      FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY {keys})"""


def rank_ic(spark, sf_dir):
    long = evaluate.long_features(monthly(spark, sf_dir), ["month", "y"], FEATURES)
    return rounded(evaluate.spearman(long, ["month", "feature"], "x", "y"), "month", "feature", "n")


def folds(spark, sf_dir):
    s = indexed(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    f = evaluate.purged_folds(s, 4, 3, 2)
    return f.groupBy("user_id", "k", "role").agg(F.count("*").alias("rows"), F.min("i").alias("first"), F.max("i").alias("last"))


FOLDS_SQL = f"""
WITH {S}, f AS (SELECT user_id, i, n, k, n // 5 AS fold FROM s, unnest([1, 2, 3, 4]) AS u(k)),
r AS (SELECT *, CASE WHEN i < fold * k - 3 THEN 'train' WHEN i >= fold * k + 5 AND i < fold * k + 5 + fold THEN 'test' END AS role FROM f WHERE fold >= 2 AND fold * k - 3 >= 5)
SELECT user_id, k, role, count(*) AS rows, min(i) AS first, max(i) AS last FROM r WHERE role IS NOT NULL GROUP BY 1, 2, 3"""


def strat_folds(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings", "vec_id", "label")
    return evaluate.stratified(e, "label", "vec_id", 5, 0.7, seed=3).select("vec_id", "label", "fold", F.col("train").cast("int").alias("train"))


def seed_sql(seed, id_: str) -> str:
    """seed_of in DuckDB."""
    return f"(('0x' || md5({seed} || '|' || {id_})[1:8])::BIGINT % 2147483648)"


def group_folds(spark, sf_dir):
    """Lines by the fold of their order: rows, orders and lines of each fold."""
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity").withColumn("fold", evaluate.group_fold(F.col("l_orderkey"), 5, seed=1))
    return rounded(li.groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("groups"), F.sum("l_quantity").alias("quantity")), "fold", "n", "groups")


def single_split(spark, sf_dir):
    """Folds of series too short for several: one split each."""
    s = indexed(spark, sf_dir).filter("i < 7 - pmod(user_id, 3)").withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    return evaluate.purged_folds(s, 4, 1, 0).select("user_id", "i", "k", "role")


SINGLE_SQL = f"""
WITH {S}, f AS (SELECT user_id, i, count(*) OVER (PARTITION BY user_id) AS n FROM s WHERE i < 7 - user_id % 3), k AS (SELECT *, n // 5 AS fold, k FROM f, unnest([1, 2, 3, 4]) AS u(k)),
r AS (SELECT *, CASE WHEN fold < 2 THEN CASE WHEN k = 1 THEN CASE WHEN i = n - 1 THEN 'test' ELSE 'train' END END WHEN fold * k - 1 >= 5 THEN CASE WHEN i < fold * k - 1 THEN 'train' WHEN i >= fold * k + 1 AND i < fold * k + 1 + fold THEN 'test' END END AS role FROM k)
SELECT user_id, i, k, role FROM r WHERE role IS NOT NULL"""


def auc(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_orderpriority", "o_totalprice", "o_orderstatus")
    return rounded(evaluate.auc(o.withColumn("label", (F.col("o_orderstatus") == "F").cast("int")), ["o_orderpriority"], "o_totalprice", "label"), "o_orderpriority")


AUC_SQL = """
WITH r AS (SELECT o_orderpriority, o_orderstatus = 'F' AS pos, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2 AS r FROM orders)
SELECT o_orderpriority, round((sum(r) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2) / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 6) AS auc FROM r GROUP BY 1"""


def months_of(panel: DataFrame) -> DataFrame:
    return panel.select("month").distinct().withColumn("number", F.row_number().over(Window.orderBy("month")))


def expanding(spark, sf_dir):
    p = stored(monthly(spark, sf_dir), "monthly")
    return rounded(evaluate.expanding_selection(p, months_of(p), FEATURES, "y", 3, 6, 200), "month", "feature", "rank").drop("n")


def _expanding_sql(tail: str, k: int = 3) -> str:
    return f"""
WITH {MONTHLY}, mo AS (SELECT month, row_number() OVER (ORDER BY month) AS number FROM (SELECT DISTINCT month FROM m)), {LONG},
past AS (SELECT a.month AS at_, l.feature, l.x, l.y, l.month, l.supp FROM mo a JOIN mo b ON b.number < a.number JOIN long l ON l.month = b.month),
enough AS (SELECT at_ FROM past GROUP BY 1 HAVING count(*) / 5 >= 200 AND count(DISTINCT month) >= 6), p2 AS (SELECT * FROM past WHERE at_ IN (SELECT at_ FROM enough)),
ics AS {rank_sql('p2', 'at_, feature', 'x', 'y', 10)},
sel AS (SELECT at_ AS month, feature, ic, row_number() OVER (PARTITION BY at_ ORDER BY abs(ic) DESC, feature) AS rank FROM ics WHERE ic IS NOT NULL QUALIFY rank <= {k})
{tail}"""


def expanding_ic(spark, sf_dir):
    p = stored(monthly(spark, sf_dir), "monthly")
    chosen = evaluate.expanding_selection(p, months_of(p), FEATURES, "y", 3, 6, 200)
    return rounded(evaluate.expanding_ic(p, chosen, "supp", FEATURES, "y", 10), "month", "n")


EXPANDING_IC_SQL = _expanding_sql(f", sc AS (SELECT l.month, l.supp, l.y, sum(l.x * s.ic) AS score FROM long l JOIN sel s USING (month, feature) GROUP BY 1, 2, 3) SELECT month, n, round(ic, 6) AS ic FROM {rank_sql('sc', 'month', 'score', 'y', 10)}")


def expanding_factor(spark, sf_dir):
    """The factor of each (supplier, month): the features chosen on all earlier months, weighted by their past ic."""
    p = stored(monthly(spark, sf_dir), "monthly")
    chosen = evaluate.expanding_selection(p, months_of(p), FEATURES, "y", 3, 6, 200)
    return rounded(evaluate.factor_scores(p, chosen, "supp", FEATURES, "y").select("month", "supp", "score"), "month", "supp")


def _monthly_ics(spark, sf_dir) -> DataFrame:
    long = evaluate.long_features(monthly(spark, sf_dir), ["month", "y"], FEATURES)
    return evaluate.spearman(long, ["feature", "month"], "x", "y")


ICS = f"{MONTHLY}, {LONG}, ics AS {rank_sql('long', 'feature, month', 'x', 'y', 10)}"


def nw(spark, sf_dir):
    return rounded(evaluate.newey_west(_monthly_ics(spark, sf_dir), ["feature"], "month", "ic"), "feature", "n")


NW_SQL = f"""
WITH {ICS}, v AS (SELECT feature, ic, row_number() OVER (PARTITION BY feature ORDER BY month) AS t FROM ics WHERE ic IS NOT NULL),
e AS (SELECT *, ic - avg(ic) OVER (PARTITION BY feature) AS e, count(*) OVER (PARTITION BY feature) AS n FROM v),
g AS (SELECT a.feature, b.t - a.t AS lag, sum(a.e * b.e) / any_value(a.n) AS g, any_value(a.n) AS n FROM e a JOIN e b ON a.feature = b.feature AND b.t >= a.t AND b.t - a.t <= floor(4 * (a.n / 100.0) ** (2.0 / 9)) GROUP BY 1, 2),
s AS (SELECT feature, any_value(n) AS n, sum(CASE WHEN lag = 0 THEN g ELSE 2 * (1 - lag / (floor(4 * (n / 100.0) ** (2.0 / 9)) + 1)) * g END) AS s FROM g GROUP BY 1)
SELECT s.feature, s.n, round(m, 6) AS mean, round(sd, 6) AS sd, round(CASE WHEN s.n >= 4 THEN m / sqrt(greatest(s, 1e-18) / s.n) END, 6) AS nw_t FROM s JOIN (SELECT feature, avg(ic) AS m, stddev_samp(ic) AS sd FROM ics GROUP BY 1) USING (feature)"""

SUMMARY_SQL = f"""
WITH {ICS}, g AS (SELECT feature, count(*) AS n, avg(ic) AS m, stddev_samp(ic) AS s, avg((ic > 1e-12)::INT) AS p FROM ics WHERE ic IS NOT NULL GROUP BY 1)
SELECT feature, n, CASE WHEN n >= 3 THEN round(m, 6) END AS ic, CASE WHEN n >= 3 AND s > 0 THEN round(m / s, 6) END AS icir, CASE WHEN n >= 3 AND s > 0 THEN round(m / (s / sqrt(n)), 6) END AS t,
  CASE WHEN n >= 3 THEN round(p, 6) END AS positive FROM g"""


def paired(spark, sf_dir):
    w = _monthly_ics(spark, sf_dir).groupBy("month").pivot("feature", ["f_qty", "f_rows"]).agg(F.first("ic"))
    return rounded(evaluate.paired(w.withColumn("pair", F.lit("qty-rows")), ["pair"], "f_qty", "f_rows"), "pair", "n", "wins")


PAIRED_SQL = f"WITH {ICS}, d AS (SELECT a.ic - b.ic AS d FROM ics a JOIN ics b USING (month) WHERE a.feature = 'f_qty' AND b.feature = 'f_rows' AND a.ic IS NOT NULL AND b.ic IS NOT NULL) SELECT 'qty-rows' AS pair, count(*) AS n, round(avg(d), 6) AS diff, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, count(*) FILTER (WHERE d > 0) AS wins FROM d"


def pvalues(spark, sf_dir):
    w = _monthly_ics(spark, sf_dir).groupBy("month").pivot("feature", ["f_qty", "f_rows"]).agg(F.first("ic")).withColumn("pair", F.lit("qty-rows"))
    return rounded(evaluate.paired_pvalues(w, "pair", "f_qty", "f_rows"), "pair")


def residual_1(spark, sf_dir):
    r = evaluate.residual_1(monthly(spark, sf_dir), ["month"], "y", "f_qty")
    return r.filter("residual IS NOT NULL").select("supp", "month", F.round("residual", 4).alias("residual"))


RESIDUAL_SQL = f"WITH {MONTHLY}, g AS (SELECT * FROM m WHERE y IS NOT NULL) SELECT supp, month, round(y - regr_intercept(y, f_qty) OVER w - regr_slope(y, f_qty) OVER w * f_qty, 4) AS residual FROM g WINDOW w AS (PARTITION BY month) QUALIFY count(*) OVER w >= 6"


def residual_k(spark, sf_dir):
    """Residual of the label on three factors within each month."""
    r = evaluate.residuals(monthly(spark, sf_dir), "month", "supp", "y", ["f_qty", "f_disc", "f_tax"])
    return r.filter("residual IS NOT NULL").select("supp", "month", F.round("residual", 4).alias("residual"))


#: Least squares on three factors by regressing one factor after the other out of the label and the later factors.
RESIDUAL_MANY_SQL = f"""
WITH {MONTHLY}, g AS (SELECT supp, month, y, f_qty AS a, f_disc AS b, f_tax AS c FROM m WHERE y IS NOT NULL QUALIFY count(*) OVER (PARTITION BY month) >= 8),
r1 AS (SELECT supp, month, b - regr_intercept(b, a) OVER w - regr_slope(b, a) OVER w * a AS b, c - regr_intercept(c, a) OVER w - regr_slope(c, a) OVER w * a AS c, y - regr_intercept(y, a) OVER w - regr_slope(y, a) OVER w * a AS y FROM g WINDOW w AS (PARTITION BY month)),
r2 AS (SELECT supp, month, c - regr_slope(c, b) OVER w * (b - avg(b) OVER w) - avg(c) OVER w AS c, y - regr_slope(y, b) OVER w * (b - avg(b) OVER w) - avg(y) OVER w AS y FROM r1 WINDOW w AS (PARTITION BY month))
SELECT supp, month, round(y - regr_slope(y, c) OVER w * (c - avg(c) OVER w) - avg(y) OVER w, 4) AS residual FROM r2 WINDOW w AS (PARTITION BY month)"""


def permutation_residual(spark, sf_dir):
    """Two-sided share of 200 within-month permutations of a feature whose residual on another one has a mean rank
    correlation with the label at least as far from 0 as the real one's. It reads as a p-value without correction."""
    p = stored(monthly(spark, sf_dir).filter("y IS NOT NULL").select("supp", "month", "f_qty", "f_disc", "y"), "monthly")
    mean_ic = lambda df, keys: evaluate.spearman(evaluate.residual_1(df, [*keys, "month"], "f_qty", "f_disc"), [*keys, "month"], "residual", "y").groupBy(*keys).agg(F.round(F.avg("ic"), 9).alias("ic"))
    real = mean_ic(p.withColumn("seed", F.lit(-1)), ["seed"]).select(F.lit(1).alias("one"), F.col("ic").alias("real"))
    ics = evaluate.permuted_ics(p, "month", "supp", "f_qty", "y", 200, "f_disc").groupBy("seed").agg(F.round(F.avg("ic"), 9).alias("ic"))
    null = ics.withColumn("one", F.lit(1)).join(real, "one")
    return rounded(null.agg(F.avg((F.abs("ic") >= F.abs("real")).cast("int")).alias("p"), F.count("*").alias("n")), "n")


def _residual_ic(source: str, keys: str) -> str:
    """Mean monthly rank correlation of the label with the residual of f_qty on f_disc."""
    r = f"(SELECT *, f_qty - regr_intercept(f_qty, f_disc) OVER w - regr_slope(f_qty, f_disc) OVER w * f_disc AS r FROM {source} WINDOW w AS (PARTITION BY {keys}, month) QUALIFY count(*) OVER w >= 6)"
    return f"(SELECT {keys}, round(avg(ic), 9) AS ic FROM {rank_sql(r, keys + ', month', 'r', 'y', 10)} GROUP BY {keys})"


PERMUTATION_SQL = f"""
WITH {MONTHLY}, g AS (SELECT -1 AS seed, supp, month, f_qty, f_disc, y FROM m WHERE y IS NOT NULL), x AS (SELECT g.supp, g.month, g.f_qty, g.f_disc, g.y, u.seed FROM g, unnest(range(0, 200)) AS u(seed)),
a AS (SELECT *, row_number() OVER (PARTITION BY seed, month ORDER BY supp) AS r FROM x), b AS (SELECT seed, month, f_qty, row_number() OVER (PARTITION BY seed, month ORDER BY {seed_sql('seed', 'supp')}, supp) AS r FROM x),
p AS (SELECT a.seed, a.month, a.supp, b.f_qty, a.f_disc, a.y FROM a JOIN b USING (seed, month, r)), null_ AS {_residual_ic('p', 'seed')}, real_ AS {_residual_ic('g', 'seed')}
SELECT round(avg((abs(n.ic) >= abs(r.ic))::INT), 6) AS p, count(*) AS n FROM null_ n, real_ r"""


def permutation(spark, sf_dir):
    """Two-sided share of 50 within-month permutations of a feature whose mean rank correlation beats the real one."""
    p = stored(monthly(spark, sf_dir).filter("y IS NOT NULL").select("supp", "month", "f_qty", "y"), "monthly")
    real = evaluate.spearman(p, ["month"], "f_qty", "y").agg(F.avg("ic").alias("real"))
    null = evaluate.permuted_ics(p, "month", "supp", "f_qty", "y", 50).groupBy("seed").agg(F.avg("ic").alias("ic"))
    return rounded(null.withColumn("one", F.lit(1)).join(real.withColumn("one", F.lit(1)), "one").agg(F.avg((F.abs("ic") >= F.abs("real")).cast("int")).alias("p"), F.count("*").alias("n")))


def composite(spark, sf_dir):
    """Equal-weight composite of the features, each standardised within its month."""
    p = monthly(spark, sf_dir)
    w = Window.partitionBy("month")
    z = [F.coalesce((F.col(f) - F.avg(f).over(w)) / F.when(F.stddev_pop(f).over(w) > 1e-9, F.stddev_pop(f).over(w)), F.lit(0.0)) for f in FEATURES]
    return rounded(p.select("supp", "month", (sum(z[1:], start=z[0]) / len(z)).alias("score")), "supp", "month")


_Z = " + ".join(f"coalesce(({f} - avg({f}) OVER w) / CASE WHEN stddev_pop({f}) OVER w > 1e-9 THEN stddev_pop({f}) OVER w END, 0)" for f in FEATURES)


def separability(spark, sf_dir):
    s = classic.moments(indexed(spark, sf_dir), "user_id", "x").withColumn("grp", F.pmod("user_id", F.lit(3)))
    return rounded(diagrams.separability(s, "grp", "mean", "sd", "skew"), "criterion", "class_a", "class_b")


SEPARABILITY_SQL = f"""
WITH {S}, c AS (SELECT *, x - avg(x) OVER (PARTITION BY user_id) AS c FROM s), f AS (SELECT user_id, user_id % 3 AS grp, avg(x) AS mean, stddev_pop(x) AS sd, avg(c * c * c) / (stddev_pop(x) + 1e-9) ** 3 AS skew FROM c GROUP BY 1),
l AS (SELECT grp, criterion, v FROM f UNPIVOT (v FOR criterion IN (mean, sd, skew))), g AS (SELECT criterion, grp, avg(v) AS mu, stddev_pop(v) AS sd FROM l GROUP BY 1, 2)
SELECT a.criterion, a.grp AS class_a, b.grp AS class_b, round(abs(a.mu - b.mu) / ((a.sd + b.sd) / 2 + 1e-9), 6) AS separability FROM g a JOIN g b ON a.criterion = b.criterion AND a.grp < b.grp"""


def confusion(spark, sf_dir):
    """Order status guessed from the price: confusion counts."""
    o = read(spark, sf_dir, "orders", "o_orderstatus", "o_totalprice")
    return evaluate.confusion(o.withColumn("guess", F.when(F.col("o_totalprice") > 150000, "F").otherwise("O")), [], "o_orderstatus", "guess")


def accuracy(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_orderstatus", "o_totalprice")
    return rounded(evaluate.accuracy_f1(o.withColumn("guess", F.when(F.col("o_totalprice") > 150000, "F").otherwise("O")), "o_orderstatus", "guess"))


ACCURACY_SQL = """
WITH g AS (SELECT o_orderstatus AS y, CASE WHEN o_totalprice > 150000 THEN 'F' ELSE 'O' END AS p FROM orders), c AS (SELECT DISTINCT c FROM (SELECT y AS c FROM g UNION ALL SELECT p FROM g)),
s AS (SELECT c, (SELECT count(*) FROM g WHERE y = c AND p = c) AS tp, (SELECT count(*) FROM g WHERE y = c) AS t, (SELECT count(*) FROM g WHERE p = c) AS q FROM c)
SELECT round(sum(tp) / sum(t), 6) AS accuracy, round(avg(2 * tp / (t + q)), 6) AS macro_f1 FROM s"""

QUERIES = {
    "rank_ic": (rank_ic, f"WITH {MONTHLY}, {LONG} SELECT month, feature, n, round(ic, 6) AS ic FROM {rank_sql('long', 'month, feature', 'x', 'y', 10)}"),
    "purged_folds": (folds, FOLDS_SQL),
    "group_folds": (group_folds, f"WITH g AS (SELECT *, {seed_sql("'1'", 'l_orderkey')} % 5 AS fold FROM lineitem) SELECT fold, count(*) AS n, count(DISTINCT l_orderkey) AS groups, round(sum(l_quantity), 6) AS quantity FROM g GROUP BY 1"),
    "single_split": (single_split, SINGLE_SQL),
    "strat_folds": (strat_folds, f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {seed_sql("'3'", 'vec_id')}, vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT vec_id, label, (r - 1) % 5 AS fold, (r <= floor(n * 0.7))::INT AS train FROM r"),
    "auc": (auc, AUC_SQL),
    "expanding_topk": (expanding, _expanding_sql("SELECT month, feature, rank, round(ic, 6) AS ic FROM sel")),
    "expanding_ic": (expanding_ic, EXPANDING_IC_SQL),
    "expanding_factor": (expanding_factor, _expanding_sql(", u AS (SELECT month FROM sel GROUP BY 1 HAVING sum(abs(ic)) >= 1e-12) SELECT l.month, l.supp, round(sum(l.x * s.ic), 6) AS score FROM long l JOIN sel s USING (month, feature) WHERE l.month IN (SELECT month FROM u) GROUP BY 1, 2")),
    "newey_west": (nw, NW_SQL),
    "ic_summary": (lambda s, d: rounded(evaluate.ic_summary(_monthly_ics(s, d), ["feature"]), "feature", "n"), SUMMARY_SQL),
    "paired_t": (paired, PAIRED_SQL),
    "paired_pvalues": (pvalues, None),
    "residual_one": (residual_1, RESIDUAL_SQL),
    "residual_many": (residual_k, RESIDUAL_MANY_SQL),
    "permutation_null": (permutation, None),
    "permutation_residual": (permutation_residual, PERMUTATION_SQL),
    "composite": (composite, f"WITH {MONTHLY} SELECT supp, month, round(({_Z}) / 5, 6) AS score FROM m WINDOW w AS (PARTITION BY month)"),
    "separability": (separability, SEPARABILITY_SQL),
    "confusion": (confusion, "SELECT o_orderstatus, CASE WHEN o_totalprice > 150000 THEN 'F' ELSE 'O' END AS guess, count(*) AS n FROM orders GROUP BY 1, 2"),
    "accuracy_f1": (accuracy, ACCURACY_SQL),
}
