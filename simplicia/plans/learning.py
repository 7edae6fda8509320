"""Queries that learn: topological against classical features of series, and labelled vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplicia.operators import classic, diagrams, evaluate, learn, ranks
from simplicia.plans.series import indexed, rounded
from simplicia.plans.shapes import h0
from simplicia.sources.store import stored
from simplicia.streaming.series import windowed_moments


def labelled_vectors(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return learn.prepared(evaluate.stratified(e, "label", "vec_id", 3, 0.7), "embedding", "label").select("vec_id", "vector", "label", "fold")


def forest_accuracy(spark, sf_dir):
    """Out-of-fold accuracy and macro F1 of a forest on labelled vectors."""
    out = learn.cross_validated(stored(labelled_vectors(spark, sf_dir), "vectors"), learn.forest(20), "fold", 3, ["vec_id"])
    return rounded(evaluate.accuracy_f1(out, "label", "prediction"))


def topology_against_classic(spark, sf_dir):
    """Area under the curve of a forest that tells volatile series (variance above the median of all) apart: by the
    vector of the H0 diagram, by classical moments, by both."""
    s = indexed(spark, sf_dir)
    m = stored(classic.moments(s, "user_id", "x"), "moments")
    cut = ranks.column_quantiles(m, ["sd"], 0.5).select(F.col("sd").alias("cut"))
    topo = diagrams.fixed_vectors(h0(spark, sf_dir), "user_id", 0.0, 200.0, 12, 2).withColumnRenamed("vector", "topo")
    base = m.join(F.broadcast(cut)).select("user_id", (F.col("sd") > F.col("cut")).cast("int").alias("y"), F.array("mean", "skew", "kurtosis").alias("classic"))
    df = stored(evaluate.stratified(base.join(topo, "user_id").withColumn("both", F.concat("classic", "topo")), "y", "user_id", 3, 0.7), "vectors")  # read by every fit
    rows = None
    for name in ("topo", "classic", "both"):
        ready = learn.prepared(df, name, "y").select("user_id", "vector", "label", "fold")
        out = learn.cross_validated(ready, learn.forest(20), "fold", 3, ["user_id"])
        part = evaluate.accuracy_f1(out, "label", "prediction").withColumn("features", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return rounded(rows, "features")


STATUS = ("F", "O", "P")


def orders_ready(spark, sf_dir) -> DataFrame:
    """Orders by date, price and priority, with their status as label (a place of STATUS) and a fold."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority").filter(F.col("o_orderstatus").isin(*STATUS))
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    features = F.array(day, F.col("o_totalprice").cast("double") / 1000, F.substring("o_orderpriority", 1, 1).try_cast("double"))
    label = F.array_position(F.array(*map(F.lit, STATUS)), F.col("o_orderstatus")) - 1
    df = evaluate.stratified(o.withColumns({"features": features, "status": label}), "status", "o_orderkey", 2, 0.7)
    return learn.prepared(df, "features", "status").select("o_orderkey", "vector", "label", "fold")


def boosted_votes(spark, sf_dir):
    """Out-of-fold accuracy and macro F1 for the status of orders: 100 rounds of boosted trees of each class against the rest, a
    forest of 100 trees, and the vote of both by their mean probability."""
    df, classes = stored(orders_ready(spark, sf_dir), "orders"), [float(k) for k in range(len(STATUS))]
    boosted = stored(learn.against_rest(df, learn.boosted(), classes, "fold", 2, ["o_orderkey"]), "boosted")
    forest = None
    for k in range(2):
        model = learn.forest().fit(df.filter(F.col("fold") != k))
        part = model.transform(df.filter(F.col("fold") == k)).select("o_orderkey", "label", "probability", "prediction")
        forest = part if forest is None else forest.unionByName(part)
    forest = stored(forest, "forest")
    voted = learn.soft_votes([boosted, forest], "o_orderkey")
    rows = [evaluate.accuracy_f1(p.select("label", "prediction"), "label", "prediction").withColumn("model", F.lit(name)) for name, p in (("boosted", boosted), ("forest", forest), ("vote", voted))]
    return rounded(rows[0].unionByName(rows[1]).unionByName(rows[2]), "model")


def two_phase_training(spark, sf_dir):
    """Loss and accuracy on its training rows of a perceptron after each of two phases, the second from the weights of the first:
    whether a series is volatile, by the longest bars of its H0 diagram."""
    m = stored(classic.moments(indexed(spark, sf_dir), "user_id", "x"), "moments")
    cut = ranks.column_quantiles(m, ["sd"], 0.5).select(F.col("sd").alias("cut"))
    top = diagrams.top_k(h0(spark, sf_dir), "user_id", 5).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "persistence"))), lambda x: x["persistence"] / 100).alias("top"))
    df = m.join(F.broadcast(cut)).select("user_id", (F.col("sd") > F.col("cut")).cast("int").alias("y")).join(top, "user_id")
    df = stored(learn.prepared(df, "top", "y").select("user_id", "vector", "label"), "phases")
    models = learn.two_phases(df, [5, 8, 2], 5, 20)
    rows = [learn.log_loss(model.transform(df)).withColumn("phase", F.lit(k + 1)) for k, model in enumerate(models)]
    return rounded(rows[0].unionByName(rows[1]), "phase", "n")


def components_accuracy(spark, sf_dir):
    """Out-of-fold accuracy of a forest on labelled vectors: scaled, and on their first eight principal components, both
    fitted inside the training folds."""
    df = stored(labelled_vectors(spark, sf_dir), "vectors")
    rows = [evaluate.accuracy_f1(learn.cross_validated(df, learn.forest(10), "fold", 3, ["vec_id"], k), "label", "prediction").withColumn("components", F.lit(k or 64)) for k in (None, 8)]
    return rounded(rows[0].unionByName(rows[1]), "components")


def hourly(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "value")
    out = windowed_moments(e, "event_type", "ts", "value", "1 day")
    return rounded(out.withColumn("start", F.date_format("start", "yyyy-MM-dd")), "event_type", "start", "n")


QUERIES = {
    "forest_accuracy": (forest_accuracy, None),
    "topology_against_classic": (topology_against_classic, None),
    "boosted_votes": (boosted_votes, None),
    "two_phase_training": (two_phase_training, None),
    "components_accuracy": (components_accuracy, None),
    "windowed_moments": (hourly, "SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM events GROUP BY 1, 2"),
}
