"""Classification on feature vectors with Spark ML: forests, boosted trees, kernel machines, voting, perceptrons."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplicia.sources.store import stacked, stored


def prepared(df: DataFrame, features: str, label: str) -> DataFrame:
    """features array to vector, label to double."""
    return df.withColumns({"vector": array_to_vector(F.transform(features, lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))), "label": F.col(label).cast("double")})


def forest(trees: int = 100, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, seed=seed, maxDepth=10)


def boosted(rounds: int = 100, depth: int = 3, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(featuresCol="vector", labelCol="label", maxIter=rounds, maxDepth=depth, seed=seed)


def perceptron(layers: list[int], steps: int = 100, seed: int = 42) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(featuresCol="vector", labelCol="label", layers=layers, seed=seed, maxIter=steps, tol=1e-9)


def fourier_features(df: DataFrame, features: str, dim: int, size: int = 200, gamma: float | None = None, seed: int = 42) -> DataFrame:
    """Random Fourier features of the Gaussian kernel exp(-gamma |x - y|^2), as expressions on the scaled array."""
    rng = np.random.default_rng(seed)
    gamma = gamma or 1.0 / dim
    w, b = rng.normal(0, math.sqrt(2 * gamma), (size, dim)), rng.uniform(0, 2 * math.pi, size)
    weights = F.array(*(F.array(*map(F.lit, row.tolist())) for row in w))
    shifts = F.array(*map(F.lit, b.tolist()))
    inner = lambda row: F.aggregate(F.zip_with(row, features, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn(features, F.zip_with(weights, shifts, lambda row, s: F.lit(math.sqrt(2 / size)) * F.cos(inner(row) + s)))


def kernel_machine(df: DataFrame, features: str, dim: int, label: str, size: int = 200) -> tuple[OneVsRest, DataFrame]:
    """A linear machine on random Fourier features: the RBF kernel within the tools of Spark ML."""
    lifted = prepared(fourier_features(df, features, dim, size), features, label)
    return OneVsRest(classifier=LinearSVC(featuresCol="vector", labelCol="label", maxIter=50), featuresCol="vector", labelCol="label"), lifted


def scaled_pipeline(classifier, k: int | None = None) -> Pipeline:
    """Scaling, and on request principal components, fitted inside the training part only."""
    steps = [StandardScaler(inputCol="vector", outputCol="scaled", withMean=True)]
    last = "scaled"
    if k:
        steps.append(PCA(k=k, inputCol="scaled", outputCol="components"))
        last = "components"
    return Pipeline(stages=[*steps, classifier.copy({classifier.featuresCol: last})])


def cross_validated(df: DataFrame, classifier, fold: str, folds: int, keep: list[str], k: int | None = None) -> DataFrame:
    """Out-of-fold predictions: keep, fold, label, prediction; on the first k principal components on request."""
    out = None
    for f in range(folds):
        model: PipelineModel = scaled_pipeline(classifier, k).fit(df.filter(F.col(fold) != f))
        part = model.transform(df.filter(F.col(fold) == f)).select(*keep, fold, "label", "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def against_rest(df: DataFrame, classifier, classes: list[float], fold: str, folds: int, keep: list[str]) -> DataFrame:
    """Out-of-fold probabilities of a two-class learner for any number of classes: one model for each class against the
    rest and each fold, its probabilities scaled to a sum of 1. keep, fold, label, probability (a vector in the order of
    classes) and prediction, ties to the earlier class. df: vector, label and fold; keep names a row."""
    df = stored(df.select(*keep, fold, "label", "vector"), "against-rest")
    fits = [(k, c) for k in range(folds) for c in classes]
    spark = df.sparkSession

    def fitted(at):
        k, c = at
        return classifier.fit(df.filter(F.col(fold) != k).withColumn("label", (F.col("label") == c).cast("double")))

    # a round is some small jobs, so models are fitted side by side
    with ThreadPoolExecutor(len(fits)) as pool:
        models = dict(zip(fits, pool.map(inheritable_thread_target(spark)(fitted), fits), strict=True))
    out = None
    for k in range(folds):
        own = df.filter(F.col(fold) == k).withColumnRenamed("label", "_label")
        for n, c in enumerate(classes):
            model = models[k, c]
            # the models of a fold see its rows one after the other, so no row is shuffled for them
            own = model.transform(own).withColumn(f"_p{n}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        rows = own.select(*keep, fold, F.col("_label").alias("label"), F.array(*(f"_p{n}" for n in range(len(classes)))).alias("p"))
        out = rows if out is None else out.unionByName(rows)
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    share = F.transform("p", lambda x: F.when(total > 0, x / total).otherwise(1.0 / len(classes)))
    scaled = out.withColumn("p", share)
    best = F.get(F.array(*(F.lit(float(c)) for c in classes)), (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    return scaled.select(*keep, fold, "label", array_to_vector("p").alias("probability"), best.alias("prediction"))


def log_loss(predicted: DataFrame) -> DataFrame:
    """One row: loss (mean of -log of the label's probability), accuracy and n. predicted: label, probability, prediction; labels
    number the places of the vector."""
    p = F.get(vector_to_array("probability"), F.col("label").cast("int"))
    return predicted.agg(F.avg(-F.ln(F.greatest(p, F.lit(1e-15)))).alias("loss"), F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("accuracy"), F.count("*").alias("n"))


def two_phases(df: DataFrame, layers: list[int], first: int, second: int, seed: int = 42):
    """A perceptron trained in two phases: the second starts from the weights of the first. Both models; df: vector, label."""
    one = perceptron(layers, first, seed).fit(df)
    return one, perceptron(layers, second, seed).setInitialWeights(one.weights).fit(df)


def soft_votes(predicted: list[DataFrame], key: str) -> DataFrame:
    """key, label and the class with the highest mean probability over several models."""
    long = stacked([p.select(key, "label", vector_to_array("probability").alias("p")) for p in predicted], key)
    got = long.groupBy(key, "label").agg(F.collect_list("p").alias("ps"))  # a row for each model, its classes together
    mean = F.transform(F.get("ps", F.lit(0)), lambda _, c: F.aggregate("ps", F.lit(0.0), lambda a, p: a + F.get(p, c)) / F.size("ps"))
    best = got.select(key, "label", mean.alias("p"))
    return best.select(key, "label", (F.array_position("p", F.array_max("p")) - 1).cast("double").alias("prediction"))


def scaled_population(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as z-scores with the population standard deviation: one row of moments joined to all rows."""
    s = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns))
    return df.join(F.broadcast(s)).withColumns({c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0) for c in columns}).drop(*(f"{k}_{c}" for c in columns for k in "ms"))
