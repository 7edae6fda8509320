"""Quality rules by robust multivariate outliers: a minimum-covariance-determinant estimate for each language and
source, and rejection of transformed statistic vectors by Mahalanobis distance.

Every text becomes a vector of transformed rates. Each (language, source) with at least MIN_ROWS usable texts has
an estimate of its own; the texts of smaller ones share one of their language, and those of small languages one
for all. Concentration steps keep the SHARE of nearest rows and take their mean and covariance again. They run from
several STARTS side by side (around the coordinates' medians and their quartiles) until no determinant falls any more
(a start that has come to its end takes no part in later steps), and the start with the least determinant stays. All rows of a group take part in every step, as partial sums and
sketched quantiles, so a source with a third of all rows costs no task more than another; the estimates meet the rows
through a counted broadcast or a salted join.

The covariance of n rows is shrunk towards a wide one by PRIOR rows, so that a handful of texts rejects only what lies
far out. The limit of a group lies as many spreads beyond the middle of its own distances as REACH says, so that heavy
tails push it out. Null languages and sources are groups of their own; null and empty texts fail the base rule. Repeated
rows count as often as they stand; extra columns pass through `rejecting` and are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simplicia.llm.common import join_counted, stored, table
from simplicia.llm.textstats import with_counts

#: Production parameters.
MIN_ROWS, SHARE, PRIOR = 80, 0.75, 4
#: Steps end when no log-determinant falls by more than this.
TOLERANCE = 0.001
#: Quantiles of the coordinates around which the steps start.
STARTS = (0.5, 0.25, 0.75)
#: A text goes beyond the median distance plus REACH times the way from the median to the upper quartile. Statistics of
#: sound prose have tails heavier than a Gaussian's, for which this is a squared distance of about 57.
REACH = 10.0
#: Transformed statistics, each with the spread below which differences don't count (it keeps constant columns
#: from making the covariance singular).
FEATURES: dict[str, tuple[str, float]] = {
    "word_length": ("ln(word_chars / n_words + 0.01)", 0.05),
    "symbols": ("sqrt(n_symbols / word_chars)", 0.03),
    "upper": ("sqrt(n_upper / greatest(n_upper + n_lower, 1))", 0.05),
    "dup_lines": ("sqrt(n_dup_lines / greatest(n_lines, 1))", 0.1),
    "repeats": ("sqrt(n_repeat_words / n_words)", 0.1),
    "punctuation": ("sqrt(n_punct / n_words)", 0.05),
    "digits": ("sqrt(n_digits / word_chars)", 0.05),
    "variety": ("ln(n_distinct) / ln(greatest(n_words, 2))", 0.03),
}
P = len(FEATURES)
X = [f"x{i}" for i in range(P)]
#: The limit for a Gaussian: quartiles of chi with P degrees (Wilson and Hilferty).
_CHI = [(P * (1 - 2 / (9 * P) + z * (2 / (9 * P)) ** 0.5) ** 3) ** 0.5 for z in (0.0, 0.6745)]
GAUSSIAN = (_CHI[0] + REACH * (_CHI[1] - _CHI[0])) ** 2


def base_failed() -> Column:
    """Fixed rule of the base contract."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vectors(docs: DataFrame) -> DataFrame:
    """Counts, base_failed and the transformed statistics of every text, rounded to a grid so that sums of rows
    come out alike in any order."""
    found = with_counts(docs, "lang", "source").withColumn("base_failed", base_failed())
    return found.withColumns({x: F.when(~F.col("base_failed"), F.round(F.expr(f) * 1024) / 1024) for x, (f, _) in zip(X, FEATURES.values(), strict=True)})


def grouped(rows: DataFrame) -> DataFrame:
    """Adds g, the group whose estimate judges a row; null where no text of its language and source is usable."""
    lang, own = F.coalesce(F.col("lang"), F.lit("\x00")), F.struct(F.coalesce(F.col("lang"), F.lit("\x00")), F.coalesce(F.col("source"), F.lit("\x00")))
    keyed = rows.withColumns({"_lang": lang, "_own": F.to_json(own)})
    sizes = keyed.filter(~F.col("base_failed")).groupBy("_lang", "_own").count()
    sizes = stored(sizes, "mcd-sizes")
    small = sizes.filter(F.col("count") < MIN_ROWS)
    by_lang = small.groupBy("_lang").agg(F.sum("count").alias("_in_lang"))
    names = sizes.join(by_lang, "_lang", "left").select(
        "_own",
        F.when(F.col("count") >= MIN_ROWS, F.col("_own")).when(F.col("_in_lang") >= MIN_ROWS, F.concat(F.lit("lang "), "_lang")).otherwise(F.lit("all")).alias("g"),
    )
    names = stored(names, "mcd-groups")
    return join_counted(keyed, names, ["_own"], names.count()).drop("_lang", "_own")


def distance(rows: DataFrame, estimates: DataFrame, n: int) -> DataFrame:
    """Adds d2, the squared distance under the estimate (g, mu, w) of a row's group; w whitens. Other columns of the
    estimates stay; a group with several has a row for each."""
    joined = join_counted(rows, estimates, ["g"], n)
    total = None
    for i in range(P):
        z = sum((F.col("w")[i * P + j] * (F.col(X[j]) - F.col("mu")[j]) for j in range(i + 1)), start=F.lit(0.0))
        total = z * z if total is None else total + z * z
    return joined.withColumn("d2", total).drop("mu", "w")


def shrunk(n: int, covariance):
    """The covariance of n rows moved towards a wide one as if by PRIOR rows of it, and never narrower than the spreads."""
    import numpy as np

    spread = np.diag(np.square([e for _, e in FEATURES.values()]))
    return spread + (n * covariance + PRIOR * 16 * spread) / (n + PRIOR)


def whitened(moments: DataFrame) -> DataFrame:
    """Estimates (g, start, mu, w, logdet) from the moments of the groups' nearest rows."""

    def run(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                mu = np.array([getattr(r, f"m{i}") for i in range(P)]) / r.n
                c = np.zeros((P, P))
                for i in range(P):
                    for j in range(i + 1):
                        c[i, j] = c[j, i] = getattr(r, f"c{i}_{j}") / r.n - mu[i] * mu[j]
                # a tiny ridge against rounding; inv(L) whitens: |inv(L)(x - mu)|^2 is the distance
                low = np.linalg.cholesky(shrunk(r.n, c) + 1e-9 * np.eye(P))
                out.append((r.g, r.start, mu.tolist(), np.linalg.inv(low).ravel().tolist(), 2 * float(np.log(np.diag(low)).sum())))
            yield pd.DataFrame(out, columns=["g", "start", "mu", "w", "logdet"])

    return moments.mapInPandas(run, "g string, start int, mu array<double>, w array<double>, logdet double")


def estimate(rows: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimates of all groups: g, mu, w, and limit, the squared distance beyond which a
    row of the group is rejected."""
    usable = rows.filter(F.col("g").isNotNull() & ~F.col("base_failed")).select("g", *X)
    quartiles = usable.groupBy("g").agg(*(F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(x) for x in X))
    scale = [F.sqrt(F.pow((F.col(x)[2] - F.col(x)[0]) / 1.349, 2) + F.lit(e * e)) for x, (_, e) in zip(X, FEATURES.values(), strict=True)]
    w = F.array(*((F.lit(1.0) / scale[i]) if i == j else F.lit(0.0) for i in range(P) for j in range(P)))
    centres = F.array(*(F.struct(F.lit(k).alias("start"), F.array(*(F.col(x)[{0.25: 0, 0.5: 1, 0.75: 2}[q]] for x in X)).alias("mu")) for k, q in enumerate(STARTS)))
    first = quartiles.select("g", w.alias("w"), F.explode(centres).alias("c")).select("g", "c.start", "c.mu", "w", F.lit(float("inf")).alias("logdet"))
    estimates = stored(first, "mcd-start")
    n = estimates.count()
    moving, ended = estimates, []
    while n:
        found = distance(usable, moving.drop("logdet"), n).filter(F.col("start").isNotNull())
        limits = stored(found.groupBy("g", "start").agg(F.percentile_approx("d2", SHARE, 1000).alias("limit")), "mcd-limits")
        near = join_counted(found, limits, ["g", "start"], n, how="inner").filter(F.col("d2") <= F.col("limit"))
        sums = [F.sum(x).alias(f"m{i}") for i, x in enumerate(X)] + [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"c{i}_{j}") for i in range(P) for j in range(i + 1)]
        moved = stored(whitened(near.groupBy("g", "start").agg(F.count("*").alias("n"), *sums)), "mcd-step")
        before = moving.select("g", "start", F.col("logdet").alias("was"))
        fell = moved.join(before, ["g", "start"]).withColumn("fell", F.col("logdet") < F.col("was") - TOLERANCE)
        fell = stored(fell.drop("was"), "mcd-fell")
        ended.append(fell.filter("not fell").drop("fell"))
        moving = fell.filter("fell").drop("fell")
        n = moving.count()
    best = reduce(DataFrame.unionByName, ended, estimates.limit(0)).repartition("g").groupBy("g").agg(F.min_by(F.struct("mu", "w"), F.struct("logdet", "start")).alias("e")).select("g", "e.*")
    best = stored(best, "mcd-best")
    n = best.count()
    spread = distance(usable, best, n).groupBy("g").agg(F.percentile_approx(F.sqrt("d2"), [0.5, 0.75], 1000).alias("q"))
    limit = F.pow(F.col("q")[0] + REACH * (F.col("q")[1] - F.col("q")[0]), 2)
    # of a few rows the quartiles may coincide; a limit is never below that of a Gaussian
    return stored(best.join(spread, "g").select("g", "mu", "w", F.greatest(limit, F.lit(GAUSSIAN)).alias("limit")), "mcd-final")


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, group, distance (squared) and kept."""
    rows = grouped(stored(vectors(docs), "quality-vectors"))
    estimates = estimate(rows)
    out = distance(rows, estimates, estimates.count())
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce(F.col("d2") <= F.col("limit"), F.lit(True)))).alias("kept"),
        F.col("g").alias("estimate_group"), F.col("d2").alias("distance2"),
    )


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
