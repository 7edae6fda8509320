"""Quality classifier: a generalised additive model with pairwise interactions. Cyclic boosting of shallow trees
learns one lookup table for each feature and each chosen pair of features; a score is the logistic of the sum of
the bins a text falls into.

Features are rates of the whole text only; language, source, id and labels are never inputs. The model is fitted
on at most TRAIN_ROWS labelled rows, picked by a hash of doc_id (a bounded sample, a few MB, whatever the corpus);
every text is scored, in one pass over a narrow table of counts. Null and empty texts have zero rates and get
the score of their bins like any other; without labels every score is 0.5; unlabelled and null-labelled rows
teach nothing; repeated rows count as often as they stand; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplicia.llm.common import crc_mod5, stored, table
from simplicia.llm.textstats import COUNTS, with_counts

#: Production parameters: bound of the training sample, bins of a feature and of a side of a pair, rounds over all
#: features, pairs, step, leaves of a tree.
TRAIN_ROWS, BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAVES = 60_000, 64, 8, 60, 20, 6, 0.15, 3
#: Fixed value of the contract.
CUT = 0.3

FEATURE_NAMES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "variety", "upper", "digits", "punctuation", "high_bytes", "ends", "adjacent", "upper_words", "long_words", "line_words"]


def features(c: np.ndarray) -> np.ndarray:
    """Rates of texts from their COUNTS, one row each."""
    x = dict(zip(COUNTS, c.astype(float).T, strict=True))
    n, chars, lines = np.maximum(x["n_words"], 1), np.maximum(x["word_chars"], 1), np.maximum(x["n_lines"], 1)
    return np.stack(
        [
            np.log1p(x["n_words"]), x["word_chars"] / n, x["n_symbols"] / chars, x["n_dup_lines"] / lines, x["n_repeat_words"] / n,
            np.log(np.maximum(x["n_distinct"], 1)) / np.log(np.maximum(n, 2)), x["n_upper"] / chars, x["n_digits"] / chars, x["n_punct"] / n,
            x["n_high"] / chars, x["n_ends"] / n, x["n_adjacent"] / n, x["n_upper_words"] / n, x["n_long_words"] / n, np.log1p(n / lines),
        ],
        axis=1,
    )


@dataclass
class Model:
    """cuts: inner bin borders of each feature; tables: score of each bin; pairs: (a, b, table of coarse bins)."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for i, (cut, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += t[np.searchsorted(cut, x[:, i], side="right")]
        for a, b, t in self.pairs:
            total += t[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _steps(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Newton steps of a tree over ordered bins with gradient sums g and curvature sums h: the best border is cut
    again and again until there are enough leaves."""
    value = lambda a, b: G[b] - G[a], lambda a, b: H[b] - H[a] + 1.0
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gain = (G[m] - G[a]) ** 2 / (H[m] - H[a] + 1) + (G[b] - G[m]) ** 2 / (H[b] - H[m] + 1) - (G[b] - G[a]) ** 2 / (H[b] - H[a] + 1)
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], k, int(m[at]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = value[0](a, b) / value[1](a, b)
    return out


def _pair_steps(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree of depth two over a grid: the first cut on either side, then each half cut on the other side."""
    best = (-1.0, None)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for m in range(1, gg.shape[0]):
            out, gain = np.zeros_like(gg), 0.0
            for rows in (slice(0, m), slice(m, None)):
                step = _steps(gg[rows].sum(0), hh[rows].sum(0), 2)
                out[rows] = step
                gain += float((step * gg[rows].sum(0)).sum())
            if gain > best[0]:
                best = (gain, out.T if flip else out)
    return best[1], best[0]


def _borders(v: np.ndarray, bins: int) -> np.ndarray:
    q = np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))
    return q[q > v.min()] if len(q) else q


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosts over the features in turn, then over the pairs that explain most of what is left."""
    if not len(y):
        return Model()
    m = Model(float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    p = x.shape[1]
    m.cuts = [_borders(x[:, i], BINS) for i in range(p)]
    m.coarse = [_borders(x[:, i], PAIR_BINS) for i in range(p)]
    m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
    at = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(m.cuts)]
    rough = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(m.coarse)]
    total = np.full(len(y), m.intercept)

    def slopes():
        q = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - q, q * (1 - q)

    for _ in range(ROUNDS):
        for i in range(p):
            g, h = slopes()
            step = RATE * _steps(np.bincount(at[i], g, len(m.tables[i])), np.bincount(at[i], h, len(m.tables[i])), LEAVES)
            m.tables[i] += step
            total += step[at[i]]
    grid = lambda a, b, v: np.bincount(rough[a] * (len(m.coarse[b]) + 1) + rough[b], v, (len(m.coarse[a]) + 1) * (len(m.coarse[b]) + 1)).reshape(len(m.coarse[a]) + 1, -1)
    g, h = slopes()
    gains = sorted(((_pair_steps(grid(a, b, g), grid(a, b, h))[1], a, b) for a in range(p) for b in range(a) if len(m.coarse[a]) and len(m.coarse[b])), reverse=True)
    chosen = [(a, b, np.zeros((len(m.coarse[a]) + 1, len(m.coarse[b]) + 1))) for _, a, b in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, t in chosen:
            g, h = slopes()
            step = RATE * _pair_steps(grid(a, b, g), grid(a, b, h))[0]
            t += step
            total += step[rough[a], rough[b]]
    m.pairs = chosen
    return m


def training_rows(counted: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the training fold, at most about `bound` rows by a hash of doc_id."""
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isNotNull() & (crc_mod5(F.col("doc_id")) != 0))
    n = taught.count()
    if n > bound:
        taught = taught.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < bound)
    got = taught.join(counted, "doc_id").select("quality", *COUNTS).toPandas()
    return features(got[COUNTS].to_numpy().reshape(-1, len(COUNTS))), (got["quality"].to_numpy() > 0).astype(float)


def scored(counted: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of a table of counts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            c = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, len(COUNTS) + 1)], axis=1) if batch.num_rows else np.zeros((0, len(COUNTS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features(c)))], names=["doc_id", "score"])

    return counted.select("doc_id", *COUNTS).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of every document."""
    counted = stored(with_counts(docs), "gam-counts")
    return scored(counted, fit(*training_rows(counted, labels)))


def op4_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return out.select("doc_id", F.coalesce(crc_mod5(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
