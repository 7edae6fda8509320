"""Hard negatives by exact integer scores, multiplied in a residue number system.

Scores are integer inner products. Components go modulo primes small enough that a float32 product of residues is exact;
as many primes are taken as the norms of a block ask for, and Chinese remaindering (mixed radix with digits around 0)
gives back the signed score. So the fast float32 product serves, and no score is rounded, whatever the size of its
components. Rows and anchors are dealt over tiles of bounded size, each a task's work; from a tile only the best rows of
an anchor go on. The second pass takes the window of each positive and keeps what is first within it.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part, nor do rows
whose squared norm is 2^62 or more, as their scores wouldn't fit a long. Vectors of unlike length have no score with
each other; those without components score 0. Of several rows with one vec_id the least (label, then vector) counts.
An anchor without another row of its label, and a positive without a row in its window, give no rows. Further columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from simplicia.llm.common import stored, table

#: Rows and anchors of a tile at most (on average; tiles are dealt by a hash).
TILE = 65_536
#: Scores of a block: anchors by rows.
ANCHORS, ROWS = 512, 4096
#: Components multiplied before a reduction; with residues of up to half a prime their sum stays below 2^24.
WIDTH = 1024
EXACT = 1 << 24
#: Below every score.
NONE = -(1 << 62) - 1


def moduli(components: int, bound: int) -> list[int]:
    """The largest primes whose residues multiply exactly in float32, until their product exceeds 2 * bound + 1."""
    p, found, product = 2 * math.isqrt(EXACT // max(1, min(components, WIDTH))) + 1, [], 1
    while product <= 2 * bound + 1:
        p -= 1
        if p < 2:
            raise ValueError("the primes are used up")
        if p % 2 and all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            found.append(p)
            product *= p
    return found


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p, from -(p - 1) / 2 to (p - 1) / 2."""
    x = x % p
    return np.where(x > p // 2, x - p, x)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices whose squared norms are below 2^62."""
    largest = lambda m: int((m * m).sum(axis=1).max(initial=0))
    primes = moduli(a.shape[1], math.isqrt(largest(a) * largest(b)) + 1)
    score, weight = np.zeros((len(a), len(b)), np.int64), 1
    for p in primes:
        x, y = _centred(a, p).astype(np.float32), _centred(b, p).astype(np.float32)
        r = np.zeros(score.shape, np.int64)
        for k in range(0, a.shape[1], WIDTH):
            r += (x[:, k : k + WIDTH] @ y[:, k : k + WIDTH].T).astype(np.int64)
        digit = _centred((r - score) % p * pow(weight % p, -1, p), p)
        score += digit * weight
        weight *= p
    return score


class _Best:
    """The k first rows of every slot so far, by falling score, then id."""

    def __init__(self, slots: int, k: int):
        self.k, self.score, self.id = k, np.full((slots, k), NONE), np.zeros((slots, k), np.int64)

    def last(self) -> np.ndarray:
        """The score that a further row has to reach, by slot."""
        return self.score[:, -1]

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        hit = np.unique(slot)
        s, r = np.nonzero(self.score[hit] != NONE)
        slot, score, ids = np.append(slot, hit[s]), np.append(score, self.score[hit[s], r]), np.append(ids, self.id[hit[s], r])
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = rank < self.k
        self.score[slot[keep], rank[keep]], self.id[slot[keep], rank[keep]] = score[keep], ids[keep]

    def rows(self):
        """slot, score and id of what is kept."""
        s, r = np.nonzero(self.score != NONE)
        return s, self.score[s, r], self.id[s, r]


def _pieces(n: int):
    """Runs of columns, short ones first: they set the scores that the others have to reach."""
    i, size = 0, 64
    while i < n:
        yield i, min(n, i + size)
        i, size = i + size, min(ROWS, size * 8)


def _by_length(arrow):
    """(length, row numbers, integer matrix) of the vectors of each length."""
    v = arrow["v"].combine_chunks()
    sizes, flat = v.value_lengths().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)
    begin = np.append(0, np.cumsum(sizes))
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), at, flat[begin[at][:, None] + np.arange(d)].reshape(len(at), int(d)).astype(np.int64)


def _meetings(anchors, rows, same: bool):
    """Blocks of anchors of one label and length with the rows of the same label, or of all others: (anchor numbers, anchor
    matrix, row ids, row matrix)."""
    al, rl, ids = anchors["label"].to_numpy(), rows["label"].to_numpy(), rows["vec_id"].to_numpy()
    by = {d: (at, m) for d, at, m in _by_length(rows)}
    for d, at, m in _by_length(anchors):
        if d not in by:
            continue
        row_at, row_m = by[d]
        for label in np.unique(al[at]):
            of = np.flatnonzero((rl[row_at] == label) == same)
            for i in range(0, len(own := np.flatnonzero(al[at] == label)), ANCHORS):
                part = own[i : i + ANCHORS]
                yield at[part], m[part], ids[row_at[of]], row_m[of]


def _positives(k: int):
    def run(anchors, rows):
        import pyarrow as pa

        best, names = _Best(anchors.num_rows, k), anchors["vec_id"].to_numpy()
        for at, a, ids, b in _meetings(anchors, rows, True):
            for i, j in _pieces(len(ids)):
                s = exact_scores(a, b[i:j])
                x, y = np.nonzero((s >= best.last()[at][:, None]) & (ids[None, i:j] != names[at][:, None]))
                best.offer(at[x], s[x, y], ids[i + y])
        slot, score, found = best.rows()
        return pa.table({"anchor_id": names[slot], "positive_id": found, "positive_score": score})

    return run


def window(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score s with low * positive <= 100 * s <= high * positive, without products beyond a long."""
    q, r = positive // 100, positive % 100
    return low * q - (-low * r) // 100, high * q + (high * r) // 100


def _negatives(k: int, low: int, high: int):
    def run(anchors, rows):
        import pyarrow as pa

        p = anchors["positives"].combine_chunks()
        sizes, flat = p.value_lengths().to_numpy(zero_copy_only=False), p.flatten()
        pid, score = flat.field("positive_id").to_numpy(), flat.field("positive_score").to_numpy()
        first = np.append(0, np.cumsum(sizes))
        least, most = window(score, low, high)
        best, names = _Best(len(pid), k), anchors["vec_id"].to_numpy()
        for at, a, ids, b in _meetings(anchors, rows, False):
            for i, j in _pieces(len(ids)):
                s = exact_scores(a, b[i:j])
                for n in range(int(sizes[at].max(initial=0))):
                    has = np.flatnonzero(sizes[at] > n)
                    slot = first[at[has]] + n
                    x, y = np.nonzero((s[has] <= most[slot][:, None]) & (s[has] >= np.maximum(least[slot], best.last()[slot])[:, None]))
                    best.offer(slot[x], s[has[x], y], ids[i + y])
        slot, found, negative = best.rows()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return pa.table({"anchor_id": names[owner[slot]], "positive_id": pid[slot], "positive_score": score[slot], "negative_id": negative, "negative_score": found})

    return run


def _tiled(anchors: DataFrame, rows: DataFrame, across: int, down: int, run, schema: str) -> DataFrame:
    """run on each tile: a share of the anchors (of `down`) with a share of the rows (of `across`)."""
    n = min(across * down, 20_000)
    share = lambda parts, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    a = anchors.withColumn("_d", share(down, 1)).withColumn("_a", every(across))
    b = rows.withColumn("_a", share(across, 2)).withColumn("_d", every(down))
    tile = (F.col("_d") * across + F.col("_a")).alias("tile")
    a, b = (x.select(tile, *(F.col(c).alias(c) for c in x.columns if c[0] != "_")).repartition(n, "tile") for x in (a, b))
    return a.groupBy("tile").cogroup(b.groupBy("tile")).applyInArrow(run, schema)


def first_rows(df: DataFrame, keys: list[str], score: str, id_: str, k: int) -> DataFrame:
    """The k first rows of each key with their rank; a key has at most k rows from each tile."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), id_)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def integer_vectors(vectors: DataFrame, vector: str, label: Column, scale: float) -> DataFrame:
    """vec_id, label and v, the components times scale rounded down, of the rows that take part: one row for each id."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    inside = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < 2.0**31))
    fits = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x) < 2.0**62
    ok = vectors.filter(F.col("vec_id").isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & F.coalesce(inside, F.lit(False)))
    return ok.select("vec_id", label.cast("int").alias("label"), whole.alias("v")).filter(fits).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. vectors: vec_id, label and integer v, one
    row an id. For each anchor and each of its first `positives` rows of the same label: the first `negatives` rows of other
    labels whose score is from low to high percent of the positive's."""
    spark = vectors.sparkSession
    rows = stored(vectors, "vectors")
    n, a = rows.agg(F.count("*"), F.count_if(anchor)).collect()[0]
    across, down = max(-(-n // TILE), int(spark.conf.get("spark.sql.shuffle.partitions"))), max(1, -(-a // TILE))
    chosen = rows.filter(anchor)
    found = _tiled(chosen, rows, across, down, _positives(positives), "anchor_id bigint, positive_id bigint, positive_score bigint")
    best = stored(first_rows(found, ["anchor_id"], "positive_score", "positive_id", positives), "positives")
    lists = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    met = _tiled(chosen.join(lists, "vec_id"), rows, across, down, _negatives(negatives, low, high), "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    out = first_rows(met, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = integer_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), "embedding", moved, 256.0)
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH f AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM f),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
