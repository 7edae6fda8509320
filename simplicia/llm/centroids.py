"""Exact centroid clustering over zone maps: vectors in the order of a Hilbert curve, in blocks with min/max boxes.

Near vectors meet in a block, so its box is small. For a block only centroids that can be nearest to some point of the box
are compared: a centroid is left out if another one is nearer on the whole box (the difference of two squared distances is
linear, so its least value over a box is found exactly, corner by corner). What is left is compared exactly, a block at a
time. The blocks are written once; each round reads them, sums inside tasks and sends one row for each cluster and
component. The driver holds the k centroids only.

Defined results: vectors with another number of components, a null or non-finite one, or one whose integer is beyond 2^27
(where distances don't fit a long) are left out. Rows that repeat are vectors of their own; rows without a vec_id are
assigned, but don't start a centroid. Fewer than k vectors give as many centroids. A sum of distances beyond a long is
null. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplicia.llm.common import stored, table

#: Vectors of a block.
BLOCK = 256
#: Bits of a component in the curve's key.
BITS = 2
LONGEST = 1 << 27


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """The position of every row of cell numbers (below 2^bits) on the Hilbert curve over as many dimensions as there are
    columns, as a big-endian key."""
    x = cells.astype(np.uint32).T.copy()
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:  # undo the rotations from the top down
        for i in range(n):
            up = (x[i] & bit) > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & (bit - 1))
            x[0] ^= np.where(up, bit - 1, swap).astype(np.uint32)
            x[i] ^= swap.astype(np.uint32)
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    fix, bit = np.zeros(x.shape[1], np.uint32), 1 << (bits - 1)
    while bit > 1:
        fix ^= np.where(x[-1] & bit, bit - 1, 0).astype(np.uint32)
        bit >>= 1
    x ^= fix
    planes = np.concatenate([(x >> b & 1).astype(np.uint8) for b in range(bits - 1, -1, -1)])
    return [row.tobytes() for row in np.packbits(planes.T, axis=1)]


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def _ranges(batches):
    """dim, least, most, n, s and ss (sum and sum of squares, for the spread) of a task's vectors."""
    import pyarrow as pa

    lo = hi = s = ss = None
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        v = _matrix(b.column("v")).astype(np.float64)
        part = v.min(axis=0), v.max(axis=0), v.sum(axis=0), (v * v).sum(axis=0)
        lo, hi, s, ss = part if lo is None else (np.minimum(lo, part[0]), np.maximum(hi, part[1]), s + part[2], ss + part[3])
        n += b.num_rows
    if n:
        yield pa.RecordBatch.from_pydict({"dim": np.arange(len(lo), dtype=np.int32), "least": lo, "most": hi, "n": np.full(len(lo), n), "s": s, "ss": ss})


def _keyed(order: np.ndarray, least: np.ndarray, most: np.ndarray):
    step = np.maximum(most - least, 1) / (1 << BITS)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                cells = np.clip((_matrix(b.column("v")) - least) / step, 0, (1 << BITS) - 1).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(hilbert_keys(cells[:, order], BITS), pa.binary())], ["vec_id", "v", "key"])

    return run


def _blocks(batches):
    """Rows of BLOCK vectors at most: ids, integers and the box."""
    import pyarrow as pa

    for b in batches:
        for i in range(0, b.num_rows, BLOCK):
            part = b.slice(i, BLOCK)
            v = _matrix(part.column("v")).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.column("vec_id")], pa.list_(pa.int64())), pa.array([v.tobytes()], pa.binary()), pa.array([v.min(axis=0)], pa.list_(pa.int32())), pa.array([v.max(axis=0)], pa.list_(pa.int32()))],
                ["ids", "v", "least", "most"],
            )


def blocks(vectors: DataFrame, components: int) -> DataFrame:
    """Blocks (ids, v, least, most) of vectors in the order of the curve. vectors: vec_id, integer v. Components go in by
    falling spread, as the first ones split the order first; equal vectors are dealt by row, so copies fill blocks of their own
    in more than one task."""
    ranges = vectors.mapInArrow(_ranges, "dim int, least double, most double, n bigint, s double, ss double")
    got = ranges.groupBy("dim").agg(F.min("least"), F.max("most"), F.sum("n"), F.sum("s"), F.sum("ss")).orderBy("dim").collect()
    if not got:
        return vectors.sparkSession.createDataFrame([], "ids array<bigint>, v binary, least array<int>, most array<int>")
    least, most, n, s, ss = (np.array([r[i] for r in got], float) for i in range(1, 6))
    order = np.argsort(-(ss / n - (s / n) ** 2), kind="stable")
    keyed = vectors.mapInArrow(_keyed(order, least, most), "vec_id bigint, v array<int>, key binary").withColumn("row", F.xxhash64("vec_id", F.monotonically_increasing_id()))
    parts = max(int(n[0]) // (64 * BLOCK), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = keyed.repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row").select("vec_id", "v")
    return dealt.mapInArrow(_blocks, "ids array<bigint>, v binary, least array<int>, most array<int>")


def candidates(least: np.ndarray, most: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers, in order, of the centroids that may be nearest to a point of the box."""
    middle = (least + most) // 2
    best = int(np.argmin(((centroids - middle) ** 2).sum(axis=1)))
    w = centroids - centroids[best]
    apart = (centroids**2).sum(axis=1) - (centroids[best] ** 2).sum() + np.minimum(-2 * least * w, -2 * most * w).sum(axis=1)
    return np.flatnonzero(apart <= 0)


def squared_distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, by a product of doubles where all its sums stay below 2^53."""
    reach = int(np.abs(v).max(initial=0)) + int(np.abs(centroids).max(initial=0))
    if v.shape[1] * reach**2 < 1 << 52:
        x, c = v.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _assigned(centroids: np.ndarray, batches):
    """Of every block: its ids, vectors, clusters and squared distances."""
    for b in batches:
        for ids, raw, least, most in zip(b.column("ids"), b.column("v"), _matrix(b.column("least")).astype(np.int64), _matrix(b.column("most")).astype(np.int64), strict=True):
            of = candidates(least, most, centroids)
            v = np.frombuffer(raw.as_py(), np.int32).reshape(-1, centroids.shape[1]).astype(np.int64)
            d = squared_distances(v, centroids[of])
            at = d.argmin(axis=1)
            yield ids.values, v, of[at], d[np.arange(len(v)), at]


def _sums(centroids: np.ndarray):
    k, dims = centroids.shape

    def run(batches):
        import pyarrow as pa

        n, s, high, low = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), [0] * k, [0] * k
        for _, v, at, d in _assigned(centroids, batches):
            for c in np.unique(at):
                of = at == c
                n[c] += of.sum()
                s[c] += v[of].sum(axis=0)
                high[c] += int((d[of] >> 32).sum())
                low[c] += int((d[of] & 0xFFFFFFFF).sum())
        for c in np.flatnonzero(n):
            yield pa.RecordBatch.from_pydict({"cluster": np.full(dims, c, np.int32), "dim": np.arange(dims, dtype=np.int32), "n": np.full(dims, n[c]), "s": s[c], "high": np.full(dims, high[c]), "low": np.full(dims, low[c])})

    return run


def _round(zones: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, np.ndarray, int]]:
    """cluster: number of vectors, their sum and the sum of squared distances; of the clusters that have any."""
    got = zones.mapInArrow(_sums(centroids), "cluster int, dim int, n bigint, s bigint, high bigint, low bigint").groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    out: dict = {}
    for r in got.collect():  # k centroids of so many components
        n, s, _ = out.setdefault(r["cluster"], (r["n"], np.zeros(centroids.shape[1], np.int64), (r["high"] << 32) + r["low"]))
        s[r["dim"]] = r["s"]
    return out


def _final(centroids: np.ndarray, inertia: list[int | None], total: int | None):
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches):
        import pyarrow as pa

        kinds, named = pa.array(inertia, pa.int64()), pa.array(names)
        for ids, _, at, d in _assigned(centroids, batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int32()), pa.array(d, pa.int64()), kinds.take(pa.array(at)), pa.array([total] * len(at), pa.int64()), named.take(pa.array(at))], ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return run


def integer_vectors(vectors: DataFrame, vector: str, components: int, scale: float) -> DataFrame:
    """vec_id and v, the components times scale rounded down, of the vectors that can be clustered."""
    inside = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float(LONGEST)))
    ok = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) == components) & F.coalesce(inside, F.lit(False)))
    return ok.select("vec_id", F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def clustered(vectors: DataFrame, components: int, k: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every row of vectors (vec_id, integer v).
    The first centroids are the vectors with the least sha256 of 'seed:vec_id'; each round assigns all vectors to the
    nearest (ties: the smaller number) and moves a centroid to the mean of its vectors, rounded down."""
    schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    rows = stored(vectors, "vectors")
    drawn = rows.filter(F.col("vec_id").isNotNull()).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    if not drawn:
        return vectors.sparkSession.createDataFrame([], schema)
    centroids = np.array([r["v"] for r in sorted(drawn, key=lambda r: (r["h"], r["v"]))], np.int64)
    zones = stored(blocks(rows, components), "zones")
    for _ in range(rounds):
        for c, (n, s, _) in _round(zones, centroids).items():
            centroids[c] = s // n
    last = _round(zones, centroids)
    fits = lambda x: x if x < 1 << 63 else None
    inertia = [fits(last[c][2]) if c in last else 0 for c in range(len(centroids))]
    return zones.mapInArrow(_final(centroids, inertia, fits(sum(x[2] for x in last.values()))), schema)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(integer_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "embedding", 64, 64.0), 64)


def _sql(rounds: int = 3) -> str:
    near = "list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    ctes = [
        "k AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM k WHERE vec_id IS NOT NULL QUALIFY c < 16)",
    ]
    for i in range(rounds + 1):
        ctes.append(f"a{i} AS MATERIALIZED (SELECT row, vec_id, k.v, c.c, {near} AS d FROM k, c{i} c QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c.c) = 1)")
        if i < rounds:
            mean = "(s - ((s % n) + n) % n) // n"
            ctes.append(f"s{i} AS (SELECT c, pos, sum(v[pos])::BIGINT AS s, count(*) AS n FROM a{i}, unnest(range(1, 65)) AS u(pos) GROUP BY 1, 2)")
            ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT c, list({mean} ORDER BY pos) AS v FROM s{i} GROUP BY 1) m USING (c))")
    return f"WITH {', '.join(ctes)} SELECT vec_id, a.c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c USING (c)"


OP12_SQL = _sql()
