"""Removal of repeated passages by level-wise doubling: windows repeated at one length alone are extended to twice it.

The first level takes windows of half the length asked for. Of these only seeds are looked at: each full window is
represented by the half window in it with the least hash (the leftmost of equals), so equal full windows have equal seeds
at equal places and no repeat is lost, while a quarter of the places is enough. A seed that stands in one document
only ends there; only the full windows around the others are formed and go to the second level, at which
the windows asked for are reached. `longest_repeats` doubles on from there until no candidates survive.

Every level is the same step (`_repeated`): minima and maxima of doc_id for each hash, combined before the shuffle, so a
passage that a third of the documents share is no large group; then a join back, whose hot keys Spark splits, as the
other side has one row for each key. Windows are told apart by 96 bits of hash. Stages are written to the shared folder;
those that are done with, and their shuffle files, are deleted in between.

Defined results: words are runs of characters other than ASCII white space. A null or empty text has no words and keeps
the hash of the empty string. Rows that share a doc_id are one document and don't remove each other's passages, but each
keeps its own text; rows without a doc_id neither remove nor lose words. Texts with fewer words than a window stay. Further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplicia.llm.common import chunked, raw_texts, release, sliced, stored, table, words_of

#: Fixed odd multipliers of the hash that joins two halves.
MIX = ((0xBF58476D1CE4E5B9, 0x94D049BB133111EB), (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
WINDOW = 13


def joined(a: np.ndarray, b: np.ndarray, family: int = 0) -> np.ndarray:
    """Hashes of what a and b stand for, one after the other."""
    first, second = (np.uint64(m) for m in MIX[family])
    z = (a ^ (a >> np.uint64(29))) * first + b
    z = (z ^ (z >> np.uint64(32))) * second
    return z ^ (z >> np.uint64(29))


def window_hashes(words: np.ndarray, length: int, family: int = 0) -> np.ndarray:
    """Hashes of all windows of `length` words: powers of two by doubling, the rest by two windows that overlap."""
    h, size = words, 1
    while size < length:
        step = min(size, length - size)
        if len(h) <= step:
            return h[:0]
        h, size = joined(h[:-step], h[step:], family), size + step
    return h


def half(length: int) -> int:
    return (length + 1) // 2


def seeds(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of `length` words the place of its seed, and the hashes of all half windows."""
    h = window_hashes(words, half(length))
    n = len(words) - length + 1
    if n < 1:
        return np.zeros(0, np.int64), h
    least, at = h[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, length - half(length) + 1):
        lower = h[k : n + k] < least
        least[lower], at[lower] = h[k : n + k][lower], k
    return at + np.arange(n), h


def _word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, one text after the other, and their number in each text."""
    import xxhash

    distinct, at, sizes = words_of(raws)
    of = np.fromiter((xxhash.xxh3_64_intdigest(w.as_buffer()) for w in distinct), np.uint64, len(distinct))
    return of[at], sizes


def _batches(batches, text: int):
    """(batch part, word hashes, word numbers by text, first word of each text, text of each word)."""
    for batch in sliced(batches):
        raws = raw_texts(batch.column(text))
        for i, j in chunked(raws):
            words, sizes = _word_hashes(raws[i:j])
            yield batch.slice(i, j - i), words, sizes, np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)


def _whole(of: np.ndarray, length: int) -> np.ndarray:
    """Which windows lie inside one text."""
    return of[: len(of) - length + 1] == of[length - 1 :] if len(of) >= length else np.zeros(0, bool)


def _rows(part, of: np.ndarray, at: np.ndarray, begin: np.ndarray, **columns):
    import pyarrow as pa

    own = pa.array(of[at])
    return pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), pa.array((at - begin[of[at]]).astype(np.int32)), *map(pa.array, columns.values())], ["doc_id", "row", "pos", *columns])


def _seed_rows(length: int):
    def run(batches):
        for part, words, _, begin, of in _batches(batches, 2):
            at, h = seeds(words, length)
            found = np.unique(at[_whole(of, length)])
            if len(found):
                yield _rows(part, of, found, begin, h1=(h[found] >> np.uint64(16)).astype(np.int64))

    return run


def _extended(length: int):
    """The full windows whose seed is among the places of their row."""

    def run(batches):
        for part, words, _, begin, of in _batches(batches, 2):
            places = part.column(3)
            kept = np.zeros(len(words) + 1, bool)
            sizes = places.value_lengths().to_numpy(zero_copy_only=False)
            kept[np.repeat(begin, sizes) + places.flatten().to_numpy(zero_copy_only=False)] = True
            at, _ = seeds(words, length)
            found = np.flatnonzero(_whole(of, length) & kept[at])
            if len(found):
                one, two = window_hashes(words, length), window_hashes(words, length, 1)
                yield _rows(part, of, found, begin, h1=one[found].view(np.int64), h2=(two[found] >> np.uint64(32)).astype(np.uint32).view(np.int32))

    return run


def _repeated(windows: DataFrame, keys: list[str], later: bool, name: str) -> DataFrame:
    """doc_id, row and the places of the windows (doc_id, row, pos, keys; a stored table, which goes) whose keys stand in more
    than one document; with `later` of those that stand in an earlier document than their own."""
    spark = windows.sparkSession
    documents = windows.groupBy(*keys).agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).filter("_first < _last").drop("_last")
    documents = stored(documents, f"{name}-keys")
    release(spark)
    found = windows.join(documents.hint("shuffle_hash"), keys)
    found = found.filter(F.col("doc_id") > F.col("_first")) if later else found
    places = stored(found.groupBy("doc_id", "row").agg(F.collect_list("pos").alias("places")), name)
    release(spark, windows, documents)
    return places


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text, which tells rows of one doc_id apart) and text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def _doubled(rows: DataFrame, length: int) -> DataFrame:
    """doc_id, row, pos, h1, h2: the windows of `length` words whose seed stands in more than one document; a stored table."""
    spark, named = rows.sparkSession, rows.filter(F.col("doc_id").isNotNull())
    kind = "doc_id long, row long, pos int, "
    first = stored(named.mapInArrow(_seed_rows(length), kind + "h1 long"), "substring-seeds")
    candidates = _repeated(first, ["h1"], later=False, name="substring-candidates")
    # no name holds the join, or its shuffle files would stay as long as this call
    second = stored(
        named.join(candidates.hint("shuffle_hash"), ["doc_id", "row"]).select("doc_id", "row", "text", "places").mapInArrow(_extended(length), kind + "h1 long, h2 int"),
        "substring-windows",
    )
    release(spark, candidates)
    return second


def repeated_windows(rows: DataFrame, length: int = WINDOW) -> DataFrame:
    """doc_id, row and places: the windows of `length` words that start in an earlier document too. rows: of `keyed`."""
    return _repeated(_doubled(rows, length), ["h1", "h2"], later=True, name="substring-repeats")


def longest_repeats(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """doc_id and longest of every row of docs: the greatest of length, 2 * length, 4 * length and so on at which one of its
    windows starts in an earlier document too; 0 if none does. Windows that repeat at one length alone are extended, each by
    the one that begins where it ends, until no candidates survive."""
    spark, rows, keys = docs.sparkSession, keyed(docs), ["h1", "h2"]
    level, size, found = _doubled(rows, length), length, []
    while True:
        documents = stored(level.groupBy(*keys).agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).filter("_first < _last").drop("_last"), "substring-keys")
        met = stored(level.join(documents.hint("shuffle_hash"), keys), "substring-survivors")
        release(spark, level, documents)
        if met.isEmpty():
            break
        found.append(stored(met.filter(F.col("doc_id") > F.col("_first")).select("doc_id", "row").distinct().withColumn("longest", F.lit(size)), "substring-longest"))
        behind = met.select("doc_id", "row", (F.col("pos") - size).alias("pos"), F.col("h1").alias("g1"), F.col("h2").alias("g2"))
        longer = met.join(behind, ["doc_id", "row", "pos"]).select("doc_id", "row", "pos", F.xxhash64(*keys, "g1", "g2").alias("h1"), F.hash(*keys, "g1", "g2").alias("h2"))
        level, size = stored(longer, "substring-windows"), 2 * size
    own = rows.select("doc_id", "row")
    if not found:
        return own.select("doc_id", F.lit(0).alias("longest"))
    best = reduce(DataFrame.unionByName, found).repartition("doc_id", "row").groupBy("doc_id", "row").agg(F.max("longest").alias("longest"))
    return own.join(best, ["doc_id", "row"], "left").select("doc_id", F.coalesce("longest", F.lit(0)).alias("longest"))


def _cut(length: int):
    """Kept words of every row, joined by one space, as text or as a hash."""

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            n, removed, names, texts = [], [], [], []
            for raw, places in zip(raw_texts(batch.column(1)), batch.column(2), strict=True):
                words = raw.split()
                n.append(len(words))
                if places.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = places.values.to_numpy(zero_copy_only=False)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + length, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                removed.append(n[-1] - len(words))
                text = b" ".join(words)
                texts.append(text)
                names.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(names, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def without_repeats(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept, the text without repeated windows, of every row of docs (doc_id,
    text)."""
    rows = keyed(docs)
    found = repeated_windows(rows, length)
    met = rows.join(found.hint("shuffle_hash"), ["doc_id", "row"], "left").select("doc_id", "text", "places")
    return met.mapInArrow(_cut(length), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).drop("kept")


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT r, doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM d, unnest(range(1, len(w) - 11)) AS u(i) WHERE len(w) >= 13),
f AS (SELECT s, min(doc_id) AS first FROM p GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
x AS (SELECT DISTINCT r, i + k AS i FROM p JOIN f USING (s), unnest(range(0, 13)) AS v(k) WHERE doc_id > first),
g AS (SELECT r, list(i) AS gone FROM x GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, len(coalesce(gone, []))::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256 FROM d LEFT JOIN g USING (r)"""
