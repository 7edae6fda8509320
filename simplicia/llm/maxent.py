"""LM scoring: a hashed maximum-entropy model with n-gram and skip features and a class-factored softmax.

Words fall into classes of about equal mass by their frequency, and the words of a class into bins of about equal
mass; a class of no more than BINS words has a bin for each. The rare and the unknown share the last class.
P(word | history) = P(class | history) * P(bin | class, history) * P(word | bin): two trained softmaxes, and within a bin,
which mostly is one word, the words' shares of its mass. The features (last word, last two words, the word before the
last, the third last) are hashed into two weight matrices, for the second one together with the class. Rows and
classes grow with the distinct words of the training texts (`model_size`). An epoch runs over all training texts: every
task makes gradient updates on a copy of the weights, and Spark averages what the tasks changed, row by row of the
matrices. Texts are scored in sparse numpy batches.

Counts cover all training tokens. The most frequent FREQUENT words (a bound, not a cap: the rest take the join)
go to the tasks as a broadcast; tokens beyond them are looked up by a shuffled join on the word, so no task holds
the vocabulary. A null or empty text is one end token. Repeated rows are scored each; extra columns are not read;
without training rows base_score is 0 and score that of equally likely classes. A row without a doc_id isn't held out.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplicia.llm.common import chunked, crc_mod5, least_count, raw_texts, sliced, stored, table, words_of

#: Production parameters: words in the broadcast, classes, bins of a class, rows of each weight matrix, tokens of an
#: update, step, epochs.
FREQUENT, CLASSES, BINS, ROWS, UPDATE, RATE, EPOCHS = 1 << 17, 32, 16, 1 << 15, 16384, 0.25, 1
#: CLASSES and ROWS are for up to so many distinct words; beyond it rows grow with their root and classes with the
#: root of the root of the root, so that a task's changes to them stay below the text that it reads.
DISTINCT = 1 << 22
#: Gradients of a row that are added together with those of all others.
TOGETHER = 24
#: The end token, which no word equals.
END = b"\n"
#: Distinct words a task gathers before it sends them on.
FLUSH = 400_000
_N_FEATURES = 4


def tokens_of(raws: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct tokens of texts (the last is the end), the number of each token among them in order, and how many
    each text has. bytes.lower changes A-Z only."""
    distinct, codes, n = words_of([x.lower() for x in raws])
    lengths = n + 1
    flat = np.full(int(lengths.sum()), len(distinct), np.int64)
    words = np.ones(len(flat), bool)
    words[np.cumsum(lengths) - 1] = False
    flat[words] = codes
    return [*distinct.to_numpy(zero_copy_only=False).tolist(), END], flat, lengths  # to_pylist makes a scalar of each first


def word_counts(docs: DataFrame) -> DataFrame:
    """word binary, c: how often each token stands in the texts."""

    def run(batches):
        import pyarrow as pa

        found: dict[bytes, int] = {}
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "c"])
        for batch in sliced(batches):
            raws = raw_texts(batch.column(0))
            for i, j in chunked(raws):
                distinct, flat, _ = tokens_of(raws[i:j])
                for w, c in zip(distinct, np.bincount(flat, minlength=len(distinct)).tolist(), strict=True):
                    found[w] = found.get(w, 0) + c
                if len(found) > FLUSH:
                    yield rows()
                    found.clear()
        yield rows()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, c long").filter("c > 0").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, bound: int | None = None) -> list[tuple[bytes, int]]:
    """The words from the lowest count on at which no more than `bound` words are left, most frequent first."""
    least = least_count(counts, bound or FREQUENT)
    if least is None:
        return []
    got = counts.filter(F.col("c") >= least).toPandas().sort_values(["c", "word"], ascending=[False, True])
    return [(bytes(w), int(c)) for w, c in zip(got["word"], got["c"], strict=True)]


@dataclass
class Lexicon:
    """number: of the frequent words. By number (one more, last, for all other words): class, bin, log10 of (c + 0.5) and
    log10 P(word | bin). log_prior and bin_prior: natural logs of the shares of classes and of the bins in them."""

    number: dict[bytes, int]
    class_of: np.ndarray
    bin_of: np.ndarray
    log_count: np.ndarray
    log_inside: np.ndarray
    log_prior: np.ndarray
    bin_prior: np.ndarray
    tail_log_total: float
    rows: int
    classes: int


def model_size(distinct: int) -> tuple[int, int]:
    """Rows (a power of two) and classes of the weight matrices for so many distinct words."""
    grown = max(1.0, distinct / DISTINCT)
    return ROWS << round(np.log2(grown) / 2), int(CLASSES * grown**0.125)


def _bins_by_mass(c: np.ndarray, bins: int) -> np.ndarray:
    """Bins of about equal mass for counts in descending order; one each if they are no more than the bins."""
    if len(c) <= bins:
        return np.arange(len(c))
    return np.minimum((np.cumsum(c) - c / 2) / max(c.sum(), 1) * bins, bins - 1).astype(np.int64)


def lexicon(top: list[tuple[bytes, int]], total: int, distinct: int) -> Lexicon:
    c = np.array([x for _, x in top], float)
    rows, n_classes = model_size(distinct)
    classes = _bins_by_mass(c, n_classes - 1)
    bins = np.zeros(len(c), np.int64)
    for k in np.unique(classes):
        bins[classes == k] = _bins_by_mass(c[classes == k], BINS)
    tail, tail_distinct = total - c.sum(), distinct - len(top)
    prior = np.append(np.bincount(classes, c, n_classes)[:-1], tail) + 0.5
    by_bin = np.bincount(classes * BINS + bins, c, n_classes * BINS)
    inside = by_bin.reshape(-1, BINS) + np.where(np.arange(n_classes)[:, None] == n_classes - 1, np.arange(BINS) == 0, 0)
    bin_prior = np.log(np.maximum(inside, 1e-30) / np.maximum(inside.sum(1, keepdims=True), 1e-30))
    return Lexicon(
        {w: i for i, (w, _) in enumerate(top)}, np.append(classes, n_classes - 1), np.append(bins, 0), np.append(np.log10(c + 0.5), 0.0),
        np.append(np.log10(np.maximum(c, 1e-300) / np.maximum(by_bin[classes * BINS + bins], 1e-300)), 0.0),
        np.log(prior / prior.sum()), np.maximum(bin_prior, -30.0), float(np.log10(tail + 0.5 * (tail_distinct + 1))), rows, n_classes,
    )


_MIX, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _rows(keys: np.ndarray, lex: Lexicon) -> np.ndarray:
    return ((keys * _MIX) >> np.uint64(65 - lex.rows.bit_length())).astype(np.uint16 if lex.rows <= 1 << 16 else np.uint32)


def contexts(raws: list[bytes], lex: Lexicon) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens, the tokens' numbers among them, their numbers in the lexicon (frequent words; its size for
    others), the keys of the features of their histories and the lengths of the texts. Rare words take part in
    histories through a checksum."""
    distinct, flat, lengths = tokens_of(raws)
    n_frequent = len(lex.number)
    known = np.fromiter(map(lex.number.get, distinct, repeat(-1)), np.int64, len(distinct))
    seen = known.copy()
    seen[known < 0] = [n_frequent + 1 + (zlib.crc32(distinct[i]) & 0xFFFF) for i in np.flatnonzero(known < 0).tolist()]
    known[known < 0] = n_frequent
    seen = seen[flat]
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    back = []
    for k in (1, 2, 3):
        at = np.arange(len(flat)) - k
        back.append(np.where(at >= starts, seen[np.maximum(at, 0)], -k).astype(np.uint64))
    pair = (back[0] * _PAIR) ^ (back[1] + np.uint64(77))
    keys = np.stack([back[0] + np.uint64(1), pair + np.uint64(3), back[1] + np.uint64(1 << 33), back[2] + np.uint64(1 << 41)])
    return distinct, flat, known[flat], keys, lengths


def within_class(keys: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Keys of the second softmax: of a feature together with a class."""
    return (keys ^ (keys >> np.uint64(29))) * _PAIR + (classes.astype(np.uint64) << np.uint64(20)) + np.uint64(1 << 50)


def logits(w: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Sums of the features' rows and the bias, less the greatest of each token."""
    z = np.take(w, rows[0], axis=0, mode="clip")
    more = np.empty_like(z)
    for r in rows[1:]:
        z += np.take(w, r, axis=0, mode="clip", out=more)
    z += bias
    z -= np.ascontiguousarray(z.T).max(axis=0)[:, None]  # numpy is slow at the greatest of short rows
    return z


def log_probability(w: np.ndarray, rows: np.ndarray, bias: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of the softmax at the target of each token."""
    z = logits(w, rows, bias)
    at = z[np.arange(len(z)), target]
    return at - np.log(row_sums(np.exp(z, out=z)))


def row_sums(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(z.shape[1], z.dtype)


def sums_by_row(g: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows, the sum of g's lines for each, and how many lines those are. Most rows have a line or two, for
    which np.add.reduceat is slow: the first TOGETHER lines of all rows are added rank by rank, and only the rest of a
    frequent row by itself."""
    order = np.argsort(rows, kind="stable")
    found = rows[order]
    first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    sizes = np.diff(np.append(first, len(rows)))
    by_size = np.argsort(np.maximum(TOGETHER + 1 - sizes, 0).astype(np.uint8), kind="stable")
    first, sizes = first[by_size], sizes[by_size]
    longer = np.cumsum(np.bincount(np.minimum(sizes, TOGETHER + 1), minlength=TOGETHER + 2)[::-1])[::-1]  # by size: rows of that many lines or more
    total = np.take(g, order[first], axis=0)
    for k in range(1, TOGETHER):
        n = longer[k + 1]
        if not n:
            break
        total[:n] += np.take(g, order[first[:n] + k], axis=0)
    for i in range(longer[TOGETHER + 1]):
        rest = np.take(g, order[first[i] + TOGETHER : first[i] + sizes[i]], axis=0)
        total[i] += np.ones(len(rest), g.dtype) @ rest
    return found[first], total, sizes


class Trainer:
    """A task's copy of one weight matrix, moved by steps that shrink with the squares of a row's gradients."""

    def __init__(self, w: np.ndarray):
        self.start, self.w = w, w.copy()
        self.squares, self.used = np.full(len(w), 1e-2, np.float32), np.zeros(len(w), np.int64)

    def update(self, rows: np.ndarray, target: np.ndarray, bias: np.ndarray) -> None:
        if not len(target):
            return
        g = logits(self.w, rows, bias)
        np.exp(g, out=g)
        g *= (-1 / row_sums(g))[:, None]
        g[np.arange(len(target)), target] += 1
        whole = self.w.view(f"V{self.w[0].nbytes}").ravel()  # a row as one value, which is written faster
        for r in rows:
            at, total, n = sums_by_row(g, r)
            self.squares[at] += np.einsum("ij,ij->i", total, total) / total.shape[1]
            total *= (RATE / np.sqrt(self.squares[at]))[:, None]
            total += np.take(self.w, at, axis=0)
            whole[at] = total.view(whole.dtype).ravel()
            self.used[at] += n

    def changes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows used, how often, and their changes times that."""
        at = np.flatnonzero(self.used)
        return at, self.used[at], (self.w[at] - self.start[at]) * self.used[at, None].astype(np.float32)


Model = tuple[np.ndarray, np.ndarray]


def train(docs: DataFrame, lex: Lexicon, epochs: int = EPOCHS) -> Model:
    """The two weight matrices after `epochs` passes over all training texts."""
    sc = docs.sparkSession.sparkContext
    model = (np.zeros((lex.rows, lex.classes), np.float32), np.zeros((lex.rows, BINS), np.float32))
    shared = sc.broadcast(lex)
    names = [f"d{i}" for i in range(max(lex.classes, BINS))]
    for _ in range(epochs):
        start = sc.broadcast(model)

        def run(batches, start=start):
            import pyarrow as pa

            lex = shared.value
            by_class, by_bin = map(Trainer, start.value)
            prior, bin_prior = lex.log_prior.astype(np.float32), lex.bin_prior.astype(np.float32)
            several = (lex.bin_prior > -30).sum(1) > 1
            for batch in sliced(batches):
                raws = raw_texts(batch.column(0))
                for i, j in chunked(raws):
                    _, _, ids, keys, _ = contexts(raws[i:j], lex)
                    for k in range(0, len(ids), UPDATE):
                        part, part_keys = ids[k : k + UPDATE], keys[:, k : k + UPDATE]
                        target = lex.class_of[part]
                        by_class.update(_rows(part_keys, lex), target, prior)
                        inner = np.flatnonzero(several[target])
                        by_bin.update(_rows(within_class(part_keys[:, inner], target[inner]), lex), lex.bin_of[part[inner]], bin_prior[target[inner]])
            for which, trainer in enumerate((by_class, by_bin)):
                at, used, change = trainer.changes()
                columns = [pa.array(change[:, i] if i < change.shape[1] else np.zeros(len(at), np.float32), pa.float32()) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([pa.array(at * 2 + which), pa.array(used), *columns], names=["at", "used", *names])

        moved = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "at long, used long, " + ", ".join(f"{n} float" for n in names))
        mean = moved.groupBy("at").agg(*((F.sum(n) / F.sum("used")).cast("float").alias(n) for n in names)).toPandas()  # at most two matrices' rows
        at, change = mean["at"].to_numpy(np.int64), mean[names].to_numpy(np.float32).reshape(-1, len(names))
        model = tuple(w.copy() for w in model)
        for which, w in enumerate(model):
            mine = at % 2 == which
            w[at[mine] // 2] += change[mine, : w.shape[1]]
        start.unpersist()
    return model


SCORED = "doc_id long, row long, n_tokens long, n_frequent long, log_count double, log_model double, rare array<binary>"


def log_history(ids: np.ndarray, keys: np.ndarray, lex: Lexicon, model: Model) -> np.ndarray:
    """log10 P(class | history) + log10 P(bin | class, history) of every token."""
    prior, bin_prior = lex.log_prior.astype(np.float32), lex.bin_prior.astype(np.float32)
    several = (lex.bin_prior > -30).sum(1) > 1
    out = np.empty(len(ids))
    for k in range(0, len(ids), UPDATE):
        part, part_keys = ids[k : k + UPDATE], keys[:, k : k + UPDATE]
        target = lex.class_of[part]
        out[k : k + UPDATE] = log_probability(model[0], _rows(part_keys, lex), prior, target)
        if len(inner := np.flatnonzero(several[target])):
            out[k + inner] += log_probability(model[1], _rows(within_class(part_keys[:, inner], target[inner]), lex), bin_prior[target[inner]], lex.bin_of[part[inner]])
    return out / np.log(10)


def frequent_scores(docs: DataFrame, lex: Lexicon, model: Model) -> DataFrame:
    """What a text scores by its frequent words and by the classes of all its words, and its other words."""
    shared = docs.sparkSession.sparkContext.broadcast((lex, model))

    def run(batches):
        import pyarrow as pa

        lex, model = shared.value
        n_frequent = len(lex.number)
        for batch in sliced(batches):
            raws = raw_texts(batch.column(2))
            for i, j in chunked(raws):
                distinct, flat, ids, keys, lengths = contexts(raws[i:j], lex)
                starts = np.cumsum(lengths) - lengths
                total = lambda v, starts=starts: np.add.reduceat(v, starts)
                at = np.flatnonzero(ids == n_frequent)
                borders = pa.array(np.searchsorted(at, np.append(starts, len(ids))), pa.int32())
                rare = pa.ListArray.from_arrays(borders, pa.array(distinct, pa.binary()).take(pa.array(flat[at])))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(lengths), pa.array(total((ids < n_frequent).astype(np.int64))), pa.array(total(lex.log_count[ids])),
                        pa.array(total(log_history(ids, keys, lex, model) + lex.log_inside[ids])), rare,
                    ],
                    names=["doc_id", "row", "n_tokens", "n_frequent", "log_count", "log_model", "rare"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCORED)


def lm_scores(docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score (unigram) and score (model) of every text, in log10."""
    counts = stored(word_counts(training), "lm-counts")
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).collect()[0]
    lex = lexicon(most_frequent(counts), size["n"], size["v"])
    found = stored(frequent_scores(docs, lex, train(training, lex)), "lm-frequent")
    rare = found.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("tf"))
    known = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("tf") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5)).alias("rare_log"),
        F.sum("tf").alias("n_rare"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("rare_known"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    logs = F.col("log_count") + zero("rare_log")
    floor = float(np.log10(size["n"] + 0.5 * (size["v"] + 1)))
    return found.drop("rare").join(known, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_frequent") + zero("rare_known")).cast("long").alias("n_known"),
        F.lit(int(size["n"])).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("log_model") + zero("rare_log") - zero("n_rare") * lex.tail_log_total).alias("score"),
    )


def op9_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held_out = F.coalesce(crc_mod5(F.col("doc_id")) == 1, F.lit(False))
    return lm_scores(docs, docs.filter(~held_out)).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
