"""Counts of a whole text, shared by the quality rules and the quality classifier.

Words are runs of bytes other than ASCII white space, which in UTF-8 are the runs of characters other than
space, \\t, \\n, \\v, \\f and \\r. A null text counts as an empty one; every count of an empty text is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplicia.llm.common import raw_texts, sliced

#: Fixed value: the characters that n_symbols counts.
SYMBOLS = b"#*$%&|<>"
COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct", "n_upper", "n_lower", "n_digits", "n_punct", "n_high", "n_ends", "n_adjacent", "n_upper_words", "n_long_words",
]


def counts(raw: bytes):
    """The COUNTS of one text, in their order."""
    import numpy as np

    words = raw.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = int(by.sum() - by[128:192].sum())
    blank = int(by[32] + by[9:14].sum())
    symbols = sum(int(by[c]) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    adjacent = int((ids[1:] == ids[:-1]).sum())
    repeat = 0
    if n >= 3:
        v = len(number)
        pairs = ids[:-1] * v + ids[1:]
        if v > 2_000_000:  # keeps the number of a window below 2**63
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, where, found = np.unique(pairs[:-1] * v + ids[2:], return_inverse=True, return_counts=True)
        again = found[where] >= 2
        covered = np.zeros(n, bool)
        covered[:-2] |= again
        covered[1:-1] |= again
        covered[2:] |= again
        repeat = int(covered.sum())
    upper, lower, digits = int(by[65:91].sum()), int(by[97:123].sum()), int(by[48:58].sum())
    punct = int(by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum()) - symbols
    return (
        n, points - blank, symbols, len(lines) - len(set(lines)), repeat,
        len(lines), len(number), upper, lower, digits, punct, int(by[192:].sum()), int(by[33] + by[46] + by[63]), adjacent,
        sum(w.isupper() and len(w) > 1 for w in words), sum(len(w) > 20 for w in words),
    )


def with_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns to keep (as strings) and the COUNTS of text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(k).cast("string").alias(k) for k in keep))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in sliced(batches):
            found = np.array([counts(x) for x in raw_texts(batch.column(1))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *(pa.array(found[:, i]) for i in range(len(COUNTS)))], names=["doc_id", *keep, *COUNTS])

    return docs.mapInArrow(run, "doc_id long, " + "".join(f"{k} string, " for k in keep) + ", ".join(f"{c} long" for c in COUNTS))
