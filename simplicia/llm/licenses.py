"""License scan: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser
evaluates the and/or/with expressions that follow a tag.

A text becomes its words (A-Z lower-cased), one space between; a phrase is found where its words stand
consecutively. Each document is scanned alone in one Arrow pass, without a shuffle, in time linear in its text.
Null and empty texts have no words, no notices, null positions, empty labels and score 0.5 (nothing known).
Repeated rows give equal rows; extra columns are not read.

score is what the notices together allow: 1 permissive, 0.6 file-level and 0.4 full copyleft, 0.2 non-commercial,
0 no rights given. Notices of one text all bind it (the least counts); `or` takes the better side, `and` the
worse, `with` lifts a copyleft license half way to permissive.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplicia.llm.common import raw_texts, sliced, table

#: The phrases of the base contract.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases beyond the base.
MORE_PHRASES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "boost",
    "the unlicense": "unlicense",
    "public domain": "public-domain",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
    "cc by 4 0": "cc-by",
    "cc by 3 0": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "creative commons attribution": "cc-by",
    "all rights reserved": "proprietary",
    "proprietary and confidential": "proprietary",
}
#: The words of an identifier tag.
TAG = "spdx license identifier"
#: What a label allows.
ALLOWS = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "boost": 1.0, "unlicense": 1.0, "public-domain": 1.0, "cc0": 1.0,
    "cc-by": 0.9, "mpl": 0.6, "epl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "proprietary": 0.0,
}
UNKNOWN = 0.5
#: License identifiers by their first letters, longest first.
FAMILIES = ["cc-by-nc", "cc-by-nd", "cc-by-sa", "unlicense", "apache", "cc-by", "agpl", "lgpl", "zlib", "cc0", "bsd", "bsl", "epl", "gpl", "isc", "mit", "mpl"]

_WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_TAG_LINE = re.compile(r"spdx-license-identifier[ \t]*:?[ \t]*([^\r\n]*)", re.I)
_PART = re.compile(r"[()]|[A-Za-z0-9.+:_-]+")
_RANK = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    low = identifier.lower()
    found = next((f for f in FAMILIES if low.startswith(f)), "")
    return {"bsl": "boost", "": "other"}.get(found, found)


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: the parts of an expression, operators behind their operands. Reading ends where the text
    stops being an expression, as it does at the end of a comment; unbalanced parentheses are closed or skipped."""
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for part in _PART.findall(expression):
        low = part.lower()
        if low in _RANK:
            if operand_next:
                break
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[low]:
                out.append(held.pop())
            held.append(low)
            operand_next = True
        elif part == "(":
            if not operand_next:
                break
            held.append(part)
        elif part == ")":
            if operand_next or "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        else:
            if not operand_next:
                break
            out.append(part)
            operand_next = False
    if operand_next and held and held[-1] in _RANK:  # an operator without its right side
        held.pop()
    out.extend(op for op in reversed(held) if op != "(")
    return out


def evaluate(postfix: list[str]) -> tuple[set[str], float] | None:
    """Labels and score of an expression in postfix order."""
    stack: list[tuple[set[str], float]] = []
    for part in postfix:
        if part in _RANK:
            if len(stack) < 2:
                return None
            (b_labels, b), (a_labels, a) = stack.pop(), stack.pop()
            if part == "or":
                stack.append((a_labels | b_labels, max(a, b)))
            elif part == "and":
                stack.append((a_labels | b_labels, min(a, b)))
            else:  # the right side names an exception, not a license
                stack.append((a_labels | {"exception"}, (a + 1) / 2))
        else:
            label = family(part)
            stack.append(({label}, ALLOWS.get(label, UNKNOWN)))
    return stack[-1] if stack else None


@functools.cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, label in (MORE_PHRASES | BASE_PHRASES | {TAG: ""}).items():
        found.add_word(f" {phrase} ", (phrase, label, phrase in BASE_PHRASES))
    found.make_automaton()
    return found


def scan(raw: bytes) -> tuple[int, list[tuple[str, int, int, bool]], list[str], list[str], float]:
    """Number of words; notices as (label, first word, words, base); labels; expressions in postfix; score."""
    words = raw.lower().translate(_WORD_BYTES).split()
    line = f" {b' '.join(words).decode('utf-8', 'replace')} "
    found = sorted((end + 1 - len(phrase) - 2, phrase, label, base) for end, (phrase, label, base) in _automaton().iter(line))
    notices, labels, score, expressions, tagged = [], set(), [], [], False
    at = word = 0
    for start, phrase, label, base in found:
        word += line.count(" ", at, start)
        at = start
        if phrase == TAG:
            tagged = True
            continue
        notices.append((label, word, phrase.count(" ") + 1, base))
        labels.add(label)
        score.append(ALLOWS[label])
    if tagged:
        for tail in _TAG_LINE.findall(raw.decode("utf-8", "replace")):
            postfix = to_postfix(tail)
            if (value := evaluate(postfix)) is not None:
                expressions.append(" ".join(postfix))
                labels |= value[0]
                score.append(value[1])
    return len(words), notices, sorted(labels), expressions, min(score, default=UNKNOWN)


SCHEMA = "doc_id long, n_words long, notices array<struct<label:string,first_word:long,n_words:long,base:boolean>>, labels array<string>, expressions array<string>, score double"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document with its notices (spans in words), labels, evaluated expressions and score."""

    def run(batches):
        import pyarrow as pa

        span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("base", pa.bool_())])
        strings = pa.list_(pa.string())
        arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("notices", pa.list_(span)), ("labels", strings), ("expressions", strings), ("score", pa.float64())])
        for batch in sliced(batches):
            n, notices, labels, expressions, score = zip(*map(scan, raw_texts(batch.column(1))), strict=True) if batch.num_rows else [()] * 5
            spans = [[dict(zip(("label", "first_word", "n_words", "base"), x, strict=True)) for x in one] for one in notices]
            columns = (batch.column(0), n, spans, list(labels), list(expressions), score)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("notices", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["first_word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda x: x["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
        F.array_join("expressions", "; ").alias("expressions"),
    )
