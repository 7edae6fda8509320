"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

Lines of MIN_CHARS characters or more (trimmed of blanks) are compared across and within documents. Of equal
lines the first stays, by (doc_id, line number); of two different lines within MAX_EDITS = 1 edit the later one
goes too, with all its copies. Other lines stay as they are.

Equal lines become one class first (two 64-bit hashes, a partial aggregation). With one edit allowed a line is
cut into two segments, threshold plus one, of which one must be equal; the other one holds the edit and is cut in
two again, so that the index knows three quarters of a line: everything but the quarter with the edit. A line
enters the index under its own length with each quarter left out, and probes the index of lines one character
shorter, where the part before the quarter is aligned left and the part behind it right. That finds every pair
within one edit. Cells of the index with more than SMALL lines don't form pairs: their lines meet again on the
left-out quarter with each single character deleted, which only lines within one edit share. All candidates are
verified by a banded bit-parallel edit distance (`within_edits`), for any threshold.

Null and empty texts have no lines; texts of any length are read whole. Repeated rows keep their lines alike; rows of one
doc_id with different texts are documents of their own, one after the other by a hash of the text. Extra columns pass through `without_duplicates`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simplicia.llm.common import join_counted, stored, table

#: Production parameters.
MIN_CHARS, SMALL = 20, 64
MAX_EDITS = 1
#: Parts of a line in the index: segments (threshold plus one), each cut in two.
PARTS = 2 * (MAX_EDITS + 1)
BLANK = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def _border(length: Column, k: int) -> Column:
    """Characters before part k of a line of this length."""
    return F.floor(length * k / PARTS).cast("int")


def _cells(line: Column) -> Column:
    """The index cells of a line: (key, role, part); role 0 under its own length, 1 in the next shorter one's."""
    n = F.char_length(line)
    found = []
    for role in (0, 1):
        length = n - role
        for k in range(PARTS):
            before, behind = _border(length, k), length - _border(length, k + 1)
            key = F.xxhash64(length, F.lit(k), F.substr(line, F.lit(1), before), F.right(line, behind))
            found.append(F.struct(key.alias("key"), F.lit(role).alias("role"), F.lit(k).alias("part")))
    return F.array(*found)


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line, k1, k2 of every line that is compared."""
    at = docs.select("doc_id", F.posexplode_outer(_lines(F.col("text").cast("string"))).alias("pos", "line"))
    lines = at.select("doc_id", "pos", _trimmed(F.col("line")).alias("line")).filter(F.char_length("line") >= MIN_CHARS)
    return lines.select("*", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), F.col("line")).alias("k2"))


def line_classes(docs: DataFrame) -> DataFrame:
    """One row for each distinct line: where it stands first, how often it stands, and its index cells."""
    lines = line_table(docs).select("k1", "k2", F.struct("doc_id", "pos", _cells(F.col("line")).alias("cells")).alias("at"))
    return lines.groupBy("k1", "k2").agg(F.min_by("at", F.struct("at.doc_id", "at.pos")).alias("at"), F.count("*").alias("copies")).select("at.doc_id", "at.pos", "copies", "at.cells")


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    """(doc_id, pos) of the earlier line and (later_doc, later_pos) of the later one, once each."""
    first, second = F.struct(F.col("ad").alias("doc_id"), F.col("ap").alias("pos")), F.struct(F.col("bd").alias("doc_id"), F.col("bp").alias("pos"))
    both = pairs.select(F.least(first, second).alias("x"), F.greatest(first, second).alias("y")).filter("x <> y").distinct()
    return both.select("x.doc_id", "x.pos", F.col("y.doc_id").alias("later_doc"), F.col("y.pos").alias("later_pos"))


def _pairs_in(cells: DataFrame) -> DataFrame:
    """Lines that share a key, at least one of them under its own length."""
    a = cells.filter("role = 0").select("key", F.col("doc_id").alias("ad"), F.col("pos").alias("ap"))
    b = cells.select("key", F.col("doc_id").alias("bd"), F.col("pos").alias("bp"), "role")
    once = (F.col("role") == 1) | (F.struct("ad", "ap") < F.struct("bd", "bp"))
    return a.join(b, "key").filter(once).select("ad", "ap", "bd", "bp")


def _with_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, pos and line of the wanted places."""
    wanted = stored(wanted.distinct(), "line-places")
    ids = stored(wanted.select("doc_id").distinct(), "line-docs")
    texts = join_counted(docs.select("doc_id", "text"), ids, ["doc_id"], ids.count(), how="inner")
    return line_table(texts.dropDuplicates(["doc_id"])).select("doc_id", "pos", "line").join(wanted, ["doc_id", "pos"])


def _met_again(docs: DataFrame, crowded: DataFrame) -> DataFrame:
    """Pairs of crowded cells: rows meet on the left-out part with one character deleted."""
    lines = _with_lines(docs, crowded.select("doc_id", "pos")).join(crowded, ["doc_id", "pos"])
    length = F.char_length("line") - F.col("role")
    part = lambda shift: F.floor(length * (F.col("part") + shift) / PARTS).cast("int")
    middle = F.substr("line", part(0) + 1, part(1) - part(0) + F.col("role"))
    rows = lines.select("key", "role", "doc_id", "pos", middle.alias("middle"))
    n = F.char_length("middle")
    without = lambda i: F.concat(F.substr("middle", F.lit(1), (i - 1).cast("int")), F.substr("middle", (i + 1).cast("int")))
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    same = F.transform(steps, lambda i: F.xxhash64(F.lit("at"), F.col("key"), i, without(i)))
    whole = F.array(F.xxhash64(F.lit("whole"), F.col("key"), F.col("middle")))
    longer = F.array_distinct(F.transform(steps, lambda i: F.xxhash64(F.lit("whole"), F.col("key"), without(i))))
    own = rows.select(F.explode_outer(F.when(F.col("role") == 0, F.concat(same, whole)).otherwise(longer)).alias("key"), "role", "doc_id", "pos")
    return _pairs_in(own)


def characters(text: Column) -> Column:
    """The code points of a string."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def within_edits(a: str, b: str, most: int) -> Column:
    """Whether two columns of characters lie within `most` edits: a banded bit-parallel automaton as one aggregate over
    b. Bit d + most of mask e says that the first j characters of b and the first j + d of a lie within e edits; a
    character moves all diagonals of the band at once. The columns must be stored ones, not expressions, as the
    aggregate looks up a at every step."""
    width = 2 * most + 1
    bits = lambda flags: sum((F.when(f, F.lit(1 << d)).otherwise(F.lit(0)) for d, f in enumerate(flags)), start=F.lit(0))
    full = F.lit((1 << width) - 1)

    def step(state, char):
        j = state["j"]
        same = bits([F.coalesce(F.get(F.col(a), j + (d - most)) == char, F.lit(False)) for d in range(width)])
        masks = [state["m0"].bitwiseAND(same)]
        for e in range(1, most + 1):
            # a match, a changed character, one more in b (the diagonal above), one more in a (the one below, this column)
            before = state[f"m{e - 1}"]
            masks.append(state[f"m{e}"].bitwiseAND(same).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(masks[-1], 1)).bitwiseAND(full))
        return F.struct((j + 1).alias("j"), *(m.alias(f"m{e}") for e, m in enumerate(masks)))

    first = F.struct(F.lit(0).alias("j"), *(F.lit(sum(1 << (d + most) for d in range(e + 1))).alias(f"m{e}") for e in range(most + 1)))
    apart = F.size(a) - F.size(b)
    found = F.aggregate(b, first, step, lambda s: s[f"m{most}"])
    at = F.greatest(F.lit(0), F.least(apart + most, F.lit(width - 1)))
    return (F.abs(apart) <= most) & (F.getbit(found, at) == 1)


def line_links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of different lines within MAX_EDITS, each by its first place: (doc_id, pos, later_doc, later_pos)."""
    cells = classes.select("doc_id", "pos", F.explode_outer("cells").alias("c")).select("doc_id", "pos", "c.key", "c.role", "c.part")
    sizes = stored(cells.groupBy("key").agg(F.count("*").alias("size"), F.min("role").alias("least")).filter("size >= 2 and least = 0").drop("least"), "line-sizes")
    met = stored(join_counted(cells, sizes, ["key"], sizes.count(), how="inner"), "line-cells")
    crowded = met.filter(F.col("size") > SMALL)
    pairs = _pairs_in(met.filter(F.col("size") <= SMALL))
    if not crowded.isEmpty():
        pairs = pairs.union(_met_again(docs, crowded.select("key", "role", "part", "doc_id", "pos")))
    pairs = stored(_distinct_pairs(pairs), "line-pairs")
    lines = _with_lines(docs, pairs.select("doc_id", "pos").union(pairs.select("later_doc", "later_pos")))
    lines = stored(lines.select("doc_id", "pos", characters(F.col("line")).alias("line")), "line-texts")
    later = lines.select(F.col("doc_id").alias("later_doc"), F.col("pos").alias("later_pos"), F.col("line").alias("later"))
    both = pairs.join(lines, ["doc_id", "pos"]).join(later, ["later_doc", "later_pos"])
    return both.filter(within_edits("line", "later", MAX_EDITS)).select("doc_id", "pos", "later_doc", "later_pos")


def row_key(docs: DataFrame) -> Column:
    """What tells texts apart: doc_id, and with it a hash of the text where rows of one doc_id hold different texts."""
    doc, text = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    texts = docs.filter(F.col("doc_id").isNotNull()).groupBy(doc.alias("doc_id")).agg(F.min(text).alias("a"), F.max(text).alias("b"))
    return doc if texts.filter("a <> b").isEmpty() else F.struct(doc.alias("doc_id"), text.alias("row"))


def kept_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id (a key of `row_key`) and text. (doc_id, kept, n_near, n_links) of documents that hold the first copy of a line: the numbers of the lines
    that stay, first copies that go as near duplicates, and links of first copies; and the links themselves."""
    classes = stored(line_classes(docs), "line-classes")
    links = stored(line_links(docs, classes), "line-links")
    gone = links.select(F.col("later_doc").alias("doc_id"), F.col("later_pos").alias("pos")).distinct().withColumn("near", F.lit(True))
    degree = links.select("doc_id", "pos").union(links.select("later_doc", "later_pos")).groupBy("doc_id", "pos").agg(F.count("*").alias("links"))
    marked = classes.select("doc_id", "pos").join(degree, ["doc_id", "pos"], "left").join(gone, ["doc_id", "pos"], "left")
    kept = marked.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("near").isNull(), F.col("pos"))).alias("kept"), F.count("near").alias("n_near"), F.coalesce(F.sum("links"), F.lit(0)).alias("n_links")
    )
    return stored(kept, "line-kept"), links


def without_duplicates(docs: DataFrame) -> DataFrame:
    """docs with the duplicate lines cut out of text, and the counts n_lines, n_compared, n_removed, n_near, n_links.
    Columns of docs with those names are replaced."""
    mine = ["n_lines", "n_compared", "n_removed", "n_near", "n_links"]
    key = row_key(docs)
    kept, _ = kept_lines(docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text")))
    rest = [c for c in docs.columns if c not in mine]
    own = kept.select(F.col("doc_id").alias("_doc"), F.col("kept").alias("_kept"), F.col("n_near").alias("_near"), F.col("n_links").alias("_links"))
    joined = docs.select(*rest).join(own, key == F.col("_doc"), "left")
    lines = F.transform(_lines(F.col("text")), lambda x, i: F.struct(x.alias("line"), i.alias("pos"), (F.char_length(_trimmed(x)) >= MIN_CHARS).alias("compared")))
    split = joined.withColumn("_lines", lines)
    compared = F.transform(F.filter("_lines", lambda x: x["compared"]), lambda x: x["pos"])
    # keys keep documents without an id, whose lines can't be told from one another's, as they are
    drop = F.when(F.col("doc_id").isNull(), F.array().cast("array<int>")).otherwise(F.array_except(compared, F.coalesce("_kept", F.array().cast("array<int>"))))
    split = split.withColumns({"_drop": drop, "_n": F.size(compared)})
    left = F.array_join(F.transform(F.filter("_lines", lambda x: ~F.array_contains("_drop", x["pos"])), lambda x: x["line"]), "\n")
    text = F.when(F.size("_drop") == 0, F.col("text")).otherwise(left)
    counts = {
        "n_lines": F.when(F.coalesce(F.col("text"), F.lit("")) == "", F.lit(0)).otherwise(F.size("_lines")).cast("long"),
        "n_compared": F.col("_n").cast("long"),
        "n_removed": F.size("_drop").cast("long"),
        "n_near": F.coalesce("_near", F.lit(0)).cast("long"),
        "n_links": F.coalesce("_links", F.lit(0)).cast("long"),
    }
    return split.select(*(text.alias("text") if c == "text" else F.col(c) for c in rest), *(v.alias(k) for k, v in counts.items()))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_compared", "n_removed", "n_near", "n_links", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


#: The same rows in DuckDB. Lines within one edit share their first or their last half (up to the shift).
OP7_SQL = """
WITH lines AS (
  SELECT doc_id, i - 1 AS pos, parts[i] AS raw, trim(parts[i], chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS u(i)
), compared AS (SELECT doc_id, pos, line FROM lines WHERE length(line) >= 20
), firsts AS (SELECT line, min({'d': doc_id, 'p': pos}) AS pl, length(line) AS n FROM compared GROUP BY line
), halves AS (
  SELECT *, 'l' || left(line, n // 2 - 1) AS h FROM firsts UNION ALL SELECT *, 'r' || right(line, n // 2 - 1) FROM firsts
), halves2 AS (
  SELECT *, h AS k FROM halves UNION ALL
  SELECT line, pl, n, h, 'l' || left(line, (n - 1) // 2 - 1) FROM halves WHERE h[1] = 'l' AND n % 2 = 0 UNION ALL
  SELECT line, pl, n, h, 'r' || right(line, (n - 1) // 2 - 1) FROM halves WHERE h[1] = 'r' AND n % 2 = 0
), links AS (
  SELECT DISTINCT least(a.pl, b.pl) AS a, greatest(a.pl, b.pl) AS b
  FROM halves2 a JOIN halves2 b ON a.k = b.k AND a.n - b.n IN (0, 1) AND a.line <> b.line WHERE levenshtein(a.line, b.line) <= 1
), gone AS (SELECT DISTINCT b AS pl FROM links
), degree AS (SELECT pl.d AS doc_id, count(*) AS n_links FROM (SELECT a AS pl FROM links UNION ALL SELECT b FROM links) GROUP BY 1
), near AS (SELECT pl.d AS doc_id, count(*) AS n_near FROM gone GROUP BY 1
), marked AS (
  SELECT l.doc_id, l.pos, l.raw, c.line IS NOT NULL AS compared, c.line IS NULL OR (f.pl = {'d': l.doc_id, 'p': l.pos} AND g.pl IS NULL) AS stays
  FROM lines l LEFT JOIN compared c ON c.doc_id = l.doc_id AND c.pos = l.pos LEFT JOIN firsts f ON f.line = c.line LEFT JOIN gone g ON g.pl = f.pl
), texts AS (
  SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE compared) AS n_compared, count(*) FILTER (WHERE NOT stays) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE stays), '') AS text FROM marked GROUP BY doc_id
)
SELECT t.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE t.lines END AS n_lines, t.n_compared, t.n_removed,
       coalesce(n.n_near, 0) AS n_near, coalesce(g.n_links, 0) AS n_links, sha256(t.text) AS text_sha256
FROM texts t JOIN documents d USING (doc_id) LEFT JOIN near n USING (doc_id) LEFT JOIN degree g USING (doc_id)
"""
