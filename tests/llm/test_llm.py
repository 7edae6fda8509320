"""Operators for training data against brute force, exact round trips, SQL and held-out labels, with the cases that
must not break them: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import collections
import glob
import hashlib
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from simplicia.llm import bpe, common, decontaminate, gam, html, jaccard, licenses, lines, maxent, quality, textstats, urls

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
DOCS = "doc_id long, text string, lang string, source string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in rows], DOCS)


def texts(table="documents", column="text", key="doc_id"):
    return dict(duckdb.sql(f"SELECT {key}, {column} FROM '{SF}/{table}.parquet'").fetchall())


ODD = [(1, None), (2, ""), (3, " \n\t\n "), (4, "x"), (4, "x"), (5, "word " * 30_000), (6, "été naïve  你好 \U0001f600 e\u0301"), (7, "a\x00b\x1cc\x85d e")]


# quality rules


def base_counts(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if n[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


@needs_tables
def test_counts_against_brute_force():
    for t in [*texts().values(), *(t for _, t in ODD), "a b c a b c d", "# | a\na\na\n\n"]:
        assert textstats.counts((t or "").encode())[:5] == base_counts(t)


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("abcdeilnorst"), rng.integers(2, 9))) for _ in range(400)]
    prose = [" ".join(rng.choice(vocabulary, 120)).capitalize() + "." for _ in range(130)]
    bad = [" ".join(w + "###" for w in p.split()) for p in prose[:8]] + [p.upper() for p in prose[8:14]]
    df = docs(spark, list(enumerate(prose + bad)) + [(900, None), (901, "")]).withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit(3))
    got = {r.doc_id: r for r in quality.judged(df).collect()}
    assert all(got[i].kept for i in range(130)) and not any(got[i].kept for i in range(130, 144))
    assert got[900].base_failed and not got[900].kept and got[901].n_words == 0


def test_quality_of_few_and_no_rows(spark):
    assert quality.judged(docs(spark, [])).count() == 0
    got = {(r.doc_id, r.kept) for r in quality.judged(docs(spark, ODD + [(9, " ".join(f"w{i}" for i in range(60)))])).collect()}
    assert (9, True) in got and (2, False) in got


def plain_estimate(x):
    """The minimum-covariance-determinant estimate of rows by plain numpy: mean, inverse covariance and limit."""
    import math

    n, p = x.shape
    spread = np.array([e for _, e in quality.FEATURES.values()])
    at = lambda v, q: np.sort(v, axis=0)[max(0, math.ceil(q * len(v)) - 1)]
    low, middle, high = (at(x, q) for q in (0.25, 0.5, 0.75))
    scale = np.sqrt(((high - low) / 1.349) ** 2 + spread**2)
    found = []
    for k, mu in enumerate((middle, low, high)):
        inverse, was = np.diag(1 / scale**2), math.inf
        while True:
            d2 = np.einsum("ij,jk,ik->i", x - mu, inverse, x - mu)
            near = x[d2 <= at(d2, quality.SHARE)]
            mu = near.mean(0)
            c = quality.shrunk(len(near), np.cov(near.T, bias=True))
            inverse, det = np.linalg.inv(c + 1e-9 * np.eye(p)), np.linalg.slogdet(c + 1e-9 * np.eye(p))[1]
            if det >= was - 0.001:
                break
            was = det
        found.append((det, k, mu, inverse))
    _, _, mu, inverse = min(found, key=lambda f: (round(f[0], 6), f[1]))
    d = np.sqrt(np.einsum("ij,jk,ik->i", x - mu, inverse, x - mu))
    return d**2, max(quality.GAUSSIAN, (at(d, 0.5) + quality.REACH * (at(d, 0.75) - at(d, 0.5))) ** 2)


@needs_tables
def test_quality_verdicts_against_plain_numpy(spark):
    sf = SF.replace("0.001", "0.01")
    df = spark.read.parquet(f"{sf}/documents.parquet").filter("lang = 'en'").withColumn("source", F.lit("one"))
    rows = {r.doc_id: np.array([r[c] for c in quality.X]) for r in quality.vectors(df).filter("not base_failed").collect()}
    got = {r.doc_id: r for r in quality.judged(df).collect()}
    ids = sorted(rows)
    d2, limit = plain_estimate(np.stack([rows[i] for i in ids]))
    assert len(ids) > 150
    assert all(got[i].distance2 == pytest.approx(d, rel=0.05, abs=0.05) for i, d in zip(ids, d2, strict=True))
    assert all(got[i].kept == (d <= limit) for i, d in zip(ids, d2, strict=True) if abs(d - limit) > 0.1 * limit)
    assert 0 < sum(not got[i].kept for i in ids) < 0.2 * len(ids)


def test_quality_finds_the_right_mode_and_takes_null_groups(spark):
    """A third of a group lies far off to one side; the estimate is that of the others. Null language and source."""
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdeilnorst"), rng.integers(2, 9))) for _ in range(400)]
    good = [" ".join(rng.choice(words, 120)) for _ in range(140)]
    bad = [" ".join(w.upper() + "#&" for w in rng.choice(words, 120)) for _ in range(40)]
    rows = [(i, t, None, None) for i, t in enumerate(good + bad)]
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i] for i in range(140)) and not any(got[i] for i in range(140, 180))


# licenses


def brute_license(t):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    found = sorted((i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), found


@needs_tables
def test_licenses(spark):
    extra = ["MIT License mit-license. THE APACHE license GNU General Public License", "mit mit license license", "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause\n", "GPL"]
    rows = list(texts().items()) + [(10_000 + i, t) for i, t in enumerate(extra)] + [(i + 20_000, t) for i, t in ODD]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    for i, t in rows:
        n, found = brute_license(t)
        base = [(x.first_word, x.label) for x in got[i].notices if x.base]
        assert got[i].n_words == n and sorted(base) == found and 0 <= got[i].score <= 1
    assert got[10_002].labels == ["bsd", "gpl", "mit"] and got[10_002].score == 1.0


@pytest.mark.parametrize(
    ("text", "postfix", "score"),
    [("MIT OR Apache-2.0", "MIT Apache-2.0 or", 1.0), ("GPL-2.0 AND MIT OR ISC", "GPL-2.0 MIT and ISC or", 1.0), ("GPL-2.0 WITH Classpath-exception-2.0 AND MIT", "GPL-2.0 Classpath-exception-2.0 with MIT and", 0.7), ("((MIT) OR", "MIT", 1.0), (") OR", "", None), ("MIT */ see", "MIT", 1.0)],
)
def test_expressions(text, postfix, score):
    got = licenses.to_postfix(text)
    assert " ".join(got) == postfix
    assert (licenses.evaluate(got) or (None, None))[1] == (pytest.approx(score) if score is not None else None)


# byte-pair encoding


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


@needs_tables
def test_bpe_equals_the_library(spark, tokenizer):
    rng = np.random.default_rng(3)
    noise = ["".join(map(chr, rng.choice([9, 10, 32, 39, 65, 97, 115, 116, 233, 0x3042, 0x1F600, 0x0301], 200))) for _ in range(60)]
    rows = list(texts().items()) + [(50_000 + i, t) for i, t in enumerate([*noise, "<|endoftext|>a<|endoftext|>", "it's'll", "a" * 5000])] + [(60_000 + i, t) for i, t in ODD]
    got = collections.defaultdict(list)
    for r in bpe.digests(docs(spark, rows), bpe.default_vocabulary()).collect():
        got[r.doc_id].append(r)
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want for r in got[i])
    out = bpe.encode_decode(docs(spark, ODD).withColumn("ids", F.lit(1)), bpe.default_vocabulary())
    assert all(r.decoded == (r.text or "") for r in out.collect())


def test_every_vocabulary_entry_encodes_like_the_library(tokenizer):
    coder = bpe._coder(bpe.default_vocabulary())
    ends = coder.spelled_at.tolist()
    entries = [coder.spelled[a:b].tobytes().decode("utf-8", "ignore") for a, b in zip(ends, ends[1:], strict=False)]
    ids, borders = coder.encode_texts([e.encode() for e in entries])
    got = [ids[a:b].tolist() for a, b in zip(borders, borders[1:], strict=False)]
    assert len(entries) > 50_000 and got == [x.ids for x in tokenizer.encode_batch(entries, add_special_tokens=False)]


def test_bpe_pieces_of_any_characters(tokenizer):
    """Blanks of all kinds, apostrophes and contractions at every border, against the library."""
    rng = np.random.default_rng(5)
    points = [9, 10, 13, 32, 32, 32, 39, 39, 39, 0xA0, 0x85, 0x2028, 48, 0x660, 46, 0x1F600, 233, 0x3042, *map(ord, "strevmld")]
    made = ["".join(map(chr, rng.choice(points, rng.integers(0, 40)))) for _ in range(4000)]
    made = [t if i % 50 else t + "<|endoftext|>" + t for i, t in enumerate(made)]
    coder = bpe._coder(bpe.default_vocabulary())
    ids, borders = coder.encode_texts([t.encode() for t in made])
    assert [ids[a:b].tolist() for a, b in zip(borders, borders[1:], strict=False)] == [x.ids for x in tokenizer.encode_batch(made, add_special_tokens=False)]
    assert coder.decode_texts(ids, borders) == [t.encode() for t in made]


def test_bpe_keeps_columns_and_checks_the_round_trip(spark):
    df = docs(spark, [(1, "a b"), (2, None), (None, "")]).withColumn("n_tokens", F.lit(7))
    got = {r.doc_id: r for r in bpe.encoded(df.drop("n_tokens"), bpe.default_vocabulary(), ["doc_id", "lang"]).collect()}
    assert got[1].n_tokens == len(got[1].ids) == 2 and got[2].ids == [] and all(r.round_trip and r.lang == "en" for r in got.values())
    assert bpe.digests(docs(spark, []), bpe.default_vocabulary()).count() == 0


# classifier


@needs_tables
def test_gam_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.01")
    got = gam.op4_gam(spark, sf).toPandas().merge(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").df(), on="doc_id")
    out = got[got.held_out]
    good, bad = out[out.quality == 1].score, out[out.quality == 0].score
    assert (good.to_numpy()[:, None] > bad.to_numpy()[None, :]).mean() > 0.95 and (out.predicted == out.quality).mean() > 0.9


def test_gam_without_labels_and_odd_texts(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = gam.classify(docs(spark, ODD), labels).collect()
    assert len(got) == len(ODD) and all(r.score == 0.5 for r in got)
    some = spark.createDataFrame([(4, 1), (5, 0), (6, None), (None, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in gam.classify(docs(spark, ODD), some).collect())


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = np.zeros((4000, len(gam.FEATURE_NAMES)))
    x[:, :2] = rng.random((4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((gam.fit(x, y).score(x) > 0.5) == y).mean() > 0.9


# decontamination


QUESTION = "A train leaves the station with Tom and travels 60 km in 2 hours. How far does Tom travel in 5 hours if the speed stays the same?"


def test_templates_and_slots(spark):
    other = QUESTION.replace("Tom", "Anna").replace("60 km", "80 miles").replace("2 hours", "3 days").replace("5 hours", "7 days")
    broken = other.replace("does Anna", "does Bob")
    half = QUESTION[: len(QUESTION) // 3]
    rows = [(1, "Intro words. " + QUESTION + " More."), (2, other), (3, broken), (4, half), (5, "Nothing of that kind stands here at all, not even close to it."), *((10 + i, t) for i, t in ODD)]
    bench = spark.createDataFrame([(1, QUESTION), (2, None), (3, "too short")], "item_id long, text string")
    df = docs(spark, rows).withColumn("item_id", F.lit("clash")).withColumn("hashes_8", F.lit(1))
    got = {r.doc_id: (r.item_id, r.kind) for r in decontaminate.leaks(df, bench).collect()}
    assert got == {1: (1, "exact"), 2: (1, "reparameterised")}
    assert decontaminate.leaks(docs(spark, rows), bench.limit(0)).count() == 0


def test_templates_of_names_runs_drift_and_short_items(spark):
    first = "Tom Miller has 3 apples and buys 4 more at the market before lunch. Tom eats 2 of them on the way home with his sister."
    other = first.replace("Tom Miller", "Anna").replace("Tom", "Bea").replace("3 apples", "5 apples")
    drifted = QUESTION.replace("60 km", "about 70 km")  # a word put in before a slot that changed
    long = " ".join(f"{a}{b}" for a in "abcdefgh" for b in ("lo", "mi", "nu", "pe", "qi"))
    half = "before it " + " ".join(long.split()[5:25]) + " behind it"
    short = "name the capital city of this country"
    rows = [(1, first), (2, other), (3, drifted), (4, half), (5, "they ask, name the capital city of this country!"), (6, QUESTION), (6, QUESTION.replace("60 km", "70 km")), (7, QUESTION.replace("60 km", "70 km")), (7, QUESTION), (8, "clean words only")]
    bench = spark.createDataFrame([(1, first), (2, QUESTION), (3, long), (4, short)], "item_id long, text string")
    found = decontaminate.leaks(docs(spark, rows), bench)
    got = sorted((r.doc_id, r.item_id, r.kind) for r in found.collect())
    assert got == [(1, 1, "exact"), (2, 1, "reparameterised"), (3, 2, "reparameterised"), (4, 3, "exact"), (5, 4, "exact"), (6, 2, "exact"), (7, 2, "exact")]


# Jaccard join


def components(rows):
    sets = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("rounds", "small"), [(2, 1024), (1, 1024), (1, 2)])
def test_jaccard_against_brute_force(spark, monkeypatch, rounds, small):
    """Few rounds leave components to the pairs; a small region size sends regions through the recursion and the blocks."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(500)]
    passage = " ".join(rng.choice(words, 12))
    rows = []
    for g in range(6):
        base = list(rng.choice(words, 80))
        for k in range(9):
            t = list(base)
            for _ in range(k % 5):
                t[rng.integers(len(t))] = rng.choice(words)
            rows.append((len(rows) + 1, " ".join(t)))
    for at in range(0, 160, 4):  # a chain: each links only with its neighbours
        rows.append((len(rows) + 1, " ".join(f"c{i}" for i in range(at, at + 60))))
    long = " ".join(rng.choice(words, 60))
    rows += [(len(rows) + 1 + i, long + " " + " ".join(rng.choice(words, 9 + i % 9))) for i in range(40)]  # around the threshold
    rows += [(len(rows) + 100 + i, passage + " " + " ".join(rng.choice(words, 40))) for i in range(10)]
    rows += [(900, None), (901, ""), (902, "one two"), (903, "One TWO"), (904, "one two three four five"), (905, rows[0][1]), (None, rows[0][1])]
    df = docs(spark, rows).withColumn("cls", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect() if r.doc_id is not None}
    assert got == components([r for r in rows if r[0] is not None])


def test_jaccard_links_texts_that_different_pivots_reach(spark):
    """Two large groups whose members link across the groups only by one text of each."""
    rng = np.random.default_rng(0)
    some = lambda name, n: [f"{name}{rng.integers(1 << 40)}" for _ in range(n)]
    i, x, y, a, b = some("i", 600), some("x", 80), some("y", 80), some("a", 100), some("b", 100)
    texts_ = [i + x + a + [f"u{k}"] for k in range(300)] + [i + y + b + [f"v{k}"] for k in range(300)] + [i + x, i + y]
    got = jaccard.near_duplicates(docs(spark, [(k, " ".join(t)) for k, t in enumerate(texts_)])).collect()
    assert len(got) == 602 and {r.component_id for r in got} == {0}


def test_jaccard_on_nothing_and_repeated_rows(spark):
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0
    got = jaccard.near_duplicates(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r.component_id == r.doc_id for r in got)


# line dedup


def brute_lines(rows):
    """What stays of each text: of equal lines the first; a line goes if an earlier different one is one edit away."""

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) > len(b):
            a, b = b, a
        i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        return a[i + (len(a) == len(b)) :] == b[i + 1 :]

    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        for p, x in enumerate((t or "").split("\n")):
            x = x.strip(lines.BLANK)
            if len(x) >= lines.MIN_CHARS:
                first.setdefault(x, (i, p))
    gone = {b for a in first for b in first if first[a] < first[b] and near(a, b)}
    keep = {at for x, at in first.items() if x not in gone}
    return {i: "\n".join(x for p, x in enumerate((t or "").split("\n")) if len(x.strip(lines.BLANK)) < lines.MIN_CHARS or (i, p) in keep) for i, t in rows}


@pytest.mark.parametrize("small", [64, 2])
def test_line_dedup_against_brute_force(spark, monkeypatch, small):
    """A small cell size sends the lines through the second meeting."""
    monkeypatch.setattr(lines, "SMALL", small)
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("abcdé \U0001f600"), 30)).strip() + "zzzzz" for _ in range(12)]

    def edited(x):
        k = int(rng.integers(len(x)))
        return rng.choice([x[:k] + x[k + 1 :], x[:k] + "Q" + x[k:], x[:k] + "Q" + x[k + 1 :], x])

    rows = [(i + 1, "\n".join(["short", *(edited(base[rng.integers(12)]) for _ in range(4)), "  " + base[0] + "\t"])) for i in range(25)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "x" * 100_000), (104, "x" * 99_999 + "y")]
    df = docs(spark, rows).withColumn("n_near", F.lit("clash"))
    got = {r.doc_id: r.text or "" for r in lines.without_duplicates(df).collect()}
    assert got == brute_lines(rows)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_bit_parallel_edit_distance(spark, most):
    """Random pairs near and far, with astral characters and empty strings, against a plain dynamic program."""
    rng = np.random.default_rng(most)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, left = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
        return row[-1]

    pairs = [("", ""), ("a", ""), ("", "ab"), ("abc", "abc")]
    for _ in range(400):
        a = list(rng.choice(list("abé\U0001f600 "), rng.integers(0, 30)))
        b = list(a)
        for _ in range(rng.integers(0, 5)):
            k = int(rng.integers(len(b) + 1))
            b[k : k + int(rng.integers(2))] = list(rng.choice(list("abx"), rng.integers(2)))
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    df = common.stored(df.select("a", "b", lines.characters(F.col("a")).alias("x"), lines.characters(F.col("b")).alias("y")), "pairs")
    got = df.select("a", "b", lines.within_edits("x", "y", most).alias("near")).collect()
    assert all(r.near == (distance(r.a, r.b) <= most) for r in got) and {r.near for r in got} == {True, False}


def test_line_dedup_of_nothing(spark):
    assert lines.without_duplicates(docs(spark, [])).count() == 0


# urls


def brute_url(u):
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.BASE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, default=None)
    return host, path, rule and rule[1], rule and rule[2]


@needs_tables
def test_urls(spark):
    extra = [None, "", "nope", "://", "http://Example.ORG/en/1x?q=a#b", "http://a.example.org", "x://org/es/", "http://notexample.org/es/", "a://b://c/d", "http://É.com/de/", "http://bad.test/spam/1", "http://bad.test/spam/2", "http://good.test/spam/2"]
    rows = list(texts("pages", "url", "page_id").items()) + [(10_000 + i, u) for i, u in enumerate(extra)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labelled = spark.createDataFrame([(f"http://{'bad' if i % 2 else 'good'}.test/spam/{i}", i % 2 == 1) for i in range(60)], "url string, bad boolean")
    mined = urls.mine_rules(labelled)
    assert ["h:bad"] in [r.antecedent for r in mined.collect()]
    got = {r.page_id: r for r in urls.judge(pages, mined).collect()}
    for i, u in rows:
        host, path, rule, verdict = brute_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or ("block" if host == "bad.test" else "allow"))
    none = urls.mine_rules(labelled.limit(0))
    assert urls.judge(pages, none).filter("mined_rule is not null").count() == 0


def test_mined_rules_against_brute_force(spark):
    """All rules over sets of tokens by plain counting; tokens of equal urls count as one."""
    import itertools

    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        words = [w for w, p in zip("abcde", (0.5, 0.3, 0.6, 0.2, 0.4), strict=True) if rng.random() < p]
        rows.append((f"http://{'x' if i % 3 else 'y'}.test/{'-'.join(words)}/page", bool(rng.random() < (0.7 if "a" in words and "d" in words else 0.2))))
    rows += [(None, True), ("no url", None)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean").withColumn("items", F.lit("clash"))
    sets = [({"h:test", "p:page", f"h:{u.split('/')[2].split('.')[0]}", *(f"p:{w}" for w in u.split("/")[3].split("-") if w)} if u and "://" in u else set(), bool(b)) for u, b in rows]
    tokens = sorted(set().union(*(s for s, _ in sets)))
    alike = {}
    for t in tokens:
        alike.setdefault(tuple(i for i, (s, _) in enumerate(sets) if t in s), []).append(t)
    n = sum(1 for s, b in sets if s or b)
    share = sum(b for _, b in sets) / n
    want = set()
    for k in range(1, len(alike) + 1):
        for group in itertools.combinations(alike.values(), k):
            inside = set().union(*group)
            all_, bad = sum(inside <= s for s, _ in sets), sum(inside <= s and b for s, b in sets)
            if all_ and bad / n >= max(0.001, 5 / len(rows)) and bad / all_ >= 0.3 and bad / all_ / share >= 1.5:
                want.add((tuple(sorted(inside)), round(bad / all_, 9)))
    got = {(tuple(r.antecedent), round(r.confidence, 9)) for r in urls.mine_rules(labelled).collect()}
    assert got == want and len(want) > 3


def test_urls_of_one_template_and_clashing_columns(spark):
    path = "/".join(f"part{chr(97 + i)}" for i in range(26))
    labelled = spark.createDataFrame([(f"http://t.test/{path}/{'bad' if i % 2 else 'good'}", i % 2 == 1) for i in range(40)], "url string, bad boolean")
    rules = urls.mine_rules(labelled)
    assert ["p:bad"] in [r.antecedent for r in rules.collect()]
    pages = spark.createDataFrame([(1, f"http://t.test/{path}/bad", "x", 1.0), (1, f"http://t.test/{path}/bad", "x", 1.0), (2, None, "y", 2.0)], "page_id long, url string, verdict string, confidence double")
    assert sorted((r.page_id, r.verdict) for r in urls.judge(pages, rules).collect()) == [(1, "block"), (1, "block"), (2, "allow")]
    assert urls.judge(pages.limit(0), rules).count() == 0


# language model


def lm_tokens(t):
    return [*t.encode().lower().split(), maxent.END]


@needs_tables
def test_language_model(spark):
    sf = SF.replace("0.001", "0.01")
    rows = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    import math
    import zlib

    train = collections.Counter(w for i, t in rows.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in lm_tokens(t))
    n, v = sum(train.values()), len(train)
    got = maxent.op9_maxent(spark, sf).toPandas().set_index("doc_id")
    for i, t in rows.items():
        w = lm_tokens(t)
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(train[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()


def test_language_model_sees_three_words_and_grows():
    lex = maxent.lexicon([(b"a", 4), (b"b", 3), (b"c", 2), (b"d", 1)], 10, 4)
    assert lex.classes >= 32 and lex.rows >= 1 << 15
    keys = [maxent.contexts([t], lex)[3][:, 3] for t in (b"a b c d", b"b b c d")]
    assert [(keys[0] != keys[1])[i] for i in range(4)] == [False, False, False, True]  # only the third last word differs
    more = maxent.model_size(10_000_000)
    assert more[0] > lex.rows and more[1] > lex.classes


def plain_model(texts_, lex):
    """The model by plain loops: trained on texts in one task, then the log10 probability of every class and bin."""
    import math

    n_classes, bins = lex.classes, maxent.BINS
    w = [np.zeros((lex.rows, n_classes)), np.zeros((lex.rows, bins))]
    squares = [np.full(lex.rows, 1e-2), np.full(lex.rows, 1e-2)]
    several = [(lex.bin_prior[k] > -30).sum() > 1 for k in range(n_classes)]

    def softmax(which, rows, bias):
        z = [sum(w[which][r][k] for r in rows) + bias[k] for k in range(len(bias))]
        top = max(z)
        total = sum(math.exp(x - top) for x in z)
        return [math.exp(x - top) / total for x in z]

    def examples(t):
        words = lm_tokens(t)
        _, _, ids, keys, _ = maxent.contexts([t.encode()], lex)
        assert len(words) == len(ids)
        for i, word in enumerate(words):
            number = lex.number.get(word, len(lex.number))
            k = int(lex.class_of[number])
            inner = maxent.within_class(keys[:, [i]], np.array([k]))
            yield number, k, maxent._rows(keys[:, i], lex).tolist(), maxent._rows(inner, lex)[:, 0].tolist()

    every = [x for t in texts_ for x in examples(t)]
    for at in range(0, len(every), maxent.UPDATE):
        part = every[at : at + maxent.UPDATE]
        for which in (0, 1):
            chosen = [x for x in part if which == 0 or several[x[1]]]
            grads = []
            for number, k, outer, inner in chosen:
                p = softmax(which, (outer, inner)[which], lex.log_prior if which == 0 else lex.bin_prior[k])
                target = k if which == 0 else int(lex.bin_of[number])
                grads.append(((outer, inner)[which], np.array([(j == target) - x for j, x in enumerate(p)])))
            for f in range(4):
                total = collections.defaultdict(lambda n=w[which].shape[1]: np.zeros(n))
                for rows, g in grads:
                    total[rows[f]] += g
                for r, g in total.items():
                    squares[which][r] += (g * g).mean()
                    w[which][r] += maxent.RATE * g / math.sqrt(squares[which][r])

    def score(t):
        total = 0.0
        for number, k, outer, inner in examples(t):
            total += math.log10(softmax(0, outer, lex.log_prior)[k])
            if several[k]:
                total += math.log10(softmax(1, inner, lex.bin_prior[k])[int(lex.bin_of[number])])
            total += lex.log_inside[number]
        return total

    return score


def test_language_model_against_plain_loops(spark, monkeypatch):
    """Training in one task and the score of every text, rare words included; probabilities of a history sum to 1."""
    import math

    for name, value in (("CLASSES", 5), ("BINS", 3), ("ROWS", 64), ("FREQUENT", 12), ("UPDATE", 50)):
        monkeypatch.setattr(maxent, name, value)
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(20)]
    made = [" ".join(words[min(int(x), 19)] for x in rng.geometric(0.2, 30)) for _ in range(12)]
    counts = collections.Counter(w for t in made for w in lm_tokens(t))
    training = docs(spark, list(enumerate(made))).coalesce(1)
    top = maxent.most_frequent(maxent.word_counts(training))
    assert 3 < len(top) <= 12 and all(counts[w] == c for w, c in top)
    n, distinct = sum(counts.values()), len(counts)
    lex = maxent.lexicon(top, n, distinct)
    score = plain_model(made, lex)
    tail, tail_distinct = n - sum(c for _, c in top), distinct - len(top)
    for r in maxent.lm_scores(docs(spark, [*enumerate(made), (50, "w1 unseen w19"), (51, None)]), training).collect():
        t = dict(enumerate(made)).get(r.doc_id, "w1 unseen w19" if r.doc_id == 50 else "")
        rare = sum(math.log10((counts[w] + 0.5) / (tail + 0.5 * (tail_distinct + 1))) for w in lm_tokens(t) if w not in lex.number)
        assert r.score == pytest.approx(score(t) + rare, rel=1e-4)
    inside = sum(10 ** lex.log_inside[i] * math.exp(lex.bin_prior[lex.class_of[i], lex.bin_of[i]] + lex.log_prior[lex.class_of[i]]) for i in range(len(top)))
    assert inside + math.exp(lex.log_prior[-1]) == pytest.approx(1, abs=1e-6)


def test_language_model_with_rare_words_and_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(maxent, "FREQUENT", 2)
    rows = docs(spark, [*ODD, (20, "a a a b b c unseen"), (21, "a b")]).withColumn("row", F.lit("clash")).withColumn("word", F.lit(1))
    got = maxent.lm_scores(rows, docs(spark, [(1, "a a a b b c"), (2, "A B a")])).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ODD) + 2 and by[20].n_known == 7 and by[21].n_known == 3 and by[1].n_tokens == 1
    empty = maxent.lm_scores(rows, docs(spark, [])).collect()
    assert all(r.n_known == 0 and np.isfinite(r.score) and np.isfinite(r.base_score) for r in empty)


# html


PAGE = """<html><head><title>t</title><script>x='</p>'</script></head><body><header>H</header><nav><a href=/>menu</a></nav>
<div class="page-12"><article><h1>T &amp; u</h1><p><b>One
 two<br>three<p>Last &lt;x&gt; <a href="y>z">link</a></article><div class="comments"><p>first!</p></div><form>f</form></div>
<aside>S</aside><div class="cookie-banner">N</div><footer>F &copy;</footer>"""


def test_html_keeps_heading_and_lead_and_mixed_templates(spark):
    body = "word " * 200
    page = f"<html><body><article><h1>Heading</h1><p>The lead.</p><div class=body><p>{body}</p></div></article></body></html>"
    other = f"<html><body><article><p>A small box.</p></article><div class=story><p>{body}</p></div></body></html>"
    rows = [(i, f"https://a.example/{i}", page) for i in range(20)] + [(90, "https://a.example/90", other), (91, "https://b.example/", page)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].split("\n")[:2] == ["Heading", "The lead."] for i in (*range(20), 91))
    assert "A small box." not in got[90] and got[90].count("word") == 200


def test_html_in_linear_time_and_with_clashing_columns(spark):
    import time

    took = []
    for n in (5_000, 40_000):
        pages = ["<div>" * n + "deep", "<div>x" * n, "<b>" * n + "<pre></pre>" * n + "end", "<p>" * n + "</b>" * n + "end", "<a " * n, "<b>" * n + "</div>" * n]
        began = time.process_time()
        for page in pages:
            assert html.main_text(page, None) or page.startswith("<b>")
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] * 2.5
    df = spark.createDataFrame([(1, "http://a.test/", PAGE, "x", 5)], "page_id long, url string, html string, path string, share int")
    assert html.extract(df).collect()[0].text.startswith("T & u")
    assert html.extract(df.limit(0)).count() == 0


def test_html_of_a_block_behind_text():
    assert html.main_text("<body>one<nav><p>menu</p></nav>two<div class=ad>buy</div>three", None) == "one\ntwo\nthree"


@needs_tables
def test_html(spark):
    rows = [(1, "http://a.test/1", PAGE), (2, "http://a.test/2", PAGE.replace("One", "Uno")), (3, None, None), (4, "http://b.test", ""), (5, "http://b.test", "no markup at all"), (6, "x", "<p>" * 3000 + "deep"), (7, "http://c.test", "<div><p>1 < 2 & 3 <b")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "T & u\nOne two three\nLast <x> link" and got[2].split("\n")[1] == "Uno two three"
    assert got[3] == got[4] == "" and got[5] == "no markup at all" and got[6] == "deep" and got[7].startswith("1 < 2 & 3")
    import html as escapes

    pages = texts("pages", "html", "page_id")
    out = {r.page_id: (r.text, r.n_chars) for r in html.op10_html(spark, SF).collect()}
    for i, page in pages.items():
        inside = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
        want = "\n".join(b for b in (" ".join(escapes.unescape(re.sub(r"</?b>|<br>", " " if "<br>" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)) if b)
        assert out[i] == (want, len(want))


# the registry and the pipeline


@needs_tables
def test_registered_sql(spark):
    from simplicia.llm import queries as registry

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, SF)
        columns = sorted(df.columns)
        want = sorted(map(str, con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()))
        assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == want


@needs_tables
def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).collect()
    ids = [r.doc_id for r in out]
    assert 0 < len(ids) < len(texts()) and len(set(ids)) == len(ids) and all(r.round_trip for r in out)
    # only English has enough texts here for an estimate
    bad = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{SF}/labels.parquet' JOIN '{SF}/documents.parquet' USING (doc_id) WHERE quality = 0 AND lang = 'en'").fetchall()}
    assert not bad.intersection(ids)


def test_pipeline_stages_on_odd_documents(spark):
    """Empty documents, null ids and texts, repeated rows and extra columns through every stage."""
    import corpus_pipeline as cp

    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdeilnorst"), rng.integers(2, 9))) for _ in range(300)]
    prose = [" ".join(rng.choice(words, 80)) for _ in range(6)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(prose)]
    rows += [(0, prose[0], "en", "s", 1), (20, prose[1], None, None, None), (None, prose[2] + " more", "en", "s", 3), (30, None, "en", "s", None), (31, "", "en", "s", 0), (32, prose[3] + "\n" + prose[3], "en", "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("clash")).withColumn("cls", F.lit(1))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == cp.COLUMNS and stage(spark, df.limit(0), SF).count() == 0
        found = [r.doc_id for r in out.collect()]
        assert None in found and 1 in found and 5 in found
        if name == "near_duplicates":
            assert 20 not in found and found.count(0) == 2
    out = cp.STAGES[-1][1](spark, df, SF).collect()
    assert len(out) == len(rows) and all(r.round_trip for r in out) and {r.n_tokens for r in out if r.doc_id in (30, 31)} == {0}
