"""Hard negatives, centroid clustering and passage removal against brute force, with the cases that must not break them."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from simplicia.llm import centroids, negatives, substrings

VEC = "vec_id long, embedding array<float>, label int, tile int, v int"


# hard negatives


@pytest.mark.parametrize("dims, size", [(1, 3), (64, 400), (64, 1 << 20), (70, 1 << 27), (1500, 1 << 10), (0, 1)])
def test_scores_are_exact(dims, size):
    rng = np.random.default_rng(dims + size)
    a, b = (rng.integers(-size, size + 1, (n, dims)) for n in (7, 11))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    assert negatives.exact_scores(a, b).tolist() == want


def test_moduli_are_primes_that_stay_exact():
    for dims in (1, 64, 768, 5000):
        found = negatives.moduli(dims, 1 << 61)
        assert all(all(p % q for q in range(2, p)) for p in found) and len(set(found)) == len(found)
        assert min(dims, negatives.WIDTH) * (max(found) // 2) ** 2 <= negatives.EXACT and np.prod([float(p) for p in found]) > 2.0**62


def test_window_of_a_positive():
    p = np.array([-7, 0, 1, 10, 33, 12345, (1 << 62) - 1])
    least, most = negatives.window(p, 30, 90)
    for x, lo, hi in zip(p.tolist(), least.tolist(), most.tolist(), strict=True):
        assert 100 * lo >= 30 * x > 100 * (lo - 1) and 100 * hi <= 90 * x < 100 * (hi + 1)


def plain_negatives(rows, anchor, k, m):
    out = set()
    for a, la, va in rows:
        if not anchor(a):
            continue
        score = sorted(((-sum(x * y for x, y in zip(va, v, strict=True)), i, lab) for i, lab, v in rows if i != a and len(v) == len(va)))
        for p, pid, _ in [s for s in score if s[2] == la][:k]:
            fit = [(n, s) for s, n, lab in score if lab != la and 30 * -p <= 100 * -s <= 90 * -p][:m]
            out |= {(a, pid, r + 1, n, -p, -s) for r, (n, s) in enumerate(fit)}
    return out


@pytest.mark.parametrize("spread", [4, 300])
def test_negatives_against_brute_force(spark, spread):
    """Small values give many ties; more rows than the first pieces of columns; anchors that repeat."""
    rng = np.random.default_rng(spread)
    rows = [(i, int(rng.integers(0, 3)), rng.integers(-spread, spread + 1, 4 if i % 9 else 3).tolist()) for i in range(700)]
    df = spark.createDataFrame([*rows, rows[0], rows[35]], "vec_id long, label int, v array<bigint>")
    once = df.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")
    got = {tuple(r) for r in negatives.hard_negatives(once, F.col("vec_id") % 35 == 0).collect()}
    assert got and got == plain_negatives(rows, lambda i: i % 35 == 0, 5, 10)


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.5], 2), (2, [0.5, 0.5], 2), (3, None, 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 2), (None, [1.0, 1.0], 1), (7, [1.0, 1.0], None), (8, [3e38, 1.0], 1), (9, [], 1), (10, [1.0], 2)]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], VEC)
    v = negatives.integer_vectors(df, "embedding", F.col("label"), 256.0)
    assert sorted(r[0] for r in v.collect()) == [0, 1, 2, 9, 10]
    assert [tuple(r) for r in negatives.hard_negatives(v, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 98304, 65536)]
    assert negatives.hard_negatives(v.limit(0), F.col("vec_id") == 0).count() == 0


# centroid clustering


def test_curve_visits_neighbours():
    """On a full grid the order by key is a path: consecutive cells differ by one step in one dimension."""
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = centroids.hilbert_keys(cells, bits)
        assert len(set(keys)) == len(cells)
        path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_box_bounds_keep_every_nearest():
    rng = np.random.default_rng(1)
    for _ in range(200):
        c = rng.integers(-20, 20, (9, 3))
        v = rng.integers(-20, 20, 3) + rng.integers(0, rng.integers(2, 12), (40, 3))
        of = centroids.candidates(v.min(axis=0), v.max(axis=0), c)
        d = centroids.squared_distances(v, c)
        assert set(d.argmin(axis=1)) <= set(of.tolist())
        assert (d == ((v[:, None] - c[None]) ** 2).sum(axis=2)).all()
    far = rng.integers(-(1 << 27), 1 << 27, (5, 64))
    assert (centroids.squared_distances(far, far[:2]) == [[sum((int(x) - int(y)) ** 2 for x, y in zip(p, q, strict=True)) for q in far[:2]] for p in far]).all()


def plain_clusters(rows, k, rounds):
    names = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)[:k]
    c = [list(v) for _, v in names]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, q, strict=True)), j) for j, q in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in rows]
        for j in range(len(c)):
            if own := [v for (_, v), a in zip(rows, at, strict=True) if a == j]:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [near(v) for _, v in rows]
    total = {j: sum(d for d, a in found if a == j) for j in range(len(c))}
    return sorted((i, a, d, total[a], sum(total.values()), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), (d, a) in zip(rows, found, strict=True))


@pytest.mark.parametrize("n", [1, 5, 900])
def test_clusters_against_brute_force(spark, n):
    """Ties, copies beyond a block's size, and fewer vectors than centroids."""
    rng = np.random.default_rng(n)
    rows = [(i, (rng.integers(-9, 9, 3) if i % 3 else np.array([4, -4, 4])).tolist()) for i in range(n)] + [(0, [1, 2, 3])]
    df = spark.createDataFrame(rows, "vec_id long, v array<int>")
    assert sorted(tuple(r) for r in centroids.clustered(df, 3, k=16).collect()) == plain_clusters(rows, 16, 3)


def test_odd_vectors_are_left_out(spark):
    nan = float("nan")
    rows = [(1, [1.0, 2.0], 0), (2, [1.0], 0), (3, None, 0), (4, [nan, 1.0], 0), (5, [None, 1.0], 0), (6, [1e30, 0.0], 0), (None, [1.0, 2.5], 0), (1, [1.0, 2.0], 0), (7, [float("-inf"), 1.0], 0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], VEC)
    v = centroids.integer_vectors(df, "embedding", 2, 64.0)
    assert sorted((r["vec_id"] or -1, r["v"]) for r in v.collect()) == [(-1, [64, 160]), (1, [64, 128]), (1, [64, 128])]
    got = centroids.clustered(v, 2).collect()
    assert sorted((r["vec_id"] or -1, r["cluster"], r["distance"]) for r in got) == [(-1, 0, 0), (1, 1, 0), (1, 1, 0)]  # equal centroids at first; the mean draws the smaller number away
    empty = centroids.clustered(v.limit(0), 2)
    assert empty.count() == 0 and "centroid_sha256" in empty.columns


# passages


def plain_cut(rows, length):
    """n_words, n_removed and kept text of every row."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first: dict = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - length + 1):
                key = tuple(w[k : k + length])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - length + 1) if i is not None else ():
            if first[tuple(w[k : k + length])] < i:
                gone |= set(range(k, k + length))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


def cut(spark, rows, length=13):
    df = spark.createDataFrame([(i, t, "en", 1, 2) for i, t in rows], "doc_id long, text string, lang string, row int, places int")
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], *list(r)[1:]) for r in substrings.without_repeats(df, length).collect())


def test_window_hashes_are_those_of_the_words():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**63, 40).astype(np.uint64)
    for length in (1, 2, 3, 7, 13, 16, 21):
        h = substrings.window_hashes(words, length)
        again = [substrings.window_hashes(words[i : i + length], length)[0] for i in range(len(words) - length + 1)]
        assert h.tolist() == [int(x) for x in again] and len(set(h.tolist())) == len(h)
    assert len(substrings.window_hashes(words[:5], 6)) == 0


def test_equal_windows_have_equal_seeds():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 3, 500).astype(np.uint64)  # many equal half windows
    at, _ = substrings.seeds(words, 13)
    offset = {}
    for i, s in enumerate(at.tolist()):
        assert i <= s <= i + 6 and offset.setdefault(tuple(words[i : i + 13].tolist()), s - i) == s - i


@pytest.mark.parametrize("length", [1, 2, 5, 13])
def test_passages_against_brute_force(spark, length):
    rng = np.random.default_rng(length)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [list(rng.choice(vocabulary, n)) for n in (13, 14, 20, 60, 5, 2)]
    rows = []
    for i in range(60):
        w = list(rng.choice(vocabulary, int(rng.integers(0, 40))))
        for p in rng.choice(len(passages), int(rng.integers(0, 4))):
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = passages[p]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(5, rows[5][1]), (7, rows[40][1]), (None, rows[3][1]), (100, rows[50][1]), (101, "a " * 400), (102, "a " * 30), (103, None), (104, ""), (105, " \n"), (106, "été 你好 " * 9), (107, "été 你好 " * 7)]
    assert cut(spark, rows, length) == plain_cut(rows, length)


def test_a_passage_in_a_third_of_all_documents(spark):
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(i, f"x{i} {shared} y{i}" if i % 3 == 0 else f"z{i} " * 20) for i in range(600)]
    assert cut(spark, rows) == plain_cut(rows, 13)


def test_long_text_and_empty_table(spark):
    long = " ".join(f"v{i % 9973}" for i in range(400_000))
    got = cut(spark, [(1, "v5 " * 12), (2, long), (3, " ".join(long.split()[100:200]))])
    assert [(r[1], r[2]) for r in got] == [(12, 0), (400_000, 0), (100, 100)]
    assert cut(spark, [(None, "a " * 20)]) == plain_cut([(None, "a " * 20)], 13)
    assert substrings.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_doubling_goes_on_until_nothing_survives(spark):
    """Longest level of every document against all windows of each level."""
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(130)]
    texts = [passage[a : a + n] + [f"x{k}y{i}" for i in range(9)] for k, (a, n) in enumerate([(0, 130), (3, 55), (0, 13), (60, 30), (5, 110), (0, 12), (20, 4)])]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(20, " ".join(texts[0])), (20, " ".join(rng.permutation(passage))), (None, " ".join(texts[0])), (30, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["longest"]) for r in substrings.longest_repeats(df, 7).collect())
    want = []
    for i, t in rows:
        best, size, w = 0, 7, (t or "").split()
        while i is not None and size <= len(w):
            own = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
            if any(j is not None and j < i and own & {tuple(u.split()[k : k + size]) for k in range(len(u.split()) - size + 1)} for j, u in rows if u):
                best = size
            size *= 2
        want.append((-1 if i is None else i, best))
    assert got == sorted(want) and max(b for _, b in want) == 112
    assert {r["longest"] for r in substrings.longest_repeats(df.limit(1), 7).collect()} == {0}
