"""Cases of earlier operators: names of text on pages, pages of div only, rows of one doc_id with different texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from simplicia.llm import html, lines

LONG = "It is the text of the page and goes on for a while, sentence after sentence. " * 4


@pytest.mark.parametrize("box", ['<h2 id="related-work">Work</h2>', '<section class="legal-analysis"><p>Work</p></section>', '<p class="notice-period">Work</p>', '<div class="social-contract">Work</div>', '<h3 class="promo">Work</h3>'])
def test_names_of_text_stay(box):
    page = f"<body><nav>x</nav><article><h1>T</h1><p>{LONG}</p>{box}<p>End.</p></article></body>"
    assert html.main_text(page, None) == f"T\n{LONG.strip()}\nWork\nEnd."


@pytest.mark.parametrize("name", ["ad", "ad-slot", "share-buttons", "related-posts", "newsletter-box", "cookie-notice", "comment-list", "sidebar", "ads2", "promo_block"])
def test_names_of_boxes_go(name):
    page = f'<body><article><h1>T</h1><p>{LONG}</p><div class="{name}">Buy</div></article></body>'
    assert html.main_text(page, None) == f"T\n{LONG.strip()}"


def test_pages_of_div_only_keep_heading_and_lead():
    page = f'<body><div class="page"><div class="top"><h1>T</h1><p>Lead.</p></div><div class="text"><p>{LONG}</p><p>{LONG}</p></div></div><div class="rest"><a href="/">more</a></div></body>'
    assert html.main_text(page, None) == f"T\nLead.\n{LONG.strip()}\n{LONG.strip()}"
    links = page.replace("<p>Lead.</p>", '<p><a href="/a">One</a> <a href="/b">Two and more</a></p>')
    assert html.main_text(links, None) == f"{LONG.strip()}\n{LONG.strip()}"


def test_conflicting_ids_lose_their_duplicates(spark):
    m, other = "This is the line that stands twice in here.", "Another line that has nothing to do with it."
    rows = [(0, m), (1, other), (1, m), (2, m), (2, m), (None, m)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_lines int")
    got = sorted((r["doc_id"], r["n_removed"]) for r in lines.without_duplicates(df.filter(F.col("doc_id").isNotNull())).collect())
    assert got == [(0, 0), (1, 0), (1, 1), (2, 1), (2, 1)]
    apart = spark.createDataFrame([(5, m), (5, m + "!"), (6, m + "?")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in lines.without_duplicates(apart).collect()) in ([(5, 0), (5, 1), (6, 0)], [(5, 0), (5, 1), (6, 1)])
    assert lines.without_duplicates(df).filter("doc_id is null and n_removed > 0").isEmpty()


def test_one_long_piece_of_text():
    """A piece of a million letters takes seconds, and its ids are the library's."""
    import time

    import numpy as np
    from tokenizers import Tokenizer

    from simplicia.llm import bpe

    spec = open(bpe.default_vocabulary(), encoding="utf-8").read()
    coder, library = bpe.PrefixCoder.of(spec), Tokenizer.from_str(spec)
    rng = np.random.default_rng(0)
    pieces = ["".join(rng.choice(list("etaoinshrdlu"), n)) for n in (511, 512, 513, 20_000)] + ["a" * 3000, "é" * 700, "short", "-" * 2000]
    text = " ".join(pieces)
    ids, at = coder.encode_texts([text.encode(), b"", "ß" .encode() * 900])
    assert ids[at[0] : at[1]].tolist() == library.encode(text, add_special_tokens=False).ids
    assert ids[at[2] : at[3]].tolist() == library.encode("ß" * 900, add_special_tokens=False).ids
    began = time.time()
    coder.encode_texts(["".join(rng.choice(list("etaoinshrdlu"), 1_000_000)).encode()])
    assert time.time() - began < 30  # about four on an idle machine


def plain_components(sets):
    """Smallest number reachable by links, by all pairs."""
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return [find(x) for x in range(len(sets))]


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


@pytest.mark.parametrize("small, pivots", [(8, 4), (20, 16), (4, 1)])
def test_large_regions_join_recursively(spark, monkeypatch, small, pivots):
    """Groups of near copies, chains and strangers that share most of a passage, in regions cut again and again."""
    import numpy as np

    from simplicia.llm import jaccard

    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", small)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    rng = np.random.default_rng(small)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for g in range(12):  # groups around texts of their own that share the passage's half
        base = passage[:30] + [f"g{g}x{i}" for i in range(40)]
        for _ in range(int(rng.integers(1, 12))):
            t = list(base)
            for k in rng.integers(30, 70, int(rng.integers(0, 3))):
                t[k] = f"e{rng.integers(0, 10**6)}"
            rows.append(t)
    rows += [passage + [f"s{n}y{i}" for i in range(18)] for n in range(60)]  # strangers: about 0.6 of the union
    chain = [f"c{i}" for i in range(80)]
    rows += [passage + chain[k : k + 60] for k in range(0, 20, 2)]  # each links with its neighbours only
    order = rng.permutation(len(rows))
    texts = [rows[k] for k in order]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == plain_components([shingles(t) for t in texts])


def test_a_split_keeps_every_link(spark):
    """Each link lies within one of the regions that a split makes."""
    import numpy as np

    from simplicia.llm import jaccard

    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(50)]
    texts = []
    for _ in range(90):
        t = list(words)
        for k in rng.integers(0, 50, int(rng.integers(0, 5))):
            t[k] = f"e{rng.integers(0, 10**6)}"
        texts.append(t)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found, _, classes = jaccard.join_classes(df)
    cls = {r["doc_id"]: r["cls"] for r in found.select("doc_id", "cls").collect()}
    rows = classes.select("cls").distinct().withColumns({"region": F.lit(7).cast("long"), "root": F.col("cls")}).select("region", "cls", "root")
    cut, _ = jaccard._split(rows, jaccard.Verifier(df.select("doc_id", "text"), classes), 1)
    members: dict = {}
    for r in cut.collect():
        members.setdefault(r["region"], set()).add(r["cls"])
    sets = [shingles(t) for t in texts]
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 100 * both >= 75 * (len(a) + len(sets[j]) - both) and cls[i] != cls[j]:
                assert any({cls[i], cls[j]} <= m for m in members.values())


def test_gam_scores_are_sums_of_bins():
    """Vectorised scores against a plain walk over the tables of one row."""
    import bisect
    import math

    import numpy as np

    from simplicia.llm import gam

    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, len(gam.FEATURE_NAMES)))
    x[:, 1] = rng.integers(0, 3, 700)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=700) > 0.5).astype(float)
    m = gam.fit(x, y)
    new = np.vstack([rng.normal(size=(50, x.shape[1])) * 3, x[:50]])
    want = []
    for row in new:
        z = m.intercept + sum(t[bisect.bisect_right(c.tolist(), v)] for t, c, v in zip(m.tables, m.cuts, row, strict=True))
        z += sum(t[bisect.bisect_right(m.coarse[a].tolist(), row[a]), bisect.bisect_right(m.coarse[b].tolist(), row[b])] for a, b, t in m.pairs)
        want.append(1 / (1 + math.exp(-z)))
    assert m.score(new) == pytest.approx(np.array(want)) and m.pairs


def test_boosted_step_is_the_best_split():
    """With two leaves a step is the best of all splits of the bins."""
    import numpy as np

    from simplicia.llm import gam

    rng = np.random.default_rng(4)
    for _ in range(40):
        n = int(rng.integers(2, 12))
        g, h = rng.normal(size=n) * 10, rng.random(n) * 5 + 0.1
        step = gam._steps(g, h, 2)
        gains = []
        for k in range(1, n):
            gains.append(sum(gam._steps(g[part].sum(keepdims=True), h[part].sum(keepdims=True), 1)[0] * g[part].sum() for part in (slice(0, k), slice(k, n))))
        assert float((step * g).sum()) == pytest.approx(max([*gains, float((gam._steps(g, h, 1) * g).sum())]))


def test_vote_of_hosts_against_plain_counting(spark):
    """The consensus path of each host by plain sums of rounded shares."""
    import collections

    inner = lambda k, n: f"<div class='c{k}'><p>{'word ' * n}</p></div>"
    pages = []
    for k in range(24):
        host = ["a.org", "b.org", None][k % 3]
        page = f"<body><div class='top'><a href='/'>home page</a></div>{inner(k % 2, 30 + k)}<div class='low'>{inner(7, 4)}<p>tail</p></div></body>"
        if k % 5 == 0:
            page = f"<body><main><h1>T</h1>{inner(3, 25)}</main></body>"
        pages.append((host, page))
    pages += [("c.org", None), ("c.org", ""), ("c.org", "<p>plain</p>")]
    got = {r["host"]: r["path"] for r in html.vote(spark.createDataFrame(pages, "host string, html string")).collect()}
    tally: dict = collections.defaultdict(lambda: [0, 0, ""])
    for host, page in pages:
        out, found = html.blocks(page or "")
        own: dict = collections.defaultdict(float)
        for x, s in html.shares(out, found).items():
            own[found[x].label, found[x].article, found[x].depth] += s
        for (label, article, depth), s in own.items():
            t = tally[host, label]
            t[0], t[1], t[2] = t[0] + round(s * 1000), max(t[1], depth), max(t[2], article)
    want = {}
    for host in {h for h, _ in tally}:
        mine = {label: t for (h, label), t in tally.items() if h == host}
        top = max(t[0] for t in mine.values())
        near = [(t[1], t[0], label, t[2]) for label, t in mine.items() if t[0] > 0 and t[0] >= html.NEARLY * top]
        if near:
            depth, share, label, article = max(near)
            want[host] = article or label
    assert got == want and {"a.org", "b.org", None} <= set(got)
