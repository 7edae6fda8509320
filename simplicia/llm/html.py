"""Main text of web pages by consensus paths: every page scores its containers, hosts vote on generalised
tag-class paths in Spark, and pages are extracted again through the winning path of their host.

A container's share is the part of the page's readable text inside it, less what is link text. A host takes the
deepest path that holds nearly as much as its best, or the nearest article or main around it, as heading and lead
stand beside the inner container. A page where that path holds clearly less than the page's own best container falls
back to the latter. A name of a box (class or id) makes it noise only if all its parts are words of noise or layout, and
never a heading or a paragraph, so that related-work or notice-period stay text. Pages are parsed in linear time, alone; votes are pre-aggregated before they meet, so a host with a
third of all pages sends a few rows from each task.

Null and empty html give an empty text; urls without a host vote together as one; repeated rows give equal rows;
extra columns are not read. <br> counts as white space inside its block.
"""

from __future__ import annotations

import html as _html
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from simplicia.llm.common import join_counted, raw_texts, sliced, stored, table
from simplicia.llm.urls import host_of

#: Fixed values of HTML: elements that end at their start tag, elements whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
#: Elements that break lines.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CONTAINER = frozenset("article body div main section td center".split())
#: Elements and names that are never main text.
SKIPPED = frozenset("head script style noscript template nav header footer aside form button select option textarea iframe svg math canvas object audio video dialog menu title xmp noframes".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement adbox adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended toolbar pagination pager widget widgets legal copyright skip".split()
)
#: Parts that may stand beside a noise word in the name of a box of the layout. Any other part, as in related-work or
#: notice-period, makes it a name of the text.
LAYOUT = frozenset(
    "area bar block body bottom box btn button buttons card cards center col column container drop dropdown feed fixed form global group head holder icons inner item items js large left list links lower main mobile module outer pane panel panels placeholder post posts right row section site slot small sticky story stories tab tabs tools top unit upper view wide widget wrap wrapper zone".split()
)
#: Elements that are text, whatever they are called.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Elements that implied end tags don't cross.
_WALL = CONTAINER | {"ul", "ol", "table", "dl", "blockquote"}
_RAW_END = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}
#: Names of a path that its label shows.
LABELLED = 8
#: A host takes the deepest path with at least this part of the best path's share.
NEARLY = 0.9
#: What stands around a chosen container is left out if more than this part of it is link text.
LINKS = 0.2

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</([a-zA-Z][^\s/>]*)[^>]*>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HEADING_P = BLOCK - {"dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "body", "caption", "legend", "summary"}


def _names(tag: str, attrs: str) -> tuple[str, bool]:
    """Generalised name of an element, and whether its name, role or visibility says that it isn't main text."""
    cls = ident = role = ""
    hidden = False
    for k, a, b, c in _ATTR.findall(attrs):
        k = k.lower()
        v = a or b or c
        if k == "class":
            cls = v
        elif k == "id":
            ident = v
        elif k == "role":
            role = v.lower()
        elif k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and re.search(r"display\s*:\s*none", v, re.I)):
            hidden = True
    classes = sorted({re.sub(r"\d+", "#", x) for x in cls.lower().split()})
    noise = hidden or role in NOISE_ROLES or tag not in PROSE and any(_noisy(x) for x in (*cls.split(), *ident.split()))
    return ".".join([tag, *classes]), noise


def _noisy(name: str) -> bool:
    """Whether a class or id is made of noise words and words of the layout; comments are noise whatever precedes."""
    parts = [x for x in re.split(r"[-_\d]+", name.lower()) if x]
    if not parts:
        return False
    if parts[-1] in ("comment", "comments") or parts[0] in ("comment", "comments"):
        return True
    return not NOISE.isdisjoint(parts) and all(x in NOISE or x in LAYOUT for x in parts) and parts[-1] not in ("main", "body") and parts[0] != "main"


class Container:
    """An element that may hold the main text. label names its generalised path in bounded length: a hash of the whole
    path, its depth and its last LABELLED names; article is the label of the nearest article or main around it; titles counts
    the h1 inside."""

    __slots__ = ("parent", "label", "article", "depth", "is_article", "text", "links", "titles")

    def __init__(self, parent: int, label: str, article: str, depth: int, is_article: bool):
        self.parent, self.label, self.article, self.depth, self.is_article = parent, label, article, depth, is_article
        self.text = self.links = self.titles = 0


def blocks(page: str) -> tuple[list[tuple[str, int, int]], list[Container]]:
    """Readable blocks in page order: text, characters of link text, the number of the container around it or -1; and the
    containers, whose numbers grow in page order, with the text inside each. Linear: every start tag is pushed and
    popped once, what a tag closes is found by the places of open tags, and paths are hashes of their parents'."""
    out: list[tuple[str, int, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, skipped, whether it is a container
    open_at: dict[str, list[int]] = {}
    walls: list[int] = []  # places of containers and lists, which implied end tags don't cross
    inside: list[int] = [-1]
    paths: list[tuple[int, tuple, int]] = [(0, (), 0)]  # of open blocks: hash, last names, depth
    found: list[Container] = []
    parts: list[str] = []
    links = anchors = skipped = 0

    def flush():
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, min(links, len(text)), inside[-1]))
            parts.clear()
        links = 0

    def text_of(raw: str):
        nonlocal links
        if raw and not skipped:
            t = _html.unescape(raw)
            parts.append(t)
            if anchors:
                links += len(t.strip())

    def pop():
        nonlocal anchors, skipped
        tag, skip, held = stack.pop()
        open_at[tag].pop()
        if tag in BLOCK:
            paths.pop()
            if not skipped:
                flush()
        if tag in _WALL:
            walls.pop()
        skipped -= skip
        anchors -= tag == "a"
        if held:
            inside.pop()

    def last(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)

    at, end = 0, page.rfind(">") + 1
    while at < end:
        m = _TOKEN.search(page, at, end)
        if m is None:
            break
        text_of(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag in RAW:
                close = _RAW_END[tag].search(page, at)
                at = page.find(">", close.start()) + 1 or len(page) if close else len(page)
                continue
            if tag in VOID:
                if tag == "hr" and not skipped:
                    flush()
                elif tag == "br" and not skipped:
                    parts.append(" ")
                continue
            closes = _CLOSED_BY.get(tag, ())
            k = max(last(closes), last("p") if tag in _HEADING_P else -1)
            if k >= 0 and k >= (walls[-1] if walls else 0):
                while len(stack) > k:
                    pop()
            if m[2].endswith("/") and tag not in BLOCK:
                continue
            name, noise = _names(tag, m[2]) if m[2].strip() else (tag, False)
            skip = noise and tag not in ("html", "body", "article", "main") or tag in SKIPPED
            held = tag in CONTAINER and not skip and not skipped
            if tag in BLOCK:
                if not skipped:
                    flush()
                    if tag == "h1" and not skip and inside[-1] >= 0:
                        found[inside[-1]].titles += 1
                above, names, depth = paths[-1]
                paths.append((zlib.crc32(name.encode(), above), (*names[-LABELLED + 1 :], name), depth + 1))
            if held:
                digest, names, depth = paths[-1]
                label = f"{'.../' if depth > LABELLED else ''}{'/'.join(names)}#{depth}.{digest:08x}"
                is_article = tag in ("article", "main")
                around = found[inside[-1]].article if inside[-1] >= 0 else ""
                found.append(Container(inside[-1], label, label if is_article else around, depth, is_article))
                inside.append(len(found) - 1)
            if tag in _WALL:
                walls.append(len(stack))
            open_at.setdefault(tag, []).append(len(stack))
            stack.append((tag, skip, held))
            skipped += skip
            anchors += tag == "a"
        elif m[3]:
            tag = m[3].lower()
            k = last((tag,))
            if k >= 0 and (tag in BLOCK or k >= last(CONTAINER)):
                while len(stack) > k:
                    pop()
    text_of(page[at:])
    while stack:
        pop()
    flush()
    for text, n, x in out:
        if x >= 0:
            found[x].text += len(text)
            found[x].links += n
    for c in reversed(found):
        if c.parent >= 0:
            found[c.parent].text += c.text
            found[c.parent].links += c.links
            found[c.parent].titles += c.titles
    return out, found


def shares(out, found: list[Container]) -> dict[int, float]:
    """By number of a container with text: the part of the page's text inside it, less what is link text."""
    total = sum(len(t) for t, *_ in out)
    return {x: max(0.0, (c.text - c.links) / total) for x, c in enumerate(found) if c.text}


def best_container(scored: dict[int, float], found: list[Container]) -> int:
    if not scored:
        return -1
    top = max(scored.values())
    x = max((found[x].depth, s, -x) for x, s in scored.items() if s >= NEARLY * top)[2] * -1
    y = x
    while y >= 0 and not found[y].is_article:
        y = found[y].parent
    return y if y >= 0 else x


def with_title(x: int, found: list[Container]) -> int:
    """The container to take for a chosen one: where it has no h1, the nearest one around it that has just one, if what that
    adds is smaller than the chosen text and hardly made of links, as in pages of div only."""
    c = found[x] if x >= 0 else None
    if c is None or c.titles or c.is_article:
        return x
    y = c.parent
    while y >= 0 and not found[y].titles:
        y = found[y].parent
    if y < 0 or found[y].titles > 1:
        return x
    more, links = found[y].text - c.text, found[y].links - c.links
    return y if more < c.text and links <= LINKS * more else x


def main_text(page: str, path: str | None) -> str:
    out, found = blocks(page)
    scored = shares(out, found)
    voted = {x: s for x, s in scored.items() if found[x].label == path and s > 0}
    chosen = set(voted) if voted and sum(voted.values()) >= NEARLY * max(scored.values()) else {best_container(scored, found)}
    if len(chosen) == 1:
        chosen = {with_title(x, found) for x in chosen}
    within = []
    for x, c in enumerate(found):
        within.append(x in chosen or c.parent >= 0 and within[c.parent])
    return "\n".join(t for t, _, x in out if (within[x] if x >= 0 else chosen == {-1}))


def vote(pages: DataFrame) -> DataFrame:
    """pages: host, html. Returns host and path, the consensus of the host's pages."""

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            hosts, paths, articles, depths, scores = [], [], [], [], []
            for host, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                out, found = blocks(raw.decode("utf-8", "replace"))
                best: dict[tuple[str, str, int], float] = {}
                for x, s in shares(out, found).items():
                    key = (found[x].label, found[x].article, found[x].depth)
                    best[key] = best.get(key, 0.0) + s
                for (label, around, depth), s in best.items():
                    hosts.append(host)
                    paths.append(label)
                    articles.append(around)
                    depths.append(depth)
                    scores.append(round(s * 1000))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(articles, pa.string()), pa.array(depths, pa.int32()), pa.array(scores, pa.int64())], names=["host", "path", "article", "depth", "share"])

    votes = pages.select("host", "html").mapInArrow(run, "host string, path string, article string, depth int, share long")
    tally = votes.groupBy("host", "path").agg(F.sum("share").alias("share"), F.max("depth").alias("depth"), F.max("article").alias("article"))
    top = tally.withColumn("top", F.max("share").over(Window.partitionBy("host")))
    near = top.filter((F.col("share") > 0) & (F.col("share") >= NEARLY * F.col("top")))
    around = F.when(F.col("article") != "", F.col("article")).otherwise(F.col("path"))
    return near.groupBy("host").agg(F.max_by(around, F.struct("depth", "share", "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, html. Returns page_id, url, host, path (the host's consensus) and text."""
    pages = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    consensus = stored(vote(pages), "html-paths")
    joined = join_counted(pages, consensus, ["host"], consensus.count()).select("page_id", "url", "host", "path", "html")

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            texts = [main_text(raw.decode("utf-8", "replace"), path) for path, raw in zip(batch.column(3).to_pylist(), raw_texts(batch.column(4)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(texts, pa.string())], names=["page_id", "url", "host", "path", "text"])

    kind = dict(pages.dtypes)["page_id"]
    return joined.mapInArrow(run, f"page_id {kind}, url string, host string, path string, text string")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), F.col("path").alias("consensus_path"))
