"""URL filter by association rules: FP-growth mines token combinations that go with bad labels; rules pruned by
confidence and support are matched through an inverted index on one token of each.

A base list of host and path rules comes first (the longest that fits wins); mined rules decide the rest, and
what no rule fits is allowed. Null urls and urls without :// have an empty host and path, no rule and `allow`.
Repeated pages give repeated rows; extra columns are not read; without labelled urls no rule is mined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simplicia.llm.common import ascii_lower, join_counted, stored, table

#: Fixed values of the base contract: (verdict, host, path).
BASE_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
BAD = "label:bad"
#: Production parameters: a rule stands if at least this share of the labelled urls shows it, it is right this
#: often, and this many times as often as labels are bad at large.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.001, 0.3, 1.5
#: Labelled urls that must show a rule, however few there are.
MIN_URLS = 5


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def base_rule(host: Column, path: Column, rules=BASE_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest base rule that fits; null where none does."""
    fits = [(h + p, v, ((host == h) | host.endswith("." + h)) & path.startswith(p)) for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    first = lambda values: F.coalesce(*[F.when(hit, F.lit(x)) for x, hit in values])
    return first([(r, hit) for r, _, hit in fits]), first([(v, hit) for _, v, hit in fits])


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a url: labels of the host, words of the path (numbers as one kind), keys of the query."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    words = lambda text, cut, mark: F.transform(F.filter(F.split(text, cut), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    path_words = words(F.regexp_replace(ascii_lower(path), "[0-9]+", "#"), r"[/._-]+", "p:")
    keys = words(F.regexp_replace(ascii_lower(query), "=[^&]*", ""), "&", "q:")
    return F.coalesce(F.array_distinct(F.concat(words(host, r"[.]+", "h:"), path_words, keys)), F.array().cast("array<string>"))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """labelled: url, bad boolean. Returns antecedent array<string>, confidence, support (of antecedent and label), lift and
    key, the token under which the index keeps the rule: its rarest.

    Tokens that stand in the same urls are one item to FP-growth, and all of them in the rule: the itemsets of a url
    template don't double with each of its fixed tokens, and no rule is lost by it."""
    urls = stored(labelled.select(F.monotonically_increasing_id().alias("id"), tokens_of(F.col("url")).alias("tokens"), F.coalesce("bad", F.lit(False)).alias("bad")), "url-baskets")
    total = urls.count()
    held = urls.select("id", F.explode("tokens").alias("token"))
    counts = held.groupBy("token").agg(F.count("*").alias("count"), F.bit_xor(F.xxhash64("id")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("h2"))
    counts = stored(counts, "url-tokens")
    alike = stored(counts.groupBy("count", "h1", "h2").agg(F.min("token").alias("item"), F.collect_set("token").alias("tokens")).select("item", "tokens"), "url-items")
    items = held.join(alike.select(F.col("item").alias("token")), "token").groupBy("id").agg(F.collect_list("token").alias("items"))
    mark = F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))
    baskets = stored(urls.select("id", "bad").join(items, "id", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), mark).alias("items")), "url-itemsets")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, MIN_URLS / max(total, 1))), minConfidence=min_confidence).fit(baskets.filter(F.size("items") > 0))
    rules = model.associationRules.filter((F.col("consequent")[0] == BAD) & (F.col("lift") >= min_lift))
    rules = rules.select(F.array_sort("antecedent").alias("items"), "confidence", "support", "lift")
    spread = rules.select("*", F.explode("items").alias("item")).join(alike, "item").groupBy("items", "confidence", "support", "lift").agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("antecedent"))
    keyed = spread.select("antecedent", "confidence", "support", "lift", F.explode("antecedent").alias("key")).join(counts.select(F.col("token").alias("key"), "count"), "key")
    return keyed.groupBy("antecedent", "confidence", "support", "lift").agg(F.min_by("key", F.struct("count", "key")).alias("key"))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls that a mined rule fits, with the most confident rule."""
    index = stored(rules, "url-rules")
    tokens = urls.select("url").distinct().select("url", tokens_of(F.col("url")).alias("tokens")).select("url", "tokens", F.explode("tokens").alias("key"))
    hits = join_counted(tokens, index, ["key"], index.count(), how="inner").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.struct("confidence", "support", F.array_join("antecedent", " ").alias("mined"))
    return hits.groupBy("url").agg(F.max(best).alias("best")).select("url", "best.mined", "best.confidence")


def judge(pages: DataFrame, rules: DataFrame, base=BASE_RULES) -> DataFrame:
    """pages: page_id, url. Adds host, path, rule, verdict, mined (the mined rule's tokens) and its confidence."""
    matched = stored(match_rules(pages.filter(F.col("url").isNotNull()), rules), "url-matches")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = base_rule(F.col("host"), F.col("path"), base)
    out = join_counted(pages.select("page_id", "url"), matched, ["url"], matched.count())
    out = out.select("page_id", host.alias("host"), path.alias("path"), "mined", "confidence")
    mined = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), F.col("mined").alias("mined_rule"), "confidence")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Urls of pages that show a labelled document: its number is the last number of the path."""
    shown = pages.select("url", F.regexp_extract(path_of(F.col("url")), r"/(\d{1,18})(?:\.\w+)?/?$", 1).try_cast("long").alias("doc_id"))
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    return shown.filter(F.col("doc_id").isNotNull()).join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("url", "bad")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    rules = mine_rules(labelled_urls(pages, table(spark, sf_dir, "labels")))
    return judge(pages, rules)
