"""URL filtering by listed rules, and by association rules mined from the urls that these decide.

The urls that a listed rule fits are the labelled ones; their label is that rule's verdict. Each distinct url is one transaction of tokens: the
domains it lies under, the words of hyphenated names, its path segments, its file extension, its query keys and its label. Spark's FP-growth finds the token combinations that
occur often enough together; a combination gives a mined rule "tokens -> verdict" where its urls carry the label often enough, unless a smaller
combination of its tokens says the same at least as surely. Rules are held in an inverted index by token: a url that no listed rule fits is met
with the rules of its tokens, and a rule matches when all its tokens were met. The surest matching rule decides (largest confidence, then
support, then fewest tokens, then smallest text); without one the url is allowed.

Mining counts distinct urls, so copies of one page do not outvote others. Numbers in segments are written as "#". Counts and confidences come
from exact integers.

Skew: urls are counted once however often they occur; the index has as many rows as the mined rules have tokens (their number falls with the
support bound, not with the corpus) and Spark broadcasts it within its size threshold, so common tokens are no hot keys; beyond it the join is an
ordinary shuffle join.

Defined results: null urls and urls without "://" have an empty host and path, no rule, and are judged by the method; repeated rows are judged
alike; without labelled urls nothing is mined and every other url is allowed; an empty table gives no rows. Other columns are kept apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareloom.llm.tables import Scratch, field

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule): host, then the beginning of the path
LISTED = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
ONE_IN = 100  # a combination is frequent in one of so many labelled urls
LEAST_URLS = 5  # and in so many, however few are labelled
LEAST_CONFIDENCE = 0.9
MOST_TOKENS = 3  # of a mined rule
LABEL = "="  # marks the label among the tokens


def parsed(url: Column) -> dict[str, Column]:
    """host, path and query of a url."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return {"host": host, "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), "query": F.regexp_extract(rest, "^[^?#]*\\?([^#]*)", 1)}


def listed_rule(rules: Sequence[tuple[str, str]] = LISTED) -> Column:
    """struct(rule, verdict) of the longest listed rule that fits ``host`` and ``path``, or null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, path = rule.partition("/")
        fits = ((F.col("host") == domain) | F.endswith(F.col("host"), F.lit("." + domain))) & F.startswith(F.col("path"), F.lit(slash + path))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens() -> Column:
    """The distinct tokens of ``host``, ``path`` and ``query``."""
    labels = F.filter(F.split("host", "\\."), lambda x: x != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    domains = F.when(F.size(labels) > 0, domains).otherwise(F.array().cast("array<string>"))
    words = F.flatten(F.transform(F.filter(labels, lambda x: F.contains(x, F.lit("-"))), lambda x: F.transform(F.split(x, "-"), lambda w: F.concat(F.lit("word:"), w))))
    segments = F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), lambda x: F.concat(F.lit("segment:"), F.regexp_replace(x, "[0-9]+", "#")))
    extension = F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1)
    extensions = F.when(extension != "", F.array(F.concat(F.lit("extension:"), F.translate(extension, UPPER, LOWER)))).otherwise(F.array().cast("array<string>"))
    keys = F.transform(F.filter(F.split("query", "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key:"), F.regexp_extract(x, "^([^=]*)", 1)))
    return F.array_distinct(F.concat(domains, words, segments, extensions, keys))


def mined(urls: DataFrame, scratch: Scratch, one_in: int = ONE_IN, least_confidence: float = LEAST_CONFIDENCE, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """(tokens, verdict, n_urls, n_labelled, confidence, mined_rule) from ``urls(tokens, verdict)``; those without a verdict are not read."""
    spark = urls.sparkSession
    baskets = scratch.keep(urls.filter("verdict IS NOT NULL").select(F.array_append("tokens", F.concat(F.lit(LABEL), F.col("verdict"))).alias("items")))
    total = baskets.count()
    least = max(LEAST_URLS, -(-total // one_in))
    schema = "tokens array<string>, verdict string, n_urls bigint, n_labelled bigint, confidence double, mined_rule string"
    if total < least:
        return spark.createDataFrame([], schema)
    support = (least - 0.5) / total  # rounded up to the count again
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frequent = FPGrowth(itemsCol="items", minSupport=support, numPartitions=partitions).fit(baskets).freqItemsets
    is_label = lambda x: F.startswith(x, F.lit(LABEL))
    sets = frequent.select(F.array_sort(F.filter("items", lambda x: ~is_label(x))).alias("tokens"), F.get(F.filter("items", is_label), 0).alias("label"), "freq")
    sets = scratch.keep(sets.filter(F.size("tokens").between(1, most_tokens)))
    alone = sets.filter("label IS NULL").select("tokens", F.col("freq").alias("n_urls"))
    verdict = F.substring("label", len(LABEL) + 1, 1 << 10)
    rules = sets.filter("label IS NOT NULL").join(alone, "tokens").select("tokens", verdict.alias("verdict"), "n_urls", F.col("freq").alias("n_labelled"), (F.col("freq") / F.col("n_urls")).alias("confidence"))
    rules = scratch.keep(rules.filter(F.col("confidence") >= least_confidence).withColumn("mined_rule", F.array_join("tokens", " ")))
    return scratch.keep(rules.join(redundant(rules), ["mined_rule", "verdict"], "left_anti").select("tokens", "verdict", "n_urls", "n_labelled", "confidence", "mined_rule"))


def redundant(rules: DataFrame) -> DataFrame:
    """(mined_rule, verdict) of rules with a part of their tokens in another rule of the same verdict that is at least as sure.

    Every smaller combination of a rule's few tokens is looked up.
    """
    parts = rules.filter(F.size("tokens") > 1).select("mined_rule", "verdict", "confidence", F.explode(smaller(F.col("tokens"))).alias("part"))
    known = rules.select(F.col("mined_rule").alias("part"), "verdict", F.col("confidence").alias("part_confidence"))
    return parts.join(known, ["part", "verdict"]).filter("part_confidence >= confidence").select("mined_rule", "verdict").distinct()


def smaller(items: Column) -> Column:
    """The texts of all non-empty proper subsets of a sorted array."""
    grown = F.aggregate(items, F.array(F.array().cast("array<string>")), lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.array_append(s, x))))
    return F.transform(F.filter(grown, lambda s: (F.size(s) > 0) & (F.size(s) < F.size(items))), lambda s: F.array_join(s, " "))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined_rule, mined_verdict) of the surest rule of each of ``urls(url, tokens)`` that has one, through the inverted index."""
    index = rules.select(F.explode("tokens").alias("token"), F.size("tokens").alias("size"), "mined_rule", "verdict", "confidence", "n_labelled")
    met = urls.select("url", F.explode("tokens").alias("token")).join(index, "token")
    rank = F.struct((-F.col("confidence")).alias("c"), (-F.col("n_labelled")).alias("n"), F.col("size").alias("s"), F.col("mined_rule").alias("rule"), F.col("verdict").alias("verdict"))
    whole = met.groupBy("url", "mined_rule", "verdict").agg(F.count("*").alias("met"), F.min(rank).alias("rank"), F.min("size").alias("size")).filter("met = size")
    return whole.groupBy("url").agg(F.min("rank").alias("best")).select("url", F.col("best.rule").alias("mined_rule"), F.col("best.verdict").alias("mined_verdict"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = LISTED, one_in: int = ONE_IN, least_confidence: float = LEAST_CONFIDENCE,
           most_tokens: int = MOST_TOKENS) -> DataFrame:
    """page_id, host, path, rule, verdict and mined_rule of each page."""
    scratch = Scratch(pages.sparkSession, "urls")
    url = F.coalesce(field("url").cast("string"), F.lit(""))
    split = lambda df: df.select("*", *[c.alias(name) for name, c in parsed(F.col("url")).items()]).withColumn("listed", listed_rule(rules))
    urls = split(pages.select(url.alias("url")).distinct()).select("url", F.col("listed.verdict").alias("verdict"), tokens().alias("tokens"))
    urls = scratch.keep(urls)
    learned = mined(urls, scratch, one_in, least_confidence, most_tokens)
    found = scratch.keep(matched(urls.filter("verdict IS NULL"), learned))
    rows = split(pages.select(field("page_id").alias("page_id"), url.alias("url")))
    open_url = F.when(F.col("listed").isNull(), F.col("url"))
    out = rows.withColumn("open", open_url).join(found.withColumnRenamed("url", "open"), "open", "left")
    verdict = F.coalesce("listed.verdict", "mined_verdict", F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"), "mined_rule")
