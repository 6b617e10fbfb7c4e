import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from wareloom.llm import url_rules

SCHEMA = "page_id long, url string, host string, `open` string, verdict string, `a.b` int"


def split(url):
    rest = (url or "").partition("://")[2]
    host, path, query = re.match(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?", rest).groups()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path, query or ""


def listed(host, path, rules=url_rules.LISTED):
    fits = [(len(r), r, v) for v, r in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return max(fits)[1:] if fits else (None, None)


def tokens_of(host, path, query):
    labels = [x for x in host.split(".") if x]
    out = {"host:" + ".".join(labels[i:]) for i in range(len(labels))} | {"word:" + w for x in labels if "-" in x for w in x.split("-")}
    out |= {"segment:" + re.sub("[0-9]+", "#", x) for x in path.split("/") if x} | {"key:" + x.partition("=")[0] for x in query.split("&") if x}
    return out | {"extension:" + m.lower() for m in re.findall(r"\.([A-Za-z0-9]+)\Z", path)}


def brute_force(urls, one_in=url_rules.ONE_IN):
    parsed = {u: split(u) for u in urls}
    labelled = {u: listed(*p[:2])[1] for u, p in parsed.items() if listed(*p[:2])[1]}
    alone, both = Counter(), Counter()
    for u, verdict in labelled.items():
        for size in (1, 2, 3):
            for part in combinations(sorted(tokens_of(*parsed[u])), size):
                alone[part] += 1
                both[part, verdict] += 1
    least = max(url_rules.LEAST_URLS, -(-len(labelled) // one_in))
    rules = {k: n for k, n in both.items() if n >= least and n / alone[k[0]] >= url_rules.LEAST_CONFIDENCE}
    sure = lambda k: rules[k] / alone[k[0]]
    kept = [k for k in rules if not any(set(o[0]) < set(k[0]) and o[1] == k[1] and sure(o) >= sure(k) for o in rules)]
    out = {}
    for u, (host, path, query) in parsed.items():
        rule, verdict = listed(host, path)
        mined = None
        if not rule:
            fits = [(-sure(k), -rules[k], len(k[0]), " ".join(k[0]), k[1]) for k in kept if set(k[0]) <= tokens_of(host, path, query)]
            mined, verdict = min(fits)[3:] if fits else (None, "allow")
        out[u] = (host, path, rule, verdict, mined)
    return out


def random_urls(n, seed):
    rng = random.Random(seed)
    names = ["example.com", "www.example.com", "a.www.example.com", "shop-online.example.com", "x.com", "b.example.net", "c.net", "d.org", "Free-Bets.org", "e.org:8080", "notcom"]
    return [f"{rng.choice(['http', 'https'])}://{rng.choice(names)}{rng.choice(['/en/', '/en', '/es/', '/fr/', '/de/', '', '/', '/EN/'])}{rng.choice(['', f'{rng.randint(1, 999)}', f'a{rng.randint(1, 9)}.html', 'x/y.PDF'])}"
            f"{rng.choice(['', '#top', '?page=2&ref=x', '?utm=1#a/b', '?q=://z'])}" for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    urls = random_urls(1500, seed) + ["no scheme", "", "://", "http:///en/", "a://b://c.com/en/"]
    rows = [(i, u, "h", "o", "v", 1) for i, u in enumerate(urls)]
    got = url_rules.judged(spark.createDataFrame(rows, SCHEMA).repartition(4), one_in=40).collect()
    want = brute_force(set(urls), one_in=40)
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict, r.mined_rule) == want[urls[r.page_id]], urls[r.page_id]
    assert {r.verdict for r in got if r.mined_rule} == {"allow", "block"} and any(" " in (r.mined_rule or "") for r in got)


def test_copies_do_not_outvote(spark):
    urls = random_urls(300, 4)
    whole = {r.url: r.verdict for r in judged_by_url(spark, urls)}
    copied = {r.url: r.verdict for r in judged_by_url(spark, urls + [urls[0]] * 2000)}
    assert whole == copied


def judged_by_url(spark, urls):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    return url_rules.judged(rows, one_in=20).join(rows, "page_id").collect()


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert url_rules.judged(empty).collect() == []
    rows = [(1, None, "h", None, "v", 1), (None, None, "h", None, "v", 1), (2, "http://long.org/" + "a/" * 30000, None, None, None, None), (2, "http://x.com/", None, None, None, None), (2, "http://x.com/", None, None, None, None)]
    got = url_rules.judged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.page_id, r.host, r.rule, r.verdict) for r in got) == {
        (1, "", None, "allow"): 1, (None, "", None, "allow"): 1, (2, "long.org", None, "allow"): 1, (2, "x.com", "com/", "allow"): 2}


def test_other_lists(spark):
    rows = spark.createDataFrame([(1, "http://a.b/c/d"), (2, "http://a.b/x")], "page_id long, url string")
    got = url_rules.judged(rows, rules=(("block", "b/"), ("allow", "a.b/c/"))).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [("a.b/c/", "allow"), ("b/", "block")]
    assert rows.select(url_rules.parsed(F.col("url"))["host"].alias("h")).distinct().count() == 1
