import itertools
import random

import pytest

from wareloom.operators import names as nm

SCHEMA = "product_id int, candidates array<string>, keywords array<string>, refined_name string, brand_name string, original_name string"


def run(spark, cases):
    rows = [(i, *c) for i, c in enumerate(cases)]
    got = {r.product_id: (r.product_name, r.from_candidate) for r in nm.select_names(spark.createDataFrame(rows, SCHEMA)).collect()}
    return [got[i] for i in range(len(cases))]


def test_generated_names(spark):
    cases = [
        ([], ["작업 발판", "발판 사다리"], "무시", None, None), ([], ["발판 사다리", "작업 발판"], "무시", None, None), ([], ["Pro pro PRO ladder"], "무시", None, None),
        ([], ["Acme 작업 발판", "작업 발판", "발판"], "Acme 접이식 발판", "ACME", None), ([], [], "ACME", "acme", "ACME 원본 사다리"), ([], [], "ACME", "acme", "ACME"),
        ([], [], "x" * 51, None, "원본 사다리"), ([], None, None, None, None)]
    assert [n for n, _ in run(spark, cases)] == ["작업 발판 사다리", "작업 발판 사다리", "Pro pro ladder", "작업 발판", "원본 사다리", "", "원본 사다리", ""]


def test_candidate_choice(spark):
    keywords = ["작업 발판", "발판 사다리"]
    cases = [
        (["발판 사다리 접이식 작업", "작업 발판 사다리 접이식", "접이식 작업 발판 사다리"], ["작업 발판", "발판 사다리", "접이식"], "접이식 작업 발판 사다리", None, None),
        (["작업 발판 초경량", "ACME 작업 발판", "작업! 발판 사다리", "작업 발판 사다리"], keywords, "작업 발판 사다리", "acme", None),
        (["작업 " + "발판" * 25, "작업 작업 작업 발판"], keywords, "작업 발판 사다리", None, None),
        (["작업 접이식", "발판 접이식", "사다리 작업"], keywords, "접이식 작업 발판 사다리", None, None)]
    assert run(spark, cases) == [("작업 발판 사다리 접이식", True), ("작업 발판 사다리", True), ("작업 발판 사다리", False), ("작업 발판 사다리", False)]


def fits(t):
    low = [x.lower() for x in t]
    return bool(t) and len(t) <= 9 and len(" ".join(t)) <= 50 and all(low.count(x) <= 2 for x in low)


def brute_chain(keywords):
    """Plain greedy chain over token lists, for comparison on small inputs."""
    kept = []
    for k in keywords:
        k = k.split()
        k = [w for i, w in enumerate(k) if k[:i].count(w) < 2]
        if k and not any(k == p[i:i + len(k)] for p in kept for i in range(len(p))):
            kept.append(k)
    start = next((i for i, k in enumerate(kept) if fits(k)), None)
    if start is None:
        return ""
    chain, rest = kept[start], kept[:start] + kept[start + 1:]
    while rest:
        options = []
        for i, k in enumerate(rest):
            tail = next((n for n in range(min(len(chain), len(k)), 0, -1) if chain[-n:] == k[:n]), 0)
            head = next((n for n in range(min(len(chain), len(k)), 0, -1) if k[-n:] == chain[:n]), 0)
            options += [(n, kind, -i, joined) for n, kind, joined in ((tail, 1, chain + k[tail:]), (head, 0, k[:len(k) - head] + chain)) if n and fits(joined)]
        if options:
            best = max(options, key=lambda o: o[:3])
            chain = best[3]
            rest.pop(-best[2])
        else:
            whole = chain + rest.pop(0)
            chain = whole if fits(whole) else chain
    return " ".join(chain)


def test_chain_equals_brute_force(spark):
    rnd = random.Random(7)
    words = ["a", "b", "c", "dd", "eeeeeeeeeeeeeeee", "ffffffffffffffff"]
    cases = [[" ".join(rnd.choices(words, k=rnd.randint(1, 4))) for _ in range(rnd.randint(1, 6))] for _ in range(120)]
    got = run(spark, [([], ks, "zzz", None, None) for ks in cases])
    assert [n for n, _ in got] == [brute_chain(ks) or "zzz" for ks in cases]


def test_rows_are_dealt_and_patterns_run_once(spark):
    one_file = spark.range(50).coalesce(1).selectExpr(
        "int(id) AS product_id", "array('zzz', 'work board') AS candidates", "array('work board') AS keywords", "'work board' AS refined_name", "'acme' AS brand_name", "'x' AS original_name")
    chosen = nm.select_names(one_file)
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition 4, true") == 2  # before scoring, before generating
    assert plan.count("regexp_replace") <= 10  # one per text: as often as they are written, not once per test on their result
    assert {(r.product_name, r.from_candidate) for r in chosen.collect()} == {("work board", True)}
