import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from wareloom.llm import sharding


def greedy_cuts(sizes, capacity):
    cuts, filled = [], 0
    for i, size in enumerate(sizes):
        if filled + size > capacity:
            cuts.append(i)
            filled = 0
        filled += size
    return cuts


def minimax(sizes, shards):
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if len(greedy_cuts(sizes, middle)) < shards else (middle + 1, high)
    return greedy_cuts(sizes, low)


@pytest.mark.parametrize("hot", [False, True])
def test_borders_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(sharding, "DIGITS", 1)
    rng = random.Random(6)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 90))) for _ in range(400)] + (["the copied text"] * 900 if hot else [])
    rows = sharding.sharded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    groups = defaultdict(int)
    for t in texts:
        groups[hashlib.sha256(t.encode()).hexdigest()] += len(t.encode()) + 1
    keys = sorted(groups)
    cuts = minimax([groups[k] for k in keys], 8)
    shard_of = {k: sum(i >= c for c in cuts) for i, k in enumerate(keys)}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.shard) == (len(raw) + 1, zlib.crc32(raw), shard_of[hashlib.sha256(raw).hexdigest()])
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_rows(odd_docs, odd_rows, no_docs):
    rows = sharding.sharded(odd_docs).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((row[0], len((row[1] or "").encode()) + 1) for row in odd_rows)
    assert len({r.shard for r in rows if r.size == 1}) == 1  # null and empty texts are one group
    assert sharding.sharded(no_docs).collect() == []


def test_fewer_groups_than_shards(spark):
    rows = sharding.sharded(spark.createDataFrame([(i, "ab"[i % 2]) for i in range(6)], "doc_id long, text string")).collect()
    assert Counter(r.shard for r in rows) == {0: 3, 1: 3}
