import random
from collections import Counter

import numpy as np
import xxhash

from wareloom.llm import simhash
from wareloom.llm.components import components
from wareloom.llm.tables import Scratch


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(fingerprints):
    """Index of the first fingerprint of each one's component."""
    values = list(fingerprints)
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return {v: find(i) for i, v in enumerate(values)}


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(1)
    for free in ((1 << 64) - 1, 0x0F0F0F0F0F0F0F0F, 0xFF):
        bits = [i for i in range(64) if free >> i & 1]
        for _ in range(2000):
            difference = sum(1 << b for b in rng.sample(bits, 3))
            assert any(not difference & mask for mask in simhash.masks(free))
    assert all(((1 << 64) - 1 & ~m).bit_count() <= 8 for _, m in simhash.submasks(2))


def test_components_equal_brute_force(spark, odd_docs, odd_rows, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    prints = {plain_fingerprint(r[1]) for r in odd_rows}
    component = reachable(sorted(prints))
    smallest = {}
    for r in odd_rows:
        if r[0] is not None:
            c = component[plain_fingerprint(r[1])]
            smallest[c] = min(smallest.get(c, r[0]), r[0])
    want = Counter((r[0], f"{plain_fingerprint(r[1]):016x}", smallest.get(component[plain_fingerprint(r[1])])) for r in odd_rows)
    assert Counter(tuple(r) for r in got) == want
    assert simhash.near_duplicates(no_docs).collect() == []


def test_hot_buckets_are_split_and_lose_no_link(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(500)} | {rng.getrandbits(64) for _ in range(200)}
    fps = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp bigint")
    for bucket in (2, 20, 256):
        scratch = Scratch(spark, "test")
        roots = {r.node: r.root for r in components(simhash.links(fps, scratch, bucket), scratch).collect()}
        groups = Counter(roots.get(simhash.signed(v), simhash.signed(v)) for v in values)
        assert sorted(groups.values()) == sorted(Counter(reachable(sorted(values)).values()).values())


def test_forest_has_fewer_links_than_members():
    members = np.array([simhash.signed(v) for v in (0, 1, 3, 7, 15, 1 << 63)], np.int64)
    links = simhash.forest(np.sort(members))
    assert len(links) == 5


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    out = components(spark.createDataFrame([*chain, *star, (5, 5)], "a bigint, b bigint"), Scratch(spark, "test")).collect()
    assert Counter(Counter(r.root for r in out).values()) == {61: 1, 200: 1}


def test_one_row_of_each_component_stays(odd_docs, odd_rows, no_docs):
    kept = [tuple(r) for r in simhash.deduplicated(odd_docs).collect()]
    component = reachable(sorted({plain_fingerprint(r[1]) for r in odd_rows}))
    best = {}
    for r in odd_rows:
        c = component[plain_fingerprint(r[1])]
        best[c] = min(best.get(c, r), r, key=lambda x: (x[0] is None, x[0] or 0))
    assert Counter(kept) == Counter(best.values())
    assert simhash.deduplicated(no_docs).collect() == []
