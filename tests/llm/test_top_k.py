import numpy as np
from pyspark.sql import functions as F

from wareloom.llm import top_k


def brute(rows, top):
    by = {}
    for i, (v, x) in enumerate(rows):
        if x is not None and all(c is not None and np.isfinite(c) for c in x):
            by.setdefault(len(x), []).append((i, v, np.floor(256 * np.array(x, np.float32).astype(np.float64)).astype(np.int64)))
    out = []
    for members in by.values():
        for i, v, c in members:
            if v is not None and v % 50 == 0:
                order = sorted((-int(c @ d), w is None, w or 0) for j, w, d in members if j != i)[:top]
                out += [(v, k + 1, None if m else w, -s) for k, (s, m, w) in enumerate(order)]
    return sorted(out, key=str)


def test_equals_brute_force_with_ties_copies_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK", 64)
    monkeypatch.setattr(top_k, "PIVOTS", 5)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in np.float32(centres[i % 6] + rng.normal(scale=0.1, size=8))]) for i in range(500)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [rows[50], rows[50]]
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")]), (2150, [float("inf"), 1.0]), (2200, [1.0, 2.0]), (None, [1.0, 2.0]), (2201, [1.0, 2.0]),
             (2250, []), (2300, [3.0, 4.0, 5.0]), (2350, [1e8, -1e8, 1.0, 1.0]), (2351, [1e8, 1e8, 1.0, 1.0])]
    docs = spark.createDataFrame([(v, x, 7, "r") for v, x in rows], "vec_id long, embedding array<float>, score int, row string")
    got = [tuple(r) for r in top_k.nearest(docs, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got, key=str) == brute(rows, 5)


def test_empty_table(spark):
    assert top_k.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect() == []
