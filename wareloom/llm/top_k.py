"""Exact search for the largest inner products by a pivot-distance index.

Vectors are turned into integers, floor(256 * x) per component. With M the largest norm, each vector x gets one more component
sqrt(M^2 - |x|^2) and each query q a zero; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the nearest vectors are those of largest inner product, and
the triangle inequality holds. Every vector is keyed by its nearest pivot and its distance to it, cut into annuli (rings) per pivot. A query
searches the annuli nearest to it first; the k-th score it finds there is a threshold, and of the other annuli, in the order of their bounds,
only those are searched whose bound |d(q, pivot) - d(x, pivot)| leaves room for a score that high. Nothing else can hold a better vector, so the
result is exact; scores themselves are integer products.

Pivots and annulus borders are fitted on at most ``SAMPLE`` vectors, chosen by a hash; all vectors are indexed. An annulus of many vectors is split
into blocks by a hash, and so are the queries that search it, so that a task holds at most about ``BLOCK`` of either, whatever the data.

Defined results: vectors that are null or hold a null or non-finite component take no part, neither as queries nor as candidates; vectors are compared
with those of equal length only; ties go to the smaller id, null ids last; repeated rows are candidates for each other, only the
query's own row is left out; an empty table gives no rows. Components must be small enough for scores to fit a bigint.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareloom.llm.tables import Scratch, field

SCALE = 256
TOP = 5
PIVOTS = 16
RINGS = 8  # annuli per pivot
SAMPLE = 4096
BLOCK = 4096
FIRST = 2  # annuli searched for the threshold
EXACT = 2.0**53  # up to here float64 sums of integers are exact


@dataclass
class Index:
    """Pivots (last component: the added one), the borders of their annuli, and the largest squared norm, per vector length."""

    pivots: dict[int, np.ndarray]
    borders: dict[int, np.ndarray]
    largest: dict[int, float]

    def keyed(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest pivot, distance to it and annulus of each vector."""
        n = codes.shape[1]
        norms = (codes**2).sum(axis=1)
        distance = self._distances(codes, norms, np.sqrt(np.maximum(self.largest[n] - norms, 0)))
        pivot = distance.argmin(axis=1)
        own = distance[np.arange(len(codes)), pivot]
        ring = (own[:, None] > self.borders[n][pivot]).sum(axis=1)
        return pivot, own, ring

    def query_distances(self, codes: np.ndarray) -> np.ndarray:
        return self._distances(codes, (codes**2).sum(axis=1), np.zeros(len(codes)))

    def _distances(self, codes: np.ndarray, norms: np.ndarray, added: np.ndarray) -> np.ndarray:
        pivots = self.pivots[codes.shape[1]]
        squared = (norms + added**2)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * (codes @ pivots[:, :-1].T + added[:, None] * pivots[None, :, -1])
        return np.sqrt(np.maximum(squared, 0))


def spread_out(points: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: each next one is the farthest from those chosen."""
    chosen = [0]
    away = np.full(len(points), np.inf)
    while len(chosen) < min(count, len(points)):
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(away.argmax()))
    return points[chosen]


def fit(vectors: DataFrame) -> Index:
    """vectors(row, codes). Collects the largest norm per vector length and at most SAMPLE vectors of each."""
    norm = F.aggregate("codes", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c)
    largest = {r.n: r.m for r in vectors.groupBy(F.size("codes").alias("n")).agg(F.max(norm).alias("m")).collect()}  # one row per vector length
    index = Index({}, {}, {n: m * (1 + 1e-9) + 1 for n, m in largest.items()})
    for n in largest:
        rows = vectors.filter(F.size("codes") == n).orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("codes").collect()
        codes = np.array([r.codes for r in rows], np.float64).reshape(len(rows), n)
        norms = (codes**2).sum(axis=1)
        index.pivots[n] = spread_out(np.column_stack([codes, np.sqrt(np.maximum(index.largest[n] - norms, 0))]), PIVOTS)
        index.borders[n] = np.full((len(index.pivots[n]), RINGS - 1), np.inf)
        pivot, own, _ = index.keyed(codes)
        for p in range(len(index.pivots[n])):
            if (pivot == p).any():
                index.borders[n][p] = np.quantile(own[pivot == p], np.arange(1, RINGS) / RINGS)
    return index


def best_of_block(data: pd.DataFrame, asked: pd.DataFrame, top: int) -> pd.DataFrame:
    """The best of one block of vectors for each of one block of queries."""
    out = {"query": [], "query_id": [], "vec_id": [], "missing": [], "score": []}
    if len(data) and len(asked):
        x, q = np.stack(data["codes"].to_numpy()), np.stack(asked["q_codes"].to_numpy())
        if x.shape[1] and float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] < EXACT:
            scores = (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
        else:
            scores = q.astype(np.int64) @ x.astype(np.int64).T
        rows, missing = data["row"].to_numpy(), data["vec_id"].isna().to_numpy()
        ids = data["vec_id"].fillna(0).to_numpy(np.int64)
        by_id = np.lexsort((ids, missing))  # ties: smaller ids first, null ids last
        scores, rows, ids, missing = scores[:, by_id], rows[by_id], ids[by_id], missing[by_id]
        least = np.iinfo(np.int64).min
        for i, (own, query_id) in enumerate(zip(asked["q_row"], asked["query_id"])):
            line = np.where(rows == own, least, scores[i])
            if len(line) > 4 * top:  # all that can be among the best, ties included
                near = np.nonzero(line >= np.partition(line, len(line) - top)[len(line) - top])[0]
            else:
                near = np.arange(len(line))
            best = near[np.argsort(-line[near], kind="stable")][:top]
            for j in best:
                if rows[j] != own:
                    for name, value in (("query", own), ("query_id", query_id), ("vec_id", ids[j]), ("missing", missing[j]), ("score", line[j])):
                        out[name].append(value)
    frame = pd.DataFrame(out)
    return frame.astype({"query": "int64", "query_id": "int64", "vec_id": "int64", "missing": "bool", "score": "int64"})


def search(keyed: DataFrame, visits: DataFrame, top: int) -> DataFrame:
    """keyed(n, pivot, ring, block, ...), visits(n, pivot, ring, row, query_id, codes) -> the best of each query per block."""
    group = ["n", "pivot", "ring", "block", "part"]
    blocks = keyed.select("n", "pivot", "ring", "block").distinct()
    parts = visits.groupBy("n", "pivot", "ring").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    asked = (visits.join(parts, ["n", "pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
             .join(blocks, ["n", "pivot", "ring"]).select(*[F.col(c).alias(f"q_{c}") for c in (*group, "row", "codes")], "query_id"))
    data = keyed.join(parts, ["n", "pivot", "ring"]).select("n", "pivot", "ring", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "row", "vec_id", "codes")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return best_of_block(left, right, top)

    return data.groupBy(*group).cogroup(asked.groupBy(*[f"q_{c}" for c in group])).applyInPandas(run, "query bigint, query_id bigint, vec_id bigint, missing boolean, score bigint")


def ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "missing", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def quantised(embeddings: DataFrame) -> DataFrame:
    """row, vec_id and integer codes of the vectors that take part."""
    wide = F.transform(field("embedding"), lambda c: c.cast("double"))
    plain = embeddings.select(field("vec_id").cast("bigint").alias("vec_id"), wide.alias("x")).withColumn("row", F.monotonically_increasing_id())
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return plain.filter(F.col("x").isNotNull() & finite).select("row", "vec_id", F.transform("x", lambda c: F.floor(SCALE * c)).alias("codes"))


def nearest(embeddings: DataFrame, is_query: Column, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id and score: the ``top`` best of all other rows for each row that ``is_query`` (over ``vec_id``) picks."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "topk")
    vectors = scratch.keep(quantised(embeddings))
    shared = spark.sparkContext.broadcast(fit(vectors))  # PIVOTS vectors and their borders

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, part in pdf.groupby(pdf["codes"].map(len)):
                pivot, own, ring = shared.value.keyed(np.stack(part["codes"].to_numpy()).astype(np.float64))
                yield pd.DataFrame({"row": part["row"], "vec_id": part["vec_id"].astype("Int64"), "codes": part["codes"], "n": n, "pivot": pivot, "ring": ring, "distance": own})

    placed = scratch.keep(vectors.mapInPandas(key, "row bigint, vec_id bigint, codes array<bigint>, n int, pivot int, ring int, distance double"))
    rings = placed.groupBy("n", "pivot", "ring").agg(F.min("distance").alias("near"), F.max("distance").alias("far"), F.count("*").alias("size"))
    known = spark.sparkContext.broadcast([tuple(r) for r in rings.collect()])  # at most PIVOTS * RINGS rows per vector length
    sizes = F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")
    keyed = placed.join(F.broadcast(rings.select("n", "pivot", "ring", sizes)), ["n", "pivot", "ring"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All annuli of each query, nearest first, with the highest score that each may hold."""
        for pdf in batches:
            for n, part in pdf.groupby("n"):
                index, own = shared.value, sorted(r for r in known.value if r[0] == n)
                codes = np.stack(part["codes"].to_numpy()).astype(np.float64)
                away = index.query_distances(codes)[:, [r[1] for r in own]]
                least = np.maximum(0, np.maximum(np.array([r[3] for r in own]) - away, away - np.array([r[4] for r in own])))
                least = np.maximum(0, least - 1e-6 * (1 + away))  # rounding
                most = ((codes**2).sum(axis=1)[:, None] + index.largest[n] - least**2) / 2
                order = np.argsort(least, axis=1, kind="stable")
                listed = [[{"pivot": own[j][1], "ring": own[j][2], "most": most[i, j]} for j in order[i]] for i in range(len(part))]
                yield pd.DataFrame({"row": part["row"], "rings": listed})

    queries = placed.filter(is_query)
    ordered = scratch.keep(queries.mapInPandas(bounds, "row bigint, rings array<struct<pivot:int,ring:int,most:double>>"))
    asked = queries.select("row", "n", F.col("vec_id").alias("query_id"), "codes")

    def visits(rings_of: DataFrame) -> DataFrame:
        return asked.join(rings_of, "row").select("n", "ring.pivot", "ring.ring", "row", "query_id", "codes")

    first = visits(ordered.select("row", F.explode(F.slice("rings", 1, FIRST)).alias("ring")))
    early = scratch.keep(ranked(search(keyed, first, top), top).drop("rank"))
    # With fewer than ``top`` found there is no threshold yet.
    threshold = early.groupBy(F.col("query").alias("row")).agg(F.when(F.count("*") >= top, F.min("score")).alias("threshold"))
    rest = ordered.join(threshold, "row", "left").select("row", "threshold", F.explode(F.expr(f"slice(rings, {FIRST + 1}, size(rings))")).alias("ring"))
    open_ = rest.filter(F.col("threshold").isNull() | (F.col("ring")["most"] + 1 >= F.col("threshold"))).select("row", "ring")
    late = search(keyed, visits(open_), top)
    best = ranked(early.unionByName(late), top)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(~F.col("missing"), F.col("vec_id")).alias("vec_id"), "score")
