"""SimHash near-duplicates through covering locality-sensitive hashing.

Each bit position i gets a vector m(i) of ``RADIUS + 1`` bits. A table is a non-zero vector v; its mask keeps the bits i with an odd
<m(i), v>. The vectors of at most RADIUS differing bits span less than the whole space, so some v is orthogonal to all of them: the mask of
that v keeps none of the differing bits, and the two fingerprints fall into one bucket of its table. No pair within the radius is missed.

Buckets hold distinct fingerprints only. One with more than ``BUCKET`` of them is split again by the same construction over the bits that
its mask leaves free (64, at most 32, 16, 8), which again covers every pair; after the third split a bucket has at most 2 ** 8 fingerprints
by construction. Within a bucket the links found are reduced to a spanning forest, so a bucket of n gives fewer than n links.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links like any other; repeated rows share a
fingerprint and a component; rows with a null id get a component, but are never its name unless all its ids are null, which gives null; an
empty table gives no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from wareloom.llm.components import components
from wareloom.llm.tables import Scratch, field, whole_text

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
BUCKET = 256
LEVELS = 3
BATCH = 1000  # documents in Python at once
BLOCK = 1 << 16  # shingle hashes whose bits are in memory at once


def fingerprint(text: str) -> int:
    """Majority bits of the XXH64 of all shingles; signed, as Spark's bigint holds it."""
    words = text.encode().lower().split()  # bytes: A-Z only, and exactly the blanks x20 and x09-x0D
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


@cache
def masks(free: int = (1 << BITS) - 1, dimensions: int = RADIUS + 1) -> tuple[int, ...]:
    """The covering masks over the free bits; fixed bits stay kept."""
    positions = [i for i in range(BITS) if free >> i & 1]
    vectors = {p: k % ((1 << dimensions) - 1) + 1 for k, p in enumerate(positions)}
    fixed = ~free & ((1 << BITS) - 1)
    return tuple(fixed | sum(1 << p for p in positions if (vectors[p] & v).bit_count() % 2) for v in range(1, 1 << dimensions))


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


@cache
def submasks(level: int) -> tuple[tuple[int, int], ...]:
    """(mask, finer mask) from one level to the next."""
    whole = (1 << BITS) - 1
    above = (0,) if level == 0 else tuple(dict.fromkeys(m for _, m in submasks(level - 1)))
    return tuple((mask, finer) for mask in above for finer in masks(~mask & whole))


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links (fingerprint, root) that join what is within the radius, one fewer than there are members."""
    bits = fps.view(np.uint64)  # of signed numbers numpy would count the bits of the absolute value
    if len(fps) == 2:
        return [(int(fps[0]), int(fps[1]))] if np.bitwise_count(bits[0] ^ bits[1]) <= RADIUS else []
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= RADIUS
    label = np.arange(len(fps))
    while True:
        lower = np.where(near, label[None, :], len(fps)).min(axis=1)
        lower = lower[lower]
        if (lower == label).all():
            return [(int(fps[i]), int(fps[r])) for i, r in enumerate(label) if i != r]
        label = lower


def bucket_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [link for members in pdf["members"] for link in forest(np.sort(np.asarray(members, np.int64)))]
        yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def links(fps: DataFrame, scratch: Scratch, bucket: int = BUCKET) -> DataFrame:
    """(a, b): a subset of the pairs of fingerprints within the radius that connects the same components as all of them."""
    spark = fps.sparkSession
    rows = fps.select(F.lit(0).cast("bigint").alias("mask"), "fp")
    found: list[DataFrame] = []
    for level in range(LEVELS):
        finer = spark.createDataFrame([(signed(a), signed(b)) for a, b in submasks(level)], "mask bigint, finer bigint")
        if level == 0:
            dealt = rows.select(F.explode(F.array(*[F.lit(signed(m)) for _, m in submasks(0)])).alias("mask"), "fp")
        else:
            dealt = rows.join(F.broadcast(finer), "mask").select(F.col("finer").alias("mask"), "fp")  # at most 15 ** 3 rows
        dealt = dealt.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = dealt.groupBy("mask", "part").agg(F.count("*").alias("n")).filter("n > 1")
        sized = scratch.keep(dealt.join(sizes, ["mask", "part"]))
        last = level == LEVELS - 1
        small = sized if last else sized.filter(F.col("n") <= bucket)
        members = small.groupBy("mask", "part").agg(F.collect_list("fp").alias("members")).select("members")
        found.append(members.mapInPandas(bucket_links, "a bigint, b bigint"))
        rows = sized.filter(F.col("n") > bucket).select("mask", "fp")
        if last or rows.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def clusters(rows: DataFrame, scratch: Scratch, first: Column) -> DataFrame:
    """(fp, first): each distinct fingerprint of ``rows(fp, ...)`` with the smallest ``first`` of its component."""
    fps = scratch.keep(rows.groupBy("fp").agg(F.min(first).alias("first")))
    roots = components(links(fps, scratch), scratch).select(F.col("node").alias("fp"), "root")
    rooted = scratch.keep(fps.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("lowest"))
    return scratch.keep(rooted.join(lowest, "root").select("fp", F.col("lowest").alias("first")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of each row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(docs.select(field("doc_id").cast("bigint").alias("doc_id"), fingerprints(whole_text()).alias("fp")), BATCH)
    named = clusters(rows, scratch, F.col("doc_id"))
    return rows.join(named, "fp").select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), F.col("first").alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the smallest id (null ids last), of repeated ids the first read."""
    scratch = Scratch(docs.sparkSession, "dedup")
    rows = scratch.keep(docs.select(F.struct("*").alias("doc"), fingerprints(whole_text()).alias("fp"), F.monotonically_increasing_id().alias("row")), BATCH)
    doc_id = F.col("doc")["doc_id"].cast("bigint")
    keys = rows.select("fp", F.struct(doc_id.isNull().alias("last"), doc_id.alias("id"), "row").alias("first"))
    winners = clusters(keys, scratch, F.col("first")).select(F.col("first")["row"].alias("row")).distinct()
    return rows.join(winners, "row", "left_semi").select("doc.*")
