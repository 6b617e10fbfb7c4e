"""Shards of nearly equal size in which equal texts stay together. DataFrame functions only.

Texts are ordered by their SHA-256; the rows of one text are an atomic group. The smallest shard capacity for which greedy filling needs no more
than the wanted shards is found by binary search, and the greedy cuts at that capacity are the shards' borders (minimax contiguous partition).

The search needs no list of all groups. It starts from the sums of 4,096 key prefixes. Taking a prefix as freely divisible gives a capacity
that is not too large, taking it as one block one that is not too small; only prefixes in which a greedy cut can fall between the two are
summed again by three digits more. The driver sees a few thousand sums per round, whatever the size of the corpus, and rows are
placed by comparing their key with the borders.

Defined results: a null text counts as empty and is in one group with empty texts; size is its UTF-8 bytes plus 1; repeated rows get slots of
their own; with fewer groups than shards some shards stay empty; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareloom.llm.ordinals import numbered, row_key
from wareloom.llm.tables import Scratch, field, whole_text

SHARDS = 8
DIGITS = 3  # of the key, by which a prefix is split further
REFINED = 64  # prefixes split further in one round; the next round goes on

# prefix, sum of sizes, whether it is known to be one group
Segment = tuple[str, int, bool]


def _greedy(sums: list[int], atomic: list[bool], capacity: int, divisible: bool) -> list[int] | None:
    """Ends of greedily filled shards, the last one the total; None if a block is larger than the capacity."""
    total, at, ends = sums[-1], 0, []
    while at < total:
        goal = at + capacity
        k = bisect_right(sums, goal) - 1
        end = goal if divisible and goal < total and not atomic[k] else sums[k]
        if end <= at:
            return None
        ends.append(min(end, total))
        at = ends[-1]
    return ends


def _smallest(segments: list[Segment], shards: int, divisible: bool) -> int:
    sums, atomic = [0, *accumulate(s for _, s, _ in segments)], [a for _, _, a in segments]
    low, high = -(-sums[-1] // shards), sums[-1]
    while low < high:
        middle = (low + high) // 2
        ends = _greedy(sums, atomic, middle, divisible)
        low, high = (low, middle) if ends is not None and len(ends) <= shards else (middle + 1, high)
    return low


def _undecided(segments: list[Segment], shards: int) -> list[str]:
    """Prefixes of several groups in which a greedy cut may fall for a capacity between the two estimates."""
    sums, atomic = [0, *accumulate(s for _, s, _ in segments)], [a for _, _, a in segments]
    least, most = _smallest(segments, shards, True), _smallest(segments, shards, False)
    # A cut at any capacity in between lies right of that of whole blocks at the least one and left of that of divisible blocks at the most.
    left, right, found = 0, 0, set()
    for _ in range(shards - 1):
        left = sums[bisect_right(sums, left + least) - 1]
        right = min(sums[-1], right + most)
        at = bisect_right(sums, left) - 1
        while at < len(segments) and sums[at] < right and len(found) < REFINED:
            if not atomic[at]:
                found.add(segments[at][0])
            at += 1
    return sorted(found)


def borders(rows: DataFrame, shards: int = SHARDS) -> list[str]:
    """First key (or prefix) of shards 1, 2, ... over ``rows(group, size)``."""

    def sums(of: DataFrame, digits: int) -> list[Segment]:
        per = of.groupBy(F.substring("group", 1, digits).alias("prefix")).agg(F.sum("size").alias("total"), (F.min("group") == F.max("group")).alias("one"))
        return [(r.prefix, r.total, r.one) for r in per.orderBy("prefix").collect()]  # 16 ** DIGITS rows for each prefix asked for

    segments = sums(rows, DIGITS)
    while segments and (open_ := _undecided(segments, shards)):
        wanted = {p: [] for p in open_}
        for digits in {len(p) for p in open_}:
            same = [p for p in open_ if len(p) == digits]
            for s in sums(rows.filter(F.substring("group", 1, digits).isin(same)), digits + DIGITS):
                wanted[s[0][:digits]].append(s)
        segments = [part for s in segments for part in (wanted[s[0]] if s[0] in wanted else [s])]
    if not segments:
        return []
    capacity = _smallest(segments, shards, False)
    cumulative = [0, *accumulate(s for _, s, _ in segments)]
    ends = _greedy(cumulative, [True] * len(segments), capacity, False)
    return [segments[bisect_right(cumulative, end) - 1][0] for end in ends[:-1]]


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and the row's gapless slot in its shard."""
    text = whole_text()
    rows = Scratch(docs.sparkSession, "shards").keep(docs.select(
        field("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("group"), row_key().alias("key")))
    shard = F.lit(0)
    for first in borders(rows, shards):
        shard = shard + (F.col("group") >= first).cast("int")
    return numbered(rows.withColumn("shard", shard), "shard", "key", ["doc_id"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
