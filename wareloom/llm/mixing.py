"""Mixing sources to target weights by Pfair scheduling.

Sources are grouped into classes: each source named in the weights is one, all others, and null, are the class ``other``. With integer weights
w and their sum W, a class's block number i may run from its release floor(i * W / w) and must run before its deadline
ceil((i + 1) * W / w). Earliest deadline first over released blocks meets all deadlines, and windows of this form keep each class less than one
block away from its target share at every slot. The windows repeat every W slots, so one period, whose size is a parameter and not that of
the data, is scheduled on the driver; a block's slot follows from its number by arithmetic.

A class that has run out leaves its slots empty, and the others keep their pace. No document is left out or repeated.

Defined results: null texts and ids take part as any other; repeated rows get places of their own; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareloom.llm.ordinals import numbered, row_key
from wareloom.llm.tables import field

OTHER = "other"
BLOCK = 32  # documents
LARGEST_PERIOD = 100_000
WEIGHTS = {"src0": 5, **{f"src{i}": 2 for i in range(1, 5)}, **{f"src{i}": 1 for i in range(5, 20)}, OTHER: 1}


def period(weights: dict[str, int]) -> list[tuple[str, int, int]]:
    """(class, number within the period, slot) for each slot of one period."""
    total = sum(weights.values())
    if total > LARGEST_PERIOD or min(weights.values()) < 1:
        raise ValueError(f"weights must be positive and sum to {LARGEST_PERIOD} at most")
    waiting = [(0, rank, name, 0) for rank, name in enumerate(weights)]  # release, rank, class, number
    ready: list[tuple[int, int, str, int]] = []  # deadline first
    out = []
    heapq.heapify(waiting)
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, rank, name, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // weights[name]), rank, name, k))
        _, rank, name, k = heapq.heappop(ready)
        out.append((name, k, slot))
        if k + 1 < weights[name]:
            heapq.heappush(waiting, ((k + 1) * total // weights[name], rank, name, k + 1))
    return out


def source_class(weights: dict[str, int]) -> Column:
    source = field("source").cast("string")
    return F.when(source.isin([w for w in weights if w != OTHER]), source).otherwise(F.lit(OTHER))


def schedule(docs: DataFrame, weights: dict[str, int] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """``docs`` as struct ``doc`` with class, block, place in the block, release, deadline and slot."""
    weights = weights if OTHER in weights else {**weights, OTHER: 1}
    total = sum(weights.values())
    spark = docs.sparkSession
    rows = docs.select(source_class(weights).alias("class"), row_key().alias("key"), F.struct("*").alias("doc"))
    placed = numbered(rows, "class", "key", []).withColumn("block", F.expr(f"ordinal div {block}"))
    # One row per slot of a period: bounded by LARGEST_PERIOD.
    turns = spark.createDataFrame([(n, k, s, weights[n]) for n, k, s in period(weights)], "class string, turn bigint, slot0 bigint, weight bigint")
    share = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    timed = placed.withColumn("turn", F.col("block") % share[F.col("class")]).join(F.broadcast(turns), ["class", "turn"])
    return timed.select(
        "doc", "class", "block", (F.col("ordinal") % block).alias("place"),
        F.expr(f"block * {total} div weight").alias("release"),
        F.expr(f"((block + 1) * {total} + weight - 1) div weight").alias("deadline"),
        F.expr(f"(block div weight) * {total} + slot0").alias("slot"))


def mixed(docs: DataFrame, weights: dict[str, int] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """The input rows in the order of the schedule: ranges of slots follow each other from partition to partition."""
    timed = schedule(docs, weights, block)
    return timed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("doc.*")


def placed(stored: DataFrame, name: str = "position") -> DataFrame:
    """``stored``, a table that was written from :func:`mixed`, with each row's place in the order it was written in: increasing, not gapless.

    Files are packed by size when they are read, so the place comes from the number of the file (of the task, then of the task's file) and
    the row's number in it. Rows that come from no files are placed as they stand.
    """
    file, row = field("_metadata")["file_name"], field("_metadata")["row_index"]
    number = lambda pattern: F.coalesce(F.regexp_extract(file, pattern, 1).try_cast("bigint"), F.lit(0))
    try:
        at = stored.withColumn(name, F.struct(number("^part-(\\d+)").alias("task"), number("-c(\\d+)[.]").alias("file"), row.alias("row")))
    except AnalysisException:
        at = stored.withColumn(name, F.struct(F.lit(0).cast("bigint").alias("task"), F.lit(0).cast("bigint").alias("file"), F.monotonically_increasing_id().alias("row")))
    return at
