"""Numbering rows within groups without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareloom.llm.tables import field, whole_text


def row_key() -> Column:
    """A hexadecimal key of a document row that spreads ids, null ids and copies evenly: equal only for equal (doc_id, text)."""
    return F.md5(F.concat_ws(":", F.coalesce(field("doc_id").cast("string"), F.lit("")), F.md5(whole_text())))


def numbered(rows: DataFrame, group: str, key: str, ties: list[str], name: str = "ordinal") -> DataFrame:
    """Add a gapless 0-based number within ``group``, in the order of the hexadecimal ``key`` and ``ties``.

    The first three digits of the key are 4,096 buckets. Rows are ordered within (group, bucket); the bucket's offset comes from the bucket
    counts, which combine before the shuffle and are 4,096 per group at most.
    """
    dealt = rows.withColumn("_bucket", F.substring(key, 1, 3))
    counts = dealt.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select(group, "_bucket", (F.sum("_n").over(upto) - F.col("_n")).alias("_offset"))
    within = Window.partitionBy(group, "_bucket").orderBy(key, *ties)
    placed = dealt.withColumn("_rank", F.row_number().over(within) - 1)
    return placed.join(offsets, [group, "_bucket"]).withColumn(name, F.col("_offset") + F.col("_rank")).drop("_bucket", "_rank", "_offset")
