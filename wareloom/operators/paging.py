"""Pages of long lists without sorting the list for each of them.

A list is sorted once: dealt by key ranges over many tasks and written, each range in a folder of its own, with a table of the ranges' last keys and row
counts. A page is named by the last key of the page before it (its cursor), not by an offset. It reads the range that the cursor
lies in and the next ones until they hold a page, so page 10,000 reads as much as page 1. Keys must tell rows apart (end with an id). Nulls
come first in ascending and last in descending order, as in Spark's sorts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType


def _order(keys: Mapping[str, bool]) -> list[Column]:
    return [F.col(k).desc_nulls_last() if down else F.col(k).asc_nulls_first() for k, down in keys.items()]


def beyond(keys: Mapping[str, bool], cursor: Mapping, prefix: str = "") -> Column:
    """Whether a row comes after the cursor in the order of the keys (name -> descending)."""
    test = F.lit(False)
    for k, down in reversed(keys.items()):
        column, value = F.col(prefix + k), cursor[k]
        if down:
            after = F.lit(False) if value is None else column.isNull() | (column < F.lit(value))
        else:
            after = column.isNotNull() if value is None else column > F.lit(value)
        test = F.coalesce(after, F.lit(False)) | (column.eqNullSafe(F.lit(value)) & test)
    return test


class SortedList:
    """A list sorted and stored for paging; ``keys`` maps the sort columns to whether they descend."""

    def __init__(self, spark: SparkSession, folder: str, keys: Mapping[str, bool], schema: StructType):
        self.spark, self.folder, self.keys, self.schema = spark, folder.rstrip("/"), dict(keys), schema

    @classmethod
    def store(cls, rows: DataFrame, folder: str, keys: Mapping[str, bool], parts: int | None = None) -> SortedList:
        """Sort into ``parts`` ranges (by default as many as shuffle partitions); a page reads one or two of them."""
        out = cls(rows.sparkSession, folder, keys, rows.schema)
        parts = parts or int(out.spark.conf.get("spark.sql.shuffle.partitions"))
        order = _order(keys)
        dealt = rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", *order)
        dealt.write.partitionBy("part").parquet(f"{out.folder}/rows")
        stored = out.spark.read.schema(dealt.schema).parquet(f"{out.folder}/rows")
        within = Window.partitionBy("part").orderBy(*order)
        # Each range's first key: one row per range, found by a sort that the files already have.
        firsts = stored.select("part", *keys, F.row_number().over(within).alias("_n"), F.count(F.lit(1)).over(Window.partitionBy("part")).alias("n")).filter("_n = 1").drop("_n")
        firsts.write.parquet(f"{out.folder}/ranges")
        return out

    def page(self, size: int, cursor: Mapping | None = None) -> DataFrame:
        """The ``size`` rows after the cursor (a mapping or row with the keys), in order."""
        kinds = StructType([StructField("part", IntegerType()), *[self.schema[k] for k in self.keys], StructField("n", LongType())])
        ranges = self.spark.read.schema(kinds).parquet(f"{self.folder}/ranges")  # one row per range
        passed = ~beyond(self.keys, cursor) if cursor is not None else F.lit(False)
        listed = ranges.select("part", "n", passed.alias("passed")).orderBy("part").collect()
        begun = [r.part for r in listed if r.passed]
        start = begun[-1] if begun else (listed[0].part if listed else 0)  # the last range that begins at or before the cursor
        chosen, ahead = [], 0
        for r in listed:
            if r.part >= start and ahead < size:
                chosen.append(r.part)
                ahead += r.n if r.part > start or not begun else 0
        paths = [f"{self.folder}/rows/part={part}" for part in chosen]
        rows = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        return (rows if cursor is None else rows.filter(beyond(self.keys, cursor))).orderBy(*_order(self.keys)).limit(size)
