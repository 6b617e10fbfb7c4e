"""Spreading rows over tasks: those of a key that holds a large share of a fact table, and those that take long for their bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted(rows: DataFrame, spread: list[str], salts: int = SALTS) -> DataFrame:
    """Add ``_salt``, which spreads the rows of one key over several partitions."""
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))


def join_per_key(rows: DataFrame, dimension: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join salted rows to a dimension that has at most one row per key; the dimension is repeated per salt.

    Rows keep their (keys, salt) partitioning, so a following aggregate on the keys combines before it shuffles.
    """
    repeated = dimension.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(repeated, [*keys, "_salt"], how)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly to as many tasks as the session shuffles to, which adaptive execution does not join again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
