"""Turning array columns into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_built(df: DataFrame, items: Column, *keep, name: str = "o", position: str | None = None) -> DataFrame:
    """Explode an array that takes work to build.

    A plain explode makes the optimizer test the array's size in a filter below, which would build it twice.
    """
    generator = F.posexplode_outer(items).alias(position or "_pos", name)
    out = df.select(*keep, generator).filter(F.col(name).isNotNull())
    return out if position else out.drop("_pos")
