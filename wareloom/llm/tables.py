"""Reading the corpus tables and keeping intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.session import checkpoint_folder, remove_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def field(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_text(name: str = "text") -> Column:
    return F.coalesce(field(name).cast("string"), F.lit(""))


class Scratch:
    """Tables written as Parquet below ``spark.checkpoint.dir``: every executor sees them, and a lost executor costs no recomputation.

    They are removed when the driver process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.folder = f"{checkpoint_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self._count = 0
        atexit.register(_forget, spark, self.folder)

    def keep(self, df: DataFrame, batch_rows: int | None = None) -> DataFrame:
        """Write and reread; ``batch_rows`` is the size of the batches that go to Python while this table is written."""
        self._count += 1
        path = f"{self.folder}/{self._count:04d}"
        setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(setting)
        try:
            self.spark.conf.set(setting, batch_rows or before)
            df.write.parquet(path)
        finally:
            self.spark.conf.set(setting, before)
        return self.spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, folder: str) -> None:
    """Results may read the tables as long as the session lives, so they go when the driver ends."""
    if spark.sparkContext._jsc is not None:
        remove_folder(spark, folder)
