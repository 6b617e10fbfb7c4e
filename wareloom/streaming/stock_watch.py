"""Streaming change detection: snapshots in, change rows out, last known state kept in written tables.

Each micro-batch is compared with the state of the batches before it, by the same operators as the batch job, so a product with very many
snapshots is never handled by one task. State is kept in buckets by a hash of the product; a batch reads and rewrites only the buckets
its products fall into, and a manifest per batch names the version of every bucket. Versions are named by batch id: a batch that is run
again after a failure starts from the same manifest and overwrites its own output. A manifest that should be there and is not is an error.

A snapshot older than the product's last known one cannot be compared in order any more. It is late: it is kept in the table ``late``, gives no
change row and does not touch the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wareloom.functions.skew import join_per_key, salted
from wareloom.operators import snapshots as sn
from wareloom.session import remove_folder

COLUMNS = ["snapshot_id", "product_id", "captured_at", "supplier_status", "supply_price"]
BUCKETS = 64


class StockWatch:
    """Detect changes of a snapshot stream.

    ``folder`` holds state, change rows, late rows and the stream's own checkpoint. With ``products`` snapshots of unknown products are left
    out; with ``stock``, the name of a column ``map<sku, quantity>``, stock changes are found too.
    """

    def __init__(self, spark: SparkSession, folder: str, products: DataFrame | None = None, stock: str | None = None, buckets: int = BUCKETS):
        self.spark, self.folder, self.products, self.stock, self.buckets = spark, folder.rstrip("/"), products, stock, buckets
        self.values = ["supplier_status", "supply_price", *([stock] if stock else [])]

    def manifest(self, batch_id: int) -> dict[int, int]:
        """Version of each bucket after a batch; empty before the first one."""
        if batch_id < 0:
            return {}
        return {r.bucket: r.version for r in self.spark.read.parquet(f"{self.folder}/manifest/batch={batch_id}").select("bucket", "version").collect()}

    def state(self, manifest: dict[int, int], buckets: list[int] | None = None) -> DataFrame | None:
        """Last known snapshot of every product of the buckets, with the last status and price that were not null."""
        paths = [f"{self.folder}/state/version={v}/bucket={b}" for b, v in sorted(manifest.items()) if buckets is None or b in buckets]
        return self.spark.read.parquet(*paths) if paths else None

    def changes(self) -> DataFrame:
        """Every change row found so far."""
        return self.spark.read.parquet(f"{self.folder}/changes")

    def late(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/late")

    def updated(self, products: DataFrame, batch_id: int) -> DataFrame:
        """Products with the status and price known after a batch."""
        known = self.state(self.manifest(batch_id))
        if known is None:
            return products
        seen = known.select("product_id", "known_status", "known_price")
        joined = products.join(seen, "product_id", "left")
        return joined.withColumns({"supplier_status": F.coalesce("known_status", "supplier_status"), "supply_price": F.coalesce("known_price", "supply_price")}
                                  ).drop("known_status", "known_price")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        columns = ["snapshot_id", "product_id", "captured_at", *self.values]
        batch = batch.select(*columns)
        if self.products is not None:
            batch = sn.known_only(batch, self.products)
        bucket = F.pmod(F.xxhash64("product_id"), F.lit(self.buckets)).cast("int")
        batch = batch.withColumn("bucket", bucket).persist()
        try:
            before = self.manifest(batch_id - 1)
            touched = [r.bucket for r in batch.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            known = self.state(before, touched)
            fresh, late = batch, batch.filter(F.lit(False))
            if known is not None:
                last = known.select("product_id", F.struct("captured_at", "snapshot_id").alias("_last"))
                timed = join_per_key(salted(batch, ["snapshot_id"]), last, ["product_id"], "left").drop("_salt")
                is_late = F.coalesce(F.struct("captured_at", "snapshot_id") <= F.col("_last"), F.lit(False))
                fresh, late = timed.filter(~is_late).drop("_last"), timed.filter(is_late).drop("_last")
            late.drop("bucket").write.mode("overwrite").parquet(f"{self.folder}/late/batch={batch_id}")
            rows = fresh.select(*columns, F.lit(True).alias("fresh"), F.col("supplier_status").alias("known_status"), F.col("supply_price").alias("known_price"))
            if known is not None:
                rows = rows.unionByName(known.select(*columns, F.lit(False).alias("fresh"), "known_status", "known_price"))
            pairs = sn.with_previous(rows, self.values).filter("fresh")
            sn.detect_changes(pairs, self.stock).write.mode("overwrite").parquet(f"{self.folder}/changes/batch={batch_id}")
            self._write_state(rows, columns, batch_id, before, touched)
        finally:
            batch.unpersist()

    def _write_state(self, rows: DataFrame, columns: list[str], batch_id: int, before: dict[int, int], touched: list[int]) -> None:
        order = F.struct("captured_at", "snapshot_id")
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
        rest = [c for c in columns if c != "product_id"]
        state = rows.groupBy("product_id").agg(F.max_by(F.struct(*rest), order).alias("s"), last("known_status"), last("known_price")).select(
            "product_id", "s.*", "known_status", "known_price", F.pmod(F.xxhash64("product_id"), F.lit(self.buckets)).cast("int").alias("bucket"))
        state.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/state/version={batch_id}")
        after = before | dict.fromkeys(touched, batch_id)
        manifest = self.spark.createDataFrame(sorted(after.items()), "bucket int, version bigint").coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={batch_id}")
        if batch_id > 1:  # what neither this batch's manifest nor the one before names is not read again
            for b, v in self.manifest(batch_id - 2).items():
                if before.get(b) != v:
                    remove_folder(self.spark, f"{self.folder}/state/version={v}/bucket={b}")

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.folder}/checkpoint")
        return writer.trigger(**(trigger or {"availableNow": True})).start()
