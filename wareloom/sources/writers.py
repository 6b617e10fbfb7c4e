"""Writing ledgers, exports, append tables and state versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareloom import constants as K
from wareloom.functions import text as tx
from wareloom.operators import options as op


class NothingToExport(ValueError):
    """The selected scope has no products."""


def supplier_ledger(products: DataFrame, options: DataFrame, supplier_id=None) -> DataFrame:
    """Crawled products as the fifteen ledger columns, options inlined as aligned comma lists."""
    if supplier_id is not None:
        products = products.filter(F.col("supplier_id") == supplier_id)
    joined = products.join(op.inline_options(options), "product_id", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    status = F.when(F.coalesce("supplier_status", F.lit("")) == "", F.lit(K.EXPORT_STATUS["available"])).otherwise(
        tx.lookup(F.col("supplier_status"), K.EXPORT_STATUS, F.col("supplier_status")))
    extra = lambda i: F.coalesce(F.get("extra_image_urls", F.lit(i)), F.lit(""))
    with_options = (text("names") != "") & (text("prices") != "")
    columns = (status, text("supplier_product_id"), text("supplier_product_code"), text("raw_product_name"),
               F.when(with_options, F.col("prices")).otherwise(text("supply_price")), text("origin"), text("main_image_url"), text("detail_content"),
               text("names"), text("images"), extra(0), extra(1), extra(2), extra(3), text("first_seen_on"))
    return joined.select(*[c.alias(h) for c, h in zip(columns, K.EXPORT_HEADERS)])


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Ledger as CSV in product-code order: range-partitioned, so that no single task sorts everything."""
    ordered = ledger.repartitionByRange(F.col("상품코드")).sortWithinPartitions("상품코드")
    ordered.write.mode("overwrite").options(header="true", quote='"', escape='"', emptyValue="").csv(path)


def processed_export(products: DataFrame, mappings: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Processed products with their market categories; without a selection only completed ones."""
    chosen = products.join(ids.select("product_id"), "product_id", "left_semi") if ids is not None else products.filter(F.col("status") == "completed")
    of = lambda market, value: F.max(F.when(F.col("platform_name") == market, value))
    filled = lambda c: tx.null_if_empty(F.col(c))
    categories = mappings.groupBy("product_id").agg(
        of("naver", F.coalesce(filled("category_id"), filled("category_path"), F.lit(""))).alias("a"), of("coupang", F.coalesce(filled("category_id"), F.lit(""))).alias("b"))
    joined = chosen.join(categories, "product_id", "left")
    blank = lambda c: F.coalesce(c, F.lit(""))
    columns = (F.col("product_id").cast("string"), F.col("original_name"), blank(F.col("refined_name")), blank(F.array_join("keywords", ", ")),
               blank(F.col("a")), blank(F.col("b")), F.col("status"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    return joined.select(*[c.alias(h) for c, h in zip(columns, K.PROCESSED_EXPORT_HEADERS)])


def write_processed_export(export: DataFrame, path: str) -> None:
    if export.isEmpty():
        raise NothingToExport("No products found to export")
    export.write.mode("overwrite").options(header="true", quote='"', escape='"', emptyValue="").csv(path)


def append(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """Add to a history table. With a partition column every run has its own folder, and a run that is written again
    replaces its own rows only."""
    if partition:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    else:
        rows.write.mode("append").parquet(path)


def write_version(state: DataFrame, root: str, version: str) -> str:
    """Write the next state beside the one it was read from; the caller switches readers to the returned path."""
    path = f"{root.rstrip('/')}/version={version}"
    state.write.mode("overwrite").parquet(path)
    return path


def stage_trace(products: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per processed product its ordered stages with times; a failed one has an error and no stages."""
    joined = products.join(outcomes, "product_id")
    none = F.array().cast("array<struct<stage:string,ms:int>>")
    stages = F.coalesce("stages", none)
    total = F.aggregate(stages, F.lit(0).cast("bigint"), lambda acc, s: acc + F.coalesce(s["ms"], F.lit(0)))
    shown = F.transform(stages, lambda s: F.struct(s["stage"].alias("stage"), F.coalesce(s["ms"], F.lit(0)).alias("ms")))
    return joined.select("product_id", F.col("original_name").alias("name"), total.alias("total_ms"), F.when(F.col("success"), shown).otherwise(none).alias("stages"),
                         F.when(~F.col("success"), F.col("error")).alias("error"))
