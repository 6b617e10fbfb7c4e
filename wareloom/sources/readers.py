"""Reading ledgers, dictionaries, stored tables and enrichment results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.operators import keywords as kw
from wareloom.operators import mapping as mp


def read_ledger(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    """A supplier ledger with its headers verbatim and every cell as text.

    No schema inference pass: CSV cells are text as read, other formats are cast. A CSV file whose cells hold line breaks needs
    ``multi_line``; such a file cannot be split, so it is one task's work whatever its size.
    """
    reader = spark.read
    if fmt == "csv":
        options = {"header": "true", "multiLine": str(multi_line).lower(), "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
        return reader.options(**options).csv(path)
    df = reader.option("primitivesAsString", "true").json(path) if fmt == "json" else reader.format(fmt).load(path)
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def as_raw_rows(ledger: DataFrame, site, row_no: str) -> DataFrame:
    """Wide ledger to ``site, row_no, raw map``, the input of the column mapping."""
    cells = [c for c in ledger.columns if c != row_no]
    raw = F.map_from_arrays(F.array(*[F.lit(c) for c in cells]), F.array(*[F.col(f"`{c}`") for c in cells]))
    return ledger.select(F.lit(site).alias("site"), F.col(row_no).cast("bigint").alias("row_no"), raw.alias("raw"))


def ledger_sample(ledger: DataFrame, n: int = 5) -> DataFrame:
    """First rows of every ledger, blanks as empty strings."""
    return mp.sample_rows(ledger, n).withColumn("raw", F.transform_values("raw", lambda k, v: F.coalesce(v, F.lit(""))))


def read_category_dictionary(rows: DataFrame) -> DataFrame:
    """Category paths with ids, normalised, in file order."""
    return kw.read_dictionary(rows)


def scan_state(state: DataFrame, user_id, site_id=None, any_site: bool = False) -> DataFrame:
    """Rows of one owner and one site; no site means rows that belong to none. Both tests reach the file scan."""
    owned = state.filter(F.col("user_id") == user_id)
    if any_site:
        return owned
    return owned.filter(F.col("site_id").isNull() if site_id is None else F.col("site_id") == site_id)


ENRICHMENT = "product_id bigint, refined_name string, related array<string>, synonyms array<string>"


def read_enrichment(spark: SparkSession, path: str) -> DataFrame:
    """Results of external services, one JSON object per product."""
    return spark.read.schema(ENRICHMENT).json(path)


def with_enrichment(products: DataFrame, results: DataFrame) -> DataFrame:
    """Products with their results; a product without a row had a failing call and keeps its original name."""
    r = results.select("product_id", F.struct("refined_name", "related", "synonyms").alias("r"))
    joined = products.join(r, "product_id", "left")
    none = F.array().cast("array<string>")
    return joined.select(products["*"], F.coalesce("r.refined_name", "original_name").alias("refined_name"), F.coalesce("r.related", none).alias("related"),
                         F.coalesce("r.synonyms", none).alias("synonyms"), F.col("r").isNull().alias("call_failed"))
