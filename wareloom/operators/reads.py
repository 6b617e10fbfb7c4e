"""Read models: product lists, statistics, market documents, change history, guarded deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareloom import constants as K
from wareloom.functions.text import clean_text, lookup, no_texts
from wareloom.operators import names as nm


def filter_products(products: DataFrame, user_id=None, search: str | None = None, status: str | None = None,
                    image_status: str | None = None, import_id=None, site_id=None) -> DataFrame:
    """Owner scope and the list filters; every given one must hold."""
    exact = {"user_id": user_id, "status": status, "image_status": image_status, "import_id": import_id, "site_id": site_id}
    for column, value in exact.items():
        if value is not None:
            products = products.filter(F.col(column) == value)
    return products.filter(F.col("original_name").ilike(f"%{search}%")) if search else products


def product_order(sort_by: str | None = None, sort_order: str = "desc") -> list[Column]:
    """Ordering of a product list; ties fall to the newest row, then to the id."""
    tie = [F.desc("created_at"), F.asc("product_id")]
    up = sort_order == "asc"
    if sort_by == "price_wholesale":
        price = F.col("price_wholesale")
        return [price.asc_nulls_last() if up else price.desc_nulls_last(), *tie]
    if sort_by == "option_count":
        n = F.coalesce("option_count", F.lit(0))
        return [n.asc() if up else n.desc(), *tie]
    return tie


def page_of(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page; a sort with offset and limit, of which Spark keeps only the top rows per partition."""
    return rows.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)


def total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"))


def needs_sync(products: DataFrame, mappings: DataFrame) -> DataFrame:
    """Products with a mapping that waits for an update; each once, however many such mappings it has."""
    waiting = mappings.filter(F.col("sync_status") == "pending_update").select("product_id")
    return products.join(waiting, "product_id", "left_semi")


def product_stats(products: DataFrame, mappings: DataFrame, site_id=None) -> DataFrame:
    """One row: products by status and image status, and how many carry a market name."""
    if site_id is not None:
        products = products.filter(F.col("site_id") == site_id)
    n = lambda column, value: F.count_if(F.col(column) == value)
    counts = products.agg(
        F.count(F.lit(1)).alias("total"), *[n("status", s).alias(s) for s in ("pending", "processing", "completed", "failed")],
        n("image_status", "completed").alias("image_completed"), n("image_status", "failed").alias("image_failed"))
    named = mappings.filter((F.col("platform_name") == "naver") & F.col("product_name").isNotNull())
    named = named.join(products.select("product_id"), "product_id").agg(F.count(F.lit(1)).alias("named"))
    return counts.withColumn("named", named.scalar())


def market_categories(mappings: DataFrame) -> DataFrame:
    """One row per (product, market): platforms renamed to markets, an explicit market row hiding the older alias row."""
    market = lookup(F.col("platform_name"), K.MARKET_ALIASES, F.col("platform_name"))
    alias = F.col("platform_name").isin(*K.MARKET_ALIASES)
    picked = mappings.groupBy("product_id", market.alias("market")).agg(
        F.min_by(F.struct("category_id", "category_path", "product_name"), alias).alias("c"))
    return picked.select("product_id", "market", "c.*")


def market_documents(products: DataFrame, mappings: DataFrame) -> DataFrame:
    """One nested document per product, with its market categories; a processed image takes the first image's place."""
    entry = F.struct("market", F.struct("category_id", "category_path", "product_name").alias("category"))
    # A product has at most one row per market, so this list is as short as the list of markets.
    per_product = market_categories(mappings).groupBy("product_id").agg(F.map_from_entries(F.collect_list(entry)).alias("market_categories"))
    joined = products.join(per_product, "product_id", "left")
    images = F.coalesce("images_list", no_texts())
    shown = F.when(F.col("processed_image_path").isNotNull(), F.concat(F.array("processed_image_path"), F.slice(images, 2, F.greatest(F.size(images), F.lit(1))))).otherwise(images)
    return joined.select(
        "product_id", F.col("updated_at").alias("version"), "product_code", "original_name", "refined_name", "brand_name",
        F.coalesce("keywords", no_texts()).alias("keywords"), "origin",
        F.struct(F.col("price_wholesale").alias("wholesale")).alias("price"),
        F.struct(shown.alias("list"), F.col("image_detail").alias("detail_content")).alias("images"), "market_categories")


def run_list(runs: DataFrame, sites: DataFrame, changed_only: bool = True) -> DataFrame:
    """Upload runs with the site name, newest first; optionally only those that changed something."""
    joined = runs.join(sites, "site_id", "left")
    if changed_only:
        joined = joined.filter(F.col("new_count") + F.col("updated_count") + F.col("removed_count") > 0)
    return joined.orderBy(F.desc("created_at"), "import_id")


def run_changes(log: DataFrame, import_id, change_type: str | None = None, page: int = 1, page_size: int = 50) -> tuple[DataFrame, DataFrame]:
    """(total, one page) of a run's change log, ordered by type and name."""
    rows = log.filter(F.col("import_id") == import_id)
    if change_type in ("new", "updated", "removed"):
        rows = rows.filter(F.col("change_type") == change_type)
    order = [F.asc("change_type"), F.asc("original_name"), F.asc("product_code")]
    return total(rows), page_of(rows, order, page, max(1, page_size))


def draft_list(drafts: DataFrame, accounts: DataFrame, user_id=None, market_code: str | None = None, status: str | None = None) -> DataFrame:
    """Drafts of an owner's accounts, newest first."""
    if user_id is not None:
        accounts = accounts.filter(F.col("user_id") == user_id)
    if market_code is not None:
        accounts = accounts.filter(F.col("market_code") == market_code)
    if status is not None:
        drafts = drafts.filter(F.col("status") == status)
    return drafts.join(accounts, "account_id").orderBy(F.desc("updated_at"), "draft_id")


def owned_list(rows: DataFrame, user_id, key: str, at: str = "created_at") -> DataFrame:
    """One owner's rows (accounts, sites, submission jobs), newest first."""
    return rows.filter(F.col("user_id") == user_id).orderBy(F.desc(at), key)


def not_owned(requested: DataFrame, owned: DataFrame, key: str) -> DataFrame:
    """Distinct requested ids that the owner does not have; must be empty for a request to go through."""
    return requested.select(key).distinct().join(owned.select(key), key, "left_anti")


def first_image(images: Column) -> Column:
    return F.try_element_at(F.filter(F.transform(images, lambda i: clean_text(i)), lambda i: i.isNotNull()), F.lit(1))


def image_jobs(products: DataFrame, ids: DataFrame) -> DataFrame:
    """Requested products with their representative image and whether they may be processed."""
    wanted = ids.select("product_id").distinct()
    rows = products.join(wanted, "product_id").withColumn("url", first_image(F.col("images_list")))
    return rows.select("product_id", "url", ((F.col("status") == "completed") & F.col("url").isNotNull()).alias("eligible"))


def guarded_delete(products: DataFrame, mappings: DataFrame, targets: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, remaining products, remaining mappings). Without ``force`` nothing is deleted while any target has a synced mapping.

    ``products`` are those of the caller; targets that are not among them are ignored. ``mappings`` may hold those of other owners or of no
    product at all: only mappings of deleted products go.
    """
    hit = products.join(targets.select("product_id").distinct().withColumn("_target", F.lit(True)), "product_id", "left")
    hit = hit.withColumn("_target", F.coalesce("_target", F.lit(False)))
    synced = mappings.filter(F.col("sync_status") == "synced").join(hit.filter("_target").select("product_id"), "product_id", "left_semi")
    facts = hit.agg(F.count_if("_target").alias("targets")).withColumn("synced", synced.agg(F.count(F.lit(1))).scalar())
    allowed = F.lit(force) | (F.col("synced") == 0)
    report = facts.select(allowed.alias("success"), F.when(allowed, F.col("targets")).otherwise(F.lit(0)).alias("deleted_count"),
                          F.when(allowed, F.lit(0)).otherwise(F.col("synced")).alias("warning_synced_count"))
    goes = F.col("_target") & facts.select(allowed).scalar()
    left = mappings.join(hit.filter(goes).select("product_id"), "product_id", "left_anti")
    return report, hit.filter(~goes).drop("_target"), left


def delete_supplier(tables: dict[str, DataFrame], supplier_id) -> dict[str, DataFrame]:
    """The six tables without one supplier: by supplier where they carry it, else through the supplier's products."""
    gone = tables["products"].filter(F.col("supplier_id") == supplier_id).select("product_id")
    without = lambda df: df.join(gone, "product_id", "left_anti")
    own = lambda df: df.filter(~F.col("supplier_id").eqNullSafe(F.lit(supplier_id)))
    return {name: own(df) if "supplier_id" in df.columns else without(df) for name, df in tables.items()}


def name_results(products: DataFrame, candidates: DataFrame) -> DataFrame:
    """Market names for products that finished enrichment: candidates, the name chosen and how.

    ``candidates``: ``product_id, candidates array<string>``; products without a row there use the deterministic name.
    """
    ready = products.filter((F.col("status") == "completed") & clean_text(F.col("refined_name")).isNotNull() & (F.size("keywords") > 0))
    joined = ready.join(candidates, "product_id", "left").withColumn("candidates", F.coalesce("candidates", no_texts()))
    chosen = nm.select_names(joined)
    return chosen.select("product_id", "original_name", "candidates", "product_name",
                         F.when(F.col("from_candidate"), F.lit("llm")).otherwise(F.lit("fallback")).alias("generation_method"))
