"""Read-model queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wareloom.operators import reads as rd
from wareloom.plans import ledger as lp
from wareloom.plans.registry import query


def catalogue(t):
    return t.catalogue.withColumns({
        "images_list": F.array_compact(F.array("image_1", "image_2")), "keywords": F.split("keyword_list", ","), "updated_at": F.col("created_at"),
        "image_detail": F.concat(F.lit("<p>"), "original_name")})


@query("R1", """
WITH f AS (SELECT * FROM catalogue WHERE original_name ILIKE '%RING%' AND status = 'completed')
SELECT (SELECT count(*) FROM f) AS total, product_id, original_name, price_wholesale FROM f ORDER BY created_at DESC, product_id LIMIT 20 OFFSET 20""")
def r1(t):
    rows = rd.filter_products(catalogue(t), search="RING", status="completed")
    page = rd.page_of(rows, rd.product_order(), 2, 20)
    return page.select("product_id", "original_name", "price_wholesale", rd.total(rows).scalar().alias("total"))


@query("R2", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{name}' AS sort, product_id, price_wholesale, option_count FROM catalogue ORDER BY {order}, created_at DESC, product_id LIMIT 100) q{i}"
    for i, (name, order) in enumerate([("price asc", "price_wholesale ASC NULLS LAST"), ("price desc", "price_wholesale DESC NULLS LAST"),
                                       ("options asc", "coalesce(option_count, 0)"), ("options desc", "coalesce(option_count, 0) DESC"), ("newest", "created_at DESC")])))
def r2(t):
    sorts = [("price asc", "price_wholesale", "asc"), ("price desc", "price_wholesale", "desc"), ("options asc", "option_count", "asc"), ("options desc", "option_count", "desc"), ("newest", None, "desc")]
    pages = [rd.page_of(t.catalogue, rd.product_order(by, order), 1, 100).select(F.lit(name).alias("sort"), "product_id", "price_wholesale", "option_count") for name, by, order in sorts]
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page)
    return out


@query("R3", "SELECT product_id, status FROM catalogue WHERE product_id IN (SELECT product_id FROM platform_mappings WHERE sync_status = 'pending_update')")
def r3(t):
    return rd.needs_sync(t.catalogue, t.platform_mappings).select("product_id", "status")


@query("R4", """
SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'completed') AS completed,
  count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (image_status = 'completed') AS image_completed, count(*) FILTER (image_status = 'failed') AS image_failed,
  (SELECT count(*) FROM platform_mappings WHERE platform_name = 'naver' AND product_name IS NOT NULL) AS named FROM catalogue""")
def r4(t):
    return rd.product_stats(t.catalogue, t.platform_mappings)


MARKETS_SQL = """k AS (SELECT product_id, CASE platform_name WHEN 'naver' THEN 'smartstore' ELSE platform_name END AS market, platform_name = 'naver' AS alias, category_id, category_path, product_name FROM platform_mappings),
m AS (SELECT product_id, market, category_id, category_path, product_name FROM (SELECT *, row_number() OVER (PARTITION BY product_id, market ORDER BY alias) AS q FROM k) z WHERE q = 1)"""


@query("R5", f"""
WITH {MARKETS_SQL}
SELECT c.product_id, CASE WHEN processed_image_path IS NOT NULL THEN processed_image_path ELSE coalesce(image_1, image_2) END AS first_image,
  CAST(CASE WHEN image_1 IS NULL THEN 0 ELSE 1 END + CASE WHEN image_2 IS NULL THEN 0 ELSE 1 END AS INT) AS images, coalesce(keyword_list, '') AS keywords, price_wholesale AS wholesale,
  s.category_id AS smartstore_category, s.product_name AS smartstore_name, p.category_id AS coupang_category
FROM catalogue c LEFT JOIN m s ON s.product_id = c.product_id AND s.market = 'smartstore' LEFT JOIN m p ON p.product_id = c.product_id AND p.market = 'coupang'""")
def r5(t):
    docs = rd.market_documents(catalogue(t), t.platform_mappings)
    category = lambda market, field: F.try_element_at("market_categories", F.lit(market))[field]
    return docs.select("product_id", F.col("images.list")[0].alias("first_image"), F.size("images.list").alias("images"), F.array_join("keywords", ",").alias("keywords"),
                       F.col("price.wholesale").alias("wholesale"), category("smartstore", "category_id").alias("smartstore_category"),
                       category("smartstore", "product_name").alias("smartstore_name"), category("coupang", "category_id").alias("coupang_category"))


@query("R6", """
SELECT import_id, site_name, filename, created_at, new_count, updated_count, removed_count FROM import_runs LEFT JOIN sites USING (site_id) WHERE new_count + updated_count + removed_count > 0""")
def r6(t):
    return rd.run_list(t.import_runs, t.sites).select("import_id", "site_name", "filename", "created_at", "new_count", "updated_count", "removed_count")


@query("R7", f"""
WITH {lp.DIFF_SQL}, g AS (SELECT * FROM x WHERE kind = 'updated')
SELECT (SELECT count(*) FROM g) AS total, code AS product_code, kind AS change_type, coalesce(new_name, old_name) AS original_name FROM g ORDER BY kind, original_name, code LIMIT 500""")
def r7(t):
    from wareloom.operators import ledger as lg
    count, page = rd.run_changes(lg.change_log(lp.changes(t), "run-1"), "run-1", "updated", 1, 500)
    return page.select("product_code", "change_type", "original_name", count.scalar().alias("total"))


@query("R8", "SELECT draft_id, d.account_id, user_id, market_code, status, updated_at FROM stored_drafts d JOIN accounts USING (account_id) WHERE market_code = 'smartstore' AND status = 'ready'")
def r8(t):
    return rd.draft_list(t.stored_drafts, t.accounts, market_code="smartstore", status="ready").select("draft_id", "account_id", "user_id", "market_code", "status", "updated_at")


OWNED_SQL = {
    "accounts": "SELECT account_id AS id, user_id, CAST('2024-01-01' AS DATE) + CAST(account_id % 90 AS INT) AS created_at FROM accounts",
    "sites": "SELECT site_id AS id, site_id % 7 AS user_id, CAST('2024-01-01' AS DATE) + CAST(site_id % 5 AS INT) AS created_at FROM sites",
    "submissions": "SELECT draft_id AS id, account_id % 7 AS user_id, updated_at AS created_at FROM stored_drafts WHERE status = 'submitting'"}


@query("R8_lists", " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, CAST(id AS BIGINT) AS id, CAST(row_number() OVER (ORDER BY created_at DESC, id) AS INT) AS position FROM ({sql}) {kind} WHERE user_id = 3" for kind, sql in OWNED_SQL.items()))
def r8_lists(t):
    """An owner's accounts, sites and submission jobs with their places in the lists."""
    place = Window.orderBy(F.desc("created_at"), "id")
    out = None
    for kind, sql in OWNED_SQL.items():
        listed = rd.owned_list(t.sql(sql), 3, "id").withColumn("position", F.row_number().over(place))
        listed = listed.select(F.lit(kind).alias("kind"), F.col("id").cast("bigint").alias("id"), "position")
        out = listed if out is None else out.unionByName(listed)
    return out


@query("R9", "SELECT DISTINCT l_partkey AS product_id FROM lineitem WHERE l_partkey NOT IN (SELECT product_id FROM catalogue WHERE user_id < 5)")
def r9(t):
    return rd.not_owned(t.lineitem.select(F.col("l_partkey").alias("product_id")), t.catalogue.filter("user_id < 5"), "product_id")


@query("R10", """
WITH r AS (SELECT DISTINCT l_partkey AS product_id FROM lineitem WHERE l_quantity > 40)
SELECT product_id, coalesce(nullif(image_1, ''), image_2) AS url, status = 'completed' AND coalesce(nullif(image_1, ''), image_2) IS NOT NULL AS eligible FROM catalogue JOIN r USING (product_id)""")
def r10(t):
    return rd.image_jobs(catalogue(t), t.lineitem.filter("l_quantity > 40").select(F.col("l_partkey").alias("product_id")))


@query("R11", """
WITH g AS (SELECT 'refused' AS call, product_id FROM catalogue WHERE site_id = 2 UNION ALL SELECT 'forced', product_id FROM catalogue WHERE site_id = 2
   UNION ALL SELECT 'free', product_id FROM catalogue WHERE product_id NOT IN (SELECT product_id FROM platform_mappings WHERE sync_status = 'synced')),
f AS (SELECT call, count(*) AS targets FROM g GROUP BY 1), s AS (SELECT call, count(*) AS synced FROM g JOIN platform_mappings USING (product_id) WHERE sync_status = 'synced' GROUP BY 1)
SELECT call, call <> 'refused' AS success, CASE WHEN call = 'refused' THEN 0 ELSE targets END AS deleted_count, CASE WHEN call = 'refused' THEN synced ELSE 0 END AS warning_synced_count,
  (SELECT count(*) FROM catalogue) - CASE WHEN call = 'refused' THEN 0 ELSE targets END AS remaining,
  (SELECT count(*) FROM platform_mappings m WHERE f.call = 'refused' OR NOT EXISTS (SELECT 1 FROM g WHERE g.call = f.call AND g.product_id = m.product_id)) AS remaining_mappings
FROM f LEFT JOIN s USING (call)""")
def r11(t):
    site, synced = t.catalogue.filter("site_id = 2"), t.platform_mappings.filter("sync_status = 'synced'")
    free = t.catalogue.join(synced, "product_id", "left_anti")
    out = None
    for call, targets, force in (("refused", site, False), ("forced", site, True), ("free", free, False)):
        report, left, mapped = rd.guarded_delete(t.catalogue, t.platform_mappings, targets, force)
        size = lambda df: df.agg(F.count(F.lit(1))).scalar()
        row = report.select(F.lit(call).alias("call"), "*", size(left).alias("remaining"), size(mapped).alias("remaining_mappings"))
        row = row.withColumns({c: F.col(c).cast("bigint") for c in ("deleted_count", "warning_synced_count")})
        out = row if out is None else out.unionByName(row)
    return out


@query("R11_owners", """
WITH g AS (SELECT 'refused' AS call, product_id FROM owned_parts WHERE user_id = 1 AND site_id = 10 UNION ALL SELECT 'forced', product_id FROM owned_parts WHERE user_id = 1 AND site_id = 10)
SELECT call, kind, count(*) FILTER (WHERE NOT gone) AS n FROM (
  SELECT c.call, m.kind, c.call = 'forced' AND EXISTS (SELECT 1 FROM g WHERE g.call = c.call AND g.product_id = m.product_id) AS gone
  FROM (SELECT DISTINCT call FROM g) c CROSS JOIN owner_mappings m) x GROUP BY 1, 2""")
def r11_owners(t):
    """One owner deletes a site's products out of a mapping table that also holds another owner's mappings and those of no product."""
    own = t.owned_parts.filter("user_id = 1")
    out = None
    for call, force in (("refused", False), ("forced", True)):
        _, _, left = rd.guarded_delete(own, t.owner_mappings, own.filter("site_id = 10"), force)
        kept = t.owner_mappings.select("kind").distinct().join(left.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kind", "left")
        row = kept.select(F.lit(call).alias("call"), "kind", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


R12_TABLES = {"suppliers": ("monitor_suppliers", "supplier_id"), "runs": ("crawl_runs", "run_id"), "products": ("crawled_products", "product_id"),
              "options": ("crawled_options", "product_id"), "snapshots": ("snapshots", "snapshot_id"), "changes": ("stock_changes", "change_id")}


@query("R12", " UNION ALL ".join(
    f"SELECT '{name}' AS tbl, {key} AS id FROM {table} WHERE " + ("supplier_id IS DISTINCT FROM 7" if name in ("suppliers", "runs", "products") else
                                                                 "product_id NOT IN (SELECT product_id FROM crawled_products WHERE supplier_id = 7)")
    for name, (table, key) in R12_TABLES.items()))
def r12(t):
    left = rd.delete_supplier({name: getattr(t, table) for name, (table, _) in R12_TABLES.items()}, 7)
    out = None
    for name, (_, key) in R12_TABLES.items():
        part = left[name].select(F.lit(name).alias("tbl"), F.col(key).cast("bigint").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


@query("R13", """
SELECT product_id, original_name, CASE WHEN user_id < 3 THEN refined_name || '|bad!' ELSE '' END AS candidates,
  CASE WHEN user_id < 3 THEN refined_name WHEN contains(concat(' ', original_name, ' '), concat(' ', split_part(keyword_list, ',', 2), ' ')) THEN original_name
    ELSE concat(original_name, ' ', split_part(keyword_list, ',', 2)) END AS product_name,
  CASE WHEN user_id < 3 THEN 'llm' ELSE 'fallback' END AS generation_method
FROM catalogue WHERE status = 'completed' AND refined_name IS NOT NULL AND keyword_list IS NOT NULL""")
def r13(t):
    products = catalogue(t)
    candidates = products.filter("user_id < 3 AND refined_name IS NOT NULL").select("product_id", F.array("refined_name", F.lit("bad!")).alias("candidates"))
    out = rd.name_results(products, candidates)
    return out.withColumn("candidates", F.array_join("candidates", "|"))
