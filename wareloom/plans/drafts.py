"""Draft queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wareloom.operators import drafts as dr
from wareloom.operators import pricing as pr
from wareloom.plans.options import sample_options
from wareloom.plans.pricing import POLICIES, PRICES_SQL, choose
from wareloom.plans.registry import query


def account_policies(t):
    """Accounts by number with their rules resolved and parsed once each: five policies, none, and an unusable one."""
    numbers = t.part.select("p_size").distinct()
    size = F.col("p_size")
    rules = F.when(size % 17 == 0, F.lit("{}")).when(size % 19 == 0, F.lit('{"pricingPolicy":"x"}')).otherwise(
        F.concat(F.lit('{"pricingPolicy":'), choose([p[0] for p in POLICIES]), F.lit("}")))
    resolved = numbers.withColumn("_policy", pr.resolve_policy(rules))
    return pr.parse_policies(resolved.withColumns({"policy_json": F.col("_policy.policy_json"), "policy_invalid": F.col("_policy.invalid")}).drop("_policy"))


def market_rows(t):
    """Products as one market sees them, priced under the policy of their account."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    rows = t.part.select(
        "p_partkey", "p_size", "p_name", F.col("p_partkey").alias("product_id"), F.lit("v1").alias("version"),
        F.when(size % 4 != 0, F.col("p_brand")).alias("brand_name"), F.when(size % 23 != 0, F.col("p_name")).alias("refined_name"),
        F.when(size % 23 != 0, F.array(F.lit(" "), F.col("p_type"))).alias("keywords"), F.when(size % 10 != 3, F.lit(" Korea ")).alias("origin"),
        (F.floor("p_retailprice") * 5).alias("cost_price"),
        F.when(size % 13 == 0, F.array(F.lit(" "))).otherwise(F.array(F.concat(key, F.lit(".jpg")), F.lit(""), F.lit("two.jpg"))).alias("images_list"),
        F.when(size % 21 != 0, F.lit("<p>detail</p>")).alias("detail_content"), sample_options().alias("standard_options"),
        F.when(size % 6 != 5, F.concat(F.lit("5000"), size.cast("string"))).alias("category_id"), F.when(size % 9 == 0, F.lit(" Stored name ")).alias("market_name"),
        F.when(size % 2 == 0, F.lit('{"product_attributes":[],"item_attributes":[{"attributeTypeName":"Mat","attributeValueName":"W"}]}')).alias("attributes"),
        F.lit('{"delivery":"std"}').alias("listing_defaults"))
    return pr.price_listings(rows.join(account_policies(t), "p_size"))


def _draft_sql(market: str, stored: bool) -> str:
    m = market.upper()
    return f"""{PRICES_SQL}, titled AS (SELECT p.*, CASE WHEN p_size % 17 = 0 OR p_size % 19 = 0 THEN NULL ELSE sale_price END AS sp, CASE WHEN p_size % 17 = 0 OR p_size % 19 = 0 THEN NULL ELSE expected_profit END AS ep,
   CASE WHEN p_size % 17 = 0 OR p_size % 19 = 0 THEN NULL ELSE expected_margin_rate END AS em,
   CASE WHEN {str(stored).lower()} AND p_size % 9 = 0 THEN 'Stored name' WHEN p_size % 23 = 0 THEN CASE WHEN p_size % 4 <> 0 THEN p_brand ELSE '' END
     ELSE concat(CASE WHEN p_size % 4 <> 0 THEN concat(p_brand, ' ') ELSE '' END, p_name, ' ', p_type) END AS title
   FROM part p JOIN priced USING (p_partkey)),
 checked AS (SELECT *, concat_ws('|', CASE WHEN p_size % 6 = 5 THEN '{m}_MISSING_CATEGORY' END, CASE WHEN title = '' THEN '{m}_MISSING_TITLE' END, CASE WHEN p_size % 13 = 0 THEN '{m}_MISSING_PRIMARY_IMAGE' END,
   CASE WHEN sp IS NULL THEN '{m}_MISSING_SALE_PRICE' END, CASE WHEN p_size % 10 = 3 THEN '{m}_MISSING_ORIGIN' END, CASE WHEN p_size % 21 = 0 THEN '{m}_MISSING_DETAIL_CONTENT' END,
   CASE WHEN p_size % 17 = 0 THEN '{m}_MISSING_PRICING_POLICY' WHEN sp IS NULL THEN '{m}_INVALID_PRICING_POLICY' END) AS errors FROM titled)"""


def draft_columns(df, *extra):
    return df.select("product_id", "display_title", "category_id", "sale_price", "expected_profit", "expected_margin_rate", "primary_image_url",
                     F.array_join(F.transform("errors", lambda e: e["code"]), "|").alias("errors"), "validation_status", *extra)


COMMON_SQL = """p_partkey AS product_id, nullif(title, '') AS display_title, CASE WHEN p_size % 6 <> 5 THEN concat('5000', CAST(p_size AS VARCHAR)) END AS category_id, sp AS sale_price, ep AS expected_profit,
  em AS expected_margin_rate, CASE WHEN p_size % 13 <> 0 THEN concat(CAST(p_partkey AS VARCHAR), '.jpg') END AS primary_image_url, errors, CASE WHEN errors = '' THEN 'valid' ELSE 'blocked' END AS validation_status"""


@query("D4", f"""
WITH {_draft_sql('smartstore', True)}
SELECT {COMMON_SQL}, CASE WHEN p_size % 13 <> 0 THEN 'two.jpg' END AS second_image, CASE WHEN p_size % 3 = 0 THEN '["Color","Size"]' ELSE '["Color"]' END AS option_groups,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'White' END AS second_option, 'std' AS channel FROM checked""")
def d4(t):
    leaf = lambda path, name: F.get_json_object("generated_payload", path).alias(name)
    return draft_columns(dr.market_a_drafts(market_rows(t)), leaf("$.originProduct.images.optionalImages[0].url", "second_image"),
                         leaf("$.originProduct.detailAttribute.optionInfo.optionCombinationGroupNames", "option_groups"),
                         leaf("$.originProduct.detailAttribute.optionInfo.optionCombinations[1].optionName1", "second_option"), leaf("$.smartstoreChannelProduct.delivery", "channel"))


@query("D5", f"""
WITH {_draft_sql('coupang', False)}
SELECT {COMMON_SQL}, concat(p_name, CASE WHEN p_size % 3 = 0 THEN ' / M' ELSE '' END) AS first_item,
  CASE WHEN p_size % 7 = 0 THEN CAST(p_size * 1000 AS VARCHAR) ELSE CAST(sp AS VARCHAR) END AS first_price,
  CASE WHEN p_size % 2 = 0 THEN 'o1.jpg' WHEN p_size % 13 <> 0 THEN concat(CAST(p_partkey AS VARCHAR), '.jpg') END AS first_image,
  CASE WHEN p_size % 2 = 0 THEN 'Mat' END AS last_attribute FROM checked""")
def d5(t):
    leaf = lambda path, name: F.get_json_object("generated_payload", path).alias(name)
    last = F.when(F.col("product_id").isNotNull(), F.coalesce(F.get_json_object("generated_payload", "$.items[0].attributes[2].attributeTypeName"),
                                                              F.get_json_object("generated_payload", "$.items[0].attributes[1].attributeTypeName")))
    return draft_columns(dr.market_b_drafts(market_rows(t)), leaf("$.items[0].itemName", "first_item"), leaf("$.items[0].salePrice", "first_price"),
                         leaf("$.items[0].images[0].vendorPath", "first_image"), F.when(last == "Mat", last).alias("last_attribute"))


@query("D6", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'blocked' WHEN p_size % 2 = 0 THEN 'warning' ELSE 'valid' END AS status FROM part""")
def d6(t):
    some = lambda n: F.when(F.col("p_size") % n == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return t.part.select("p_partkey", dr.verdict(some(3), some(2)).alias("status"))


@query("D7", """
SELECT product_id, account_id, market_code FROM (SELECT product_id, CAST(floor(product_id / 8) AS BIGINT) AS user_id FROM catalogue) c JOIN accounts USING (user_id)
WHERE connection_status = 'connected' AND market_code IN ('smartstore', 'coupang')
  AND NOT EXISTS (SELECT 1 FROM stored_drafts d WHERE d.product_id = c.product_id AND d.account_id = accounts.account_id AND d.status = 'submitting')""")
def d7(t):
    products = t.catalogue.select("product_id", F.floor(F.col("product_id") / 8).cast("bigint").alias("user_id"))
    return dr.draft_targets(products, t.accounts, t.stored_drafts).select("product_id", "account_id", "market_code")


# One active draft per (product, account): the latest order of each pair; every second product brings a new result.
UNIQUE_DRAFTS_SQL = """SELECT CAST(draft_id AS BIGINT) AS draft_id, product_id, account_id, draft_kind, status, version, sale_price, override_patch FROM (
  SELECT draft_id, product_id, account_id, draft_kind, CASE WHEN draft_id % 17 = 0 THEN 'submitted' ELSE status END AS status, updated_at AS version, sale_price,
    CASE WHEN draft_id % 3 = 0 THEN '{"note":1}' ELSE NULL END AS override_patch, row_number() OVER (PARTITION BY product_id, account_id ORDER BY draft_id DESC) AS q FROM stored_drafts) z WHERE q = 1"""
NEW_RESULTS_SQL = """SELECT DISTINCT product_id + CASE WHEN draft_id % 5 = 0 THEN 100000 ELSE 0 END AS product_id, account_id, CAST('1998-01-01 00:00:00' AS TIMESTAMP) AS version, 777 AS sale_price
  FROM stored_drafts JOIN accounts USING (account_id) WHERE connection_status = 'connected'"""


@query("D8", f"""
WITH d AS ({UNIQUE_DRAFTS_SQL}), r AS ({NEW_RESULTS_SQL}), a AS (SELECT * FROM d WHERE status <> 'submitted'),
j AS (SELECT product_id, account_id, a.status, a.draft_id, a.sale_price AS old_price, r.sale_price AS new_price, a.override_patch,
  CASE WHEN a.draft_id IS NULL THEN 'insert' WHEN r.version IS NOT NULL AND a.status <> 'submitting' AND a.version < r.version THEN 'update' ELSE 'keep' END AS action
  FROM a FULL JOIN r USING (product_id, account_id))
SELECT product_id, account_id, draft_id, CASE action WHEN 'keep' THEN status ELSE 'needs_review' END AS status, CASE action WHEN 'keep' THEN old_price ELSE new_price END AS sale_price, override_patch, action FROM j
UNION ALL SELECT product_id, account_id, draft_id, status, sale_price, override_patch, 'keep' FROM d WHERE status = 'submitted'""")
def d8(t):
    results = t.sql(NEW_RESULTS_SQL).withColumn("version", F.col("version").cast("timestamp_ntz"))
    return dr.upsert_drafts(t.sql(UNIQUE_DRAFTS_SQL), results).select("product_id", "account_id", "draft_id", "status", "sale_price", "override_patch", "action")


@query("D9", """
SELECT import_id AS job_id, CASE WHEN user_id = 0 THEN 'queued' WHEN user_id = 1 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN user_id > 1 OR (user_id = 1 AND site_id < 3) THEN 'v2' END AS generated_version, CASE WHEN user_id = 1 THEN '{"type":"KeyError","message":"no snapshot"}' END AS error FROM import_runs""")
def d9(t):
    jobs = t.import_runs.select(F.col("import_id").alias("job_id"), F.lit("queued").alias("status"), F.lit(None).cast("string").alias("generated_version"), "user_id", "site_id")
    bad = F.col("user_id") == 1
    outcomes = jobs.filter("user_id <> 0").select("job_id", F.when(~bad | (F.col("site_id") < 3), F.lit("v2")).alias("generated_version"),
                                                  F.when(bad, F.lit("KeyError")).alias("error_type"), F.when(bad, F.lit("no snapshot")).alias("error_message"))
    return dr.job_outcomes(jobs, outcomes).select("job_id", "status", "generated_version", "error")


EDITS_SQL = """SELECT draft_id, CASE account_id % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'published' WHEN 2 THEN 'failed' ELSE 'ready' END AS status FROM stored_drafts WHERE sale_price > 100000"""


@query("D10", f"""
WITH e AS ({EDITS_SQL}), v AS (SELECT d.*, e.status AS wanted, CASE WHEN e.status NOT IN ('generated', 'needs_review', 'ready', 'failed') THEN 'unsupported_status'
  WHEN e.status = 'ready' AND validation_status = 'blocked' THEN 'blocked' WHEN e.status IS NOT NULL THEN 'ok' END AS verdict FROM stored_drafts d LEFT JOIN e USING (draft_id))
SELECT draft_id, CASE WHEN verdict = 'ok' THEN wanted ELSE status END AS status, verdict FROM v""")
def d10(t):
    return dr.edit_drafts(t.stored_drafts, t.sql(EDITS_SQL)).select("draft_id", "status", "verdict")


# Requests: one job per account and validation class; some name a draft of another account.
REQUESTS_SQL = """SELECT concat(CAST(account_id AS VARCHAR(20)), '-', status) AS job_id, CASE WHEN draft_id % 41 = 0 THEN account_id + 1 ELSE account_id END AS account_id, draft_id FROM stored_drafts"""
GATE_SQL = f"""q AS (SELECT DISTINCT job_id, account_id, draft_id FROM ({REQUESTS_SQL}) z), f AS (SELECT q.job_id, q.draft_id, d.status, d.validation_status, d.draft_id AS found, d.sale_price FROM q LEFT JOIN stored_drafts d ON d.draft_id = q.draft_id AND d.account_id = q.account_id),
g AS (SELECT job_id, count(*) AS draft_count, CASE WHEN count(*) FILTER (found IS NULL) > 0 THEN 'drafts not found' WHEN count(*) FILTER (validation_status = 'blocked') > 0 THEN 'blocked drafts'
  WHEN count(*) FILTER (status NOT IN ('ready', 'needs_review', 'generated')) > 0 THEN 'draft status' END AS refused FROM f GROUP BY 1)"""


@query("D11", f"WITH {GATE_SQL} SELECT job_id, draft_count, refused FROM g")
def d11(t):
    return dr.submission_gate(t.stored_drafts, t.sql(REQUESTS_SQL))


@query("D11_attempts", f"""
WITH {GATE_SQL} SELECT job_id, draft_id, 'queued' AS status, 1 AS attempt_number, CASE WHEN draft_id % 2 = 0 THEN 'patched' ELSE 'base' END AS name, CAST(sale_price AS VARCHAR) AS price
FROM f WHERE job_id IN (SELECT job_id FROM g WHERE refused IS NULL)""")
def d11_attempts(t):
    drafts = t.stored_drafts.withColumns({
        "generated_payload": F.to_json(F.struct(F.lit("base").alias("name"), F.struct(F.col("sale_price").alias("price")).alias("sale"))),
        "override_patch": F.when(F.col("draft_id") % 2 == 0, F.lit('{"name":"patched","sale":{"x":1}}'))})
    made = dr.submission_attempts(drafts, t.sql(REQUESTS_SQL))
    leaf = lambda path, name: F.get_json_object("submitted_payload", path).alias(name)
    return made.select("job_id", "draft_id", "status", "attempt_number", leaf("$.name", "name"), leaf("$.sale.price", "price"))


@query("D12", """
SELECT p_partkey AS product_id, CASE WHEN p_size % 6 <> 5 THEN concat('5000', CAST(p_size AS VARCHAR)) END AS category_id, CAST(floor(p_retailprice) * 5 AS BIGINT) AS cost_price,
  CASE WHEN p_size % 10 <> 3 THEN 'Korea' END AS origin, CASE WHEN p_size % 13 = 0 THEN '' ELSE concat(CAST(p_partkey AS VARCHAR), '.jpg|two.jpg') END AS images,
  CASE WHEN p_size % 5 = 0 THEN 1 ELSE 2 END AS options FROM part""")
def d12(t):
    df = dr.extract_common(market_rows(t))
    return df.select("product_id", "category_id", "cost_price", "origin", F.array_join("image_urls", "|").alias("images"), F.size("options_used").alias("options"))
