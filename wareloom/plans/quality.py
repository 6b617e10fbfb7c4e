"""Quality-audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wareloom import constants as K
from wareloom.operators import quality as qa
from wareloom.plans.registry import query

MISSING = {f: f"({f} IS NULL OR CAST({f} AS VARCHAR) = '')" for f in qa.BLOCKING + qa.ADVISORY}
COUNTS_SQL = ", ".join(f"count(*) FILTER ({sql}) AS missing_{f}" for f, sql in MISSING.items())
SUMMARY_SQL = f"""SELECT count(*) AS product_count, {COUNTS_SQL}, max(last_seen_on) AS last_seen, (SELECT count(*) FROM crawled_options) AS option_count FROM crawled_products"""
ISSUES_SQL = " UNION ALL ".join(
    f"SELECT '{'error' if f in qa.BLOCKING else 'warning'}' AS severity, 'missing_{f}' AS code, product_id, coalesce(supplier_product_code, '') AS product_code FROM crawled_products WHERE {sql}"
    for f, sql in MISSING.items())


@query("Q1", f"""
WITH s AS ({SUMMARY_SQL}) SELECT product_count, option_count, missing_raw_product_name + missing_supplier_product_code + missing_supplier_status AS blocking_count,
  missing_origin + missing_supply_price + missing_main_image_url AS warning_count, CAST(last_seen AS VARCHAR) AS last_seen FROM s""")
def q1(t):
    return qa.export_summary(t.crawled_products, t.crawled_options).select(
        "product_count", "option_count", "blocking_count", "warning_count", F.col("last_seen").cast("string").alias("last_seen"))


@query("Q2", f"""
WITH i AS ({ISSUES_SQL}), f AS (SELECT * FROM i ORDER BY severity <> 'error', product_code, code, product_id LIMIT 50)
SELECT severity, code, product_id, product_code, CAST(0 AS BIGINT) AS hidden FROM f
UNION ALL SELECT CASE WHEN count(*) FILTER (severity = 'error') > 50 THEN 'error' ELSE 'warning' END, 'more_issues', NULL, '', count(*) - 50 FROM i HAVING count(*) > 50""")
def q2(t):
    return qa.issue_list(t.crawled_products, t.crawled_options)


@query("Q3", f"""
WITH s AS ({SUMMARY_SQL}), i AS ({ISSUES_SQL}),
d AS (SELECT CAST(sum(CAST(concat('0x', substr(md5(concat_ws('~', severity, code, CAST(product_id AS VARCHAR), product_code)), 1, 15)) AS HUGEINT)) AS VARCHAR) AS digest FROM i)
SELECT sha256(concat_ws('~', 'all', product_count, option_count, missing_raw_product_name, missing_supplier_product_code, missing_supplier_status, missing_origin,
  missing_supply_price, missing_main_image_url, last_seen, digest)) AS fingerprint FROM s, d""")
def q3(t):
    return qa.scope_fingerprint(t.crawled_products, t.crawled_options)


# Extraction results in long form: one row per sampled page and field; a source is a supplier.
RESULTS_SQL = """SELECT supplier_id AS source, product_id AS ord, concat('https://shop.example/p?id=', CAST(product_id AS VARCHAR(20))) AS url, field, value,
  CASE WHEN field = 'detail_content' THEN images END AS images FROM (
SELECT product_id, supplier_id, 'raw_product_name' AS field, CASE WHEN supplier_id % 9 = 4 THEN 'same name' WHEN supplier_id % 7 = 2 THEN '이름 없음' ELSE raw_product_name END AS value, 0 AS images FROM crawled_products
UNION ALL SELECT product_id, supplier_id, 'supply_price', CASE WHEN product_id % 5 = 0 THEN '문의' ELSE concat(CAST(supply_price AS VARCHAR(20)), '원') END, 0 FROM crawled_products
UNION ALL SELECT product_id, supplier_id, 'main_image_url', main_image_url, 0 FROM crawled_products WHERE supplier_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000)
UNION ALL SELECT product_id, supplier_id, 'supplier_product_code', CASE WHEN supplier_id % 8 = 1 THEN raw_product_name WHEN supplier_id % 8 = 2 THEN concat('https://shop.example/p?id=', CAST(product_id AS VARCHAR(20))) ELSE supplier_product_code END, 0 FROM crawled_products
UNION ALL SELECT product_id, supplier_id, 'origin', CASE WHEN product_id % 3 = 0 THEN '상품명 : x' WHEN product_id % 3 = 1 THEN concat(origin, '  a very long text that is no origin') ELSE origin END, 0 FROM crawled_products
UNION ALL SELECT product_id, supplier_id, 'detail_content', detail_content, CAST(product_id % 2 AS INT) FROM crawled_products
UNION ALL SELECT product_id, supplier_id, 'supplier_status', supplier_status, 0 FROM crawled_products) r"""
OK_SQL = f"""SELECT *, CASE field WHEN 'raw_product_name' THEN v <> '' AND v <> '이름 없음' WHEN 'supply_price' THEN regexp_matches(v, '[0-9]')
  WHEN 'main_image_url' THEN v <> '' AND (contains(v, '/') OR contains(v, '.')) WHEN 'detail_content' THEN images > 0
  WHEN 'origin' THEN v <> '' AND length(regexp_replace(v, '\\s+', ' ', 'g')) <= 30 AND NOT regexp_matches(v, '{K.ORIGIN_NOISE}')
  WHEN 'supplier_product_code' THEN v <> '' AND v <> url AND NOT regexp_matches(v, '^https?://') ELSE v <> '' END AS ok
  FROM (SELECT *, trim(coalesce(value, '')) AS v FROM ({RESULTS_SQL}) z) y"""


def results(t):
    return t.sql(RESULTS_SQL)


@query("Q4", f"SELECT source, ord, field, ok FROM ({OK_SQL}) x")
def q4(t):
    return results(t).select("source", "ord", "field", qa.value_ok(F.col("field"), F.col("value"), F.col("url"), F.col("images")).alias("ok"))


SUMMARY5_SQL = f"""f AS (SELECT source, field, count(*) FILTER (ok) AS passed, count(*) AS total FROM ({OK_SQL}) x GROUP BY 1, 2),
k AS (SELECT DISTINCT source, unnest(['raw_product_name', 'supply_price', 'main_image_url', 'supplier_product_code']) AS field FROM f),
b AS (SELECT source, field, coalesce(passed, 0) AS passed, coalesce(total, 0) AS total, k.field IS NOT NULL AS key FROM f FULL JOIN k USING (source, field)),
g AS (SELECT *, total > 0 AND passed >= CASE WHEN total <= 1 THEN 1 WHEN total <= 3 THEN 2 ELSE greatest(1, CAST(floor(total::DOUBLE * 0.67::DOUBLE + 0.999::DOUBLE) AS INT)) END AS ok,
   field IN (SELECT unnest(['raw_product_name', 'supply_price', 'main_image_url', 'supplier_product_code'])) AS is_key FROM b)"""
ROLE_SQL = "CASE WHEN NOT ok AND is_key THEN 'blocks' WHEN NOT ok AND field IN ('supplier_status', 'origin', 'detail_content', 'extra_image_urls') THEN 'warns' END"


@query("Q5", f"WITH {SUMMARY5_SQL} SELECT source, field, passed, total, ok, {ROLE_SQL} AS role FROM g")
def q5(t):
    return qa.field_summary(results(t))


@query("Q5_gate", f"""
WITH {SUMMARY5_SQL}, c AS (SELECT source, count(*) FILTER (NOT ok AND is_key) AS failed FROM g GROUP BY 1),
r AS (SELECT s_suppkey AS source, CASE WHEN failed IS NULL THEN 'missing' WHEN s_nationkey % 5 = 0 THEN 'stale' WHEN failed > 0 THEN 'failed' ELSE 'none' END AS reason
  FROM supplier LEFT JOIN c ON c.source = s_suppkey)
SELECT source, reason, reason <> 'none' AS should_warn FROM r""")
def q5_gate(t):
    sources = t.supplier.select(F.col("s_suppkey").alias("source"), (F.col("s_nationkey") % 5 == 0).alias("stale"))
    return qa.save_gate(sources, results(t))


@query("Q6", f"""
WITH f AS (SELECT source, field, count(*) FILTER (ok) AS passed, count(*) AS n, count(nullif(v, '')) AS filled, count(DISTINCT nullif(v, '')) AS kinds FROM ({OK_SQL}) x GROUP BY 1, 2),
u AS (SELECT source, url, max(v) FILTER (field = 'supplier_product_code') AS c, max(v) FILTER (field = 'raw_product_name') AS m FROM ({OK_SQL}) x GROUP BY 1, 2),
e AS (SELECT source, count(*) FILTER (c <> '' AND m <> '') AS n2, count(*) FILTER (c <> '' AND c = m) AS same FROM u GROUP BY 1)
SELECT source, field, CASE WHEN passed < greatest(1, ceil(n / 2.0)) THEN 'majority'
   WHEN field IN ('raw_product_name', 'supplier_product_code', 'main_image_url') AND filled >= 3 AND kinds = 1 THEN 'constant' END AS failure,
  n2 > 0 AND same >= greatest(1, ceil(n2 / 2.0)) AS code_is_name
FROM f JOIN e USING (source)""")
def q6(t):
    rows = results(t)
    return qa.sample_failures(rows).join(qa.code_equals_name(rows), "source")


@query("Q7", f"""
WITH s AS (SELECT concat('https://shop.example/p?id=', CAST(p_partkey AS VARCHAR)) AS url, p_name, p_size, CAST(floor(p_retailprice) AS INT) AS price, p_partkey FROM part)
SELECT source, x.url, field, v <> '' AND CASE field WHEN 'raw_product_name' THEN p_size % 4 <> 0 AND len(list_intersect(regexp_extract_all(lower(v), '[0-9a-z가-힣]+'), regexp_extract_all(lower(CASE WHEN p_size % 3 = 0 THEN 'Other Thing' ELSE p_name END), '[0-9a-z가-힣]+'))) = 0
    WHEN 'supply_price' THEN coalesce(TRY_CAST(regexp_extract(replace(v, ',', ''), '[0-9][0-9.]*') AS DOUBLE) <> price + CASE WHEN p_size % 5 = 0 THEN 10 ELSE 0 END, false) ELSE false END AS fails,
  v <> '' AND field = 'main_image_url' AND p_size % 2 = 0 AS confirmed
FROM ({OK_SQL}) x JOIN s ON s.url = x.url WHERE field IN ('raw_product_name', 'supply_price', 'main_image_url')""")
def q7(t):
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    price = F.floor("p_retailprice").cast("int") + F.when(size % 5 == 0, 10).otherwise(0)
    structured = t.part.select(
        F.concat(F.lit("https://shop.example/p?id="), key).alias("url"),
        F.when(size % 4 == 0, F.lit(" ")).when(size % 3 == 0, F.lit("Other Thing")).otherwise(F.col("p_name")).alias("og_title"), F.lit(None).cast("string").alias("ld_name"),
        F.when(size % 2 == 0, F.concat(F.lit("http://cdn/x/"), key, F.lit(".jpg?w=9"))).otherwise(F.lit("zz.jpg")).alias("og_image"), F.lit(None).cast("string").alias("ld_image"),
        F.lit("1").alias("og_price"), F.format_number(price, 0).alias("ld_price"))
    return qa.structured_check(results(t), structured)


URLS_SQL = """SELECT p_partkey % 60 AS source, p_partkey AS ord, concat('https://s.example/view', CASE p_partkey % 60 % 5
  WHEN 0 THEN concat('?type=O&goodsNo=', CAST(p_partkey AS VARCHAR(20)), '&page=', CAST(p_size AS VARCHAR(20)))
  WHEN 1 THEN concat('?ref=', p_name, '&k=', CAST(p_partkey AS VARCHAR(20))) WHEN 2 THEN concat('?w=', p_type, '&a=&a=2&u=', p_brand)
  WHEN 3 THEN CASE WHEN p_size % 3 = 0 THEN concat('?id=', CAST(p_partkey AS VARCHAR(20))) ELSE '?z=1' END ELSE '/plain' END) AS url FROM part"""


@query("Q8", f"""
WITH u AS ({URLS_SQL}), n AS (SELECT source, count(*) AS n FROM u GROUP BY 1), s AS (SELECT source, ord, url, string_split(string_split(url, '?')[2], '&') AS parts FROM u WHERE contains(url, '?')),
e AS (SELECT source, ord, unnest(parts) AS kv, generate_subscripts(parts, 1) AS i FROM s), v AS (SELECT source, ord, split_part(kv, '=', 1) AS name, split_part(kv, '=', 2) AS val, i FROM e),
o AS (SELECT source, ord, name, arg_min(val, i) AS val, min(i) AS i FROM v WHERE val <> '' GROUP BY 1, 2, 3),
f AS (SELECT source, name, count(*) AS seen, count(DISTINCT val) AS kinds, bool_and(regexp_matches(val, '^[0-9]+$')) AS digits, min((ord, i)) AS first FROM o GROUP BY 1, 2),
c AS (SELECT source, name, (CASE WHEN list_position({list(K.CODE_PARAMETERS)}, lower(name)) > 0 THEN list_position({list(K.CODE_PARAMETERS)}, lower(name)) ELSE 999 END, CASE WHEN digits THEN 0 ELSE 1 END, first[1], first[2]) AS pref
  FROM f JOIN n USING (source) WHERE seen >= greatest(1, ceil(n / 2.0)) AND kinds >= 2)
SELECT source, arg_min(name, pref) AS param FROM c GROUP BY source""")
def q8(t):
    return qa.code_parameter(t.sql(URLS_SQL))


LINKS_SQL = """SELECT p_partkey % 60 AS source, p_partkey AS ord, concat('https://s.example', CASE p_partkey % 60 % 4
    WHEN 0 THEN CASE WHEN p_size % 3 = 0 THEN '/Goods/view/' WHEN p_size % 3 = 1 THEN '/board/list' ELSE concat('/other/', CAST(p_size AS VARCHAR(20))) END
    WHEN 1 THEN concat('/x/', CAST(p_partkey AS VARCHAR(20))) WHEN 2 THEN '/item/detail' ELSE CASE WHEN p_size % 2 = 0 THEN '/cart/item' ELSE '/event/one' END END,
    '?', CASE WHEN p_size % 7 = 0 THEN 'cate=' ELSE 'pid=' END, CAST(p_partkey % 500 AS VARCHAR(20))) AS url,
  CASE WHEN p_size % 2 = 0 THEN 'a.jpg' ELSE '' END AS image_url, CASE WHEN p_size % 5 = 0 THEN '배송비 결제' WHEN p_size % 5 = 1 THEN NULL ELSE p_name END AS name FROM part"""
REFS_SQL = """SELECT DISTINCT p_partkey % 60 AS source, CASE p_partkey % 60 % 4 WHEN 0 THEN CASE WHEN p_partkey % 60 % 8 = 0 THEN NULL ELSE 'https://s.example/goods/view?pid=1' END
  WHEN 1 THEN 'https://s.example/nothing?pid=3' WHEN 2 THEN NULL ELSE 'https://s.example/cart/item?q=1' END AS reference_url FROM part"""
PQ = "lower(regexp_extract({0}, '^https?://[^/?#]*(.*)$', 1))"
PATH = "lower(regexp_replace(regexp_extract({0}, '^https?://[^/?#]*([^?#]*)', 1), '/+$', ''))"


@query("Q9", f"""
WITH l AS ({LINKS_SQL}), r AS ({REFS_SQL}),
j AS (SELECT l.*, reference_url, {PQ.format('url')} AS pq, coalesce({PQ.format('reference_url')}, '') AS rf, {PATH.format('url')} AS path,
  coalesce({PATH.format('url')} = {PATH.format('reference_url')}, false) AS same, coalesce(contains(url, '?pid=') AND contains(reference_url, '?pid='), false) AS shared FROM l JOIN r USING (source)),
b AS (SELECT * FROM j WHERE len(list_filter({list(K.NON_PRODUCT_FRAGMENTS)}, lambda w: contains(pq, w) AND NOT contains(rf, w))) = 0),
g AS (SELECT source, path, count(*) AS k, min(ord) AS o FROM b GROUP BY 1, 2), top AS (SELECT source, arg_max(path, (k, -o)) AS tp, max(k) AS tk FROM g GROUP BY 1),
n AS (SELECT source, count(*) AS n, count(*) FILTER (same) AS ns, count(*) FILTER (same OR shared) AS nn FROM b GROUP BY 1),
k AS (SELECT * FROM b JOIN n USING (source) JOIN top USING (source) WHERE CASE WHEN reference_url IS NOT NULL THEN CASE WHEN ns >= 2 THEN same WHEN nn > 0 THEN same OR shared ELSE true END
   ELSE tk * 2 < n OR path = tp END AND NOT regexp_matches(coalesce(name, ''), '{K.NON_PRODUCT_NAMES}')),
s AS (SELECT source, url, ord, coalesce(name, '{K.UNNAMED}') AS name, CASE WHEN image_url <> '' THEN 2 ELSE 0 END + CASE WHEN name IS NOT NULL THEN 1 ELSE 0 END AS score FROM k),
d AS (SELECT *, row_number() OVER (PARTITION BY source, url ORDER BY score DESC, ord) AS q FROM s),
e AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, ord) AS rank FROM d WHERE q = 1)
SELECT source, CAST(rank AS INT) AS rank, url, name, score FROM e WHERE rank <= 15""")
def q9(t):
    return qa.candidate_links(t.sql(LINKS_SQL), t.sql(REFS_SQL))


BUTTONS_SQL = """SELECT s_suppkey AS source, 'available' AS side, 1 AS ord, '<a>' AS html, 'Home' AS text FROM supplier
UNION ALL SELECT s_suppkey, 'soldout', 1, '<a>', ' home ' FROM supplier
UNION ALL SELECT s_suppkey, 'available', 2, concat('<img src="/b/x', CAST(s_suppkey AS VARCHAR(20)), '.gif?v=1">'), '' FROM supplier WHERE s_nationkey % 3 <> 0
UNION ALL SELECT s_suppkey, 'available', 3, '<button>', '장바구니' FROM supplier WHERE s_nationkey % 4 = 0
UNION ALL SELECT s_suppkey, 'soldout', 2, concat('<img src="/z/X', CAST(s_suppkey AS VARCHAR(20)), '.gif">'), '' FROM supplier WHERE s_nationkey % 5 = 0
UNION ALL SELECT s_suppkey, 'available', 4, '<i>', '' FROM supplier WHERE s_nationkey % 6 = 0
UNION ALL SELECT s_suppkey, 'available', 5, concat('<b data="', repeat('x', 150), '1">'), '' FROM supplier WHERE s_nationkey % 11 = 3
UNION ALL SELECT s_suppkey, 'soldout', 5, concat('<b data="', repeat('x', 150), '2">'), '' FROM supplier WHERE s_nationkey % 11 = 3"""


@query("Q10", """
WITH p AS (SELECT s_suppkey AS source, s_nationkey % 7 = 0 AS lim, s_nationkey % 3 <> 0 AND s_nationkey % 5 <> 0 AS img, s_nationkey % 4 = 0 AS cart, s_nationkey % 6 = 0 OR s_nationkey % 11 = 3 AS bare FROM supplier)
SELECT source, CASE WHEN lim THEN 'limit' WHEN img OR cart OR bare THEN 'button' END AS rule,
  CASE WHEN lim THEN '' WHEN cart THEN 'button:has-text(''장바구니'')' WHEN img THEN concat('img[src*=''x', CAST(source AS VARCHAR), '.gif'']') WHEN bare THEN '' END AS selector,
  CASE WHEN lim OR cart OR img THEN 'high' WHEN bare THEN 'medium' END AS confidence FROM p""")
def q10(t):
    pages = t.sql("SELECT s_suppkey AS source, '5' AS available_limit, CASE WHEN s_nationkey % 7 = 0 THEN ' 0' ELSE NULL END AS soldout_limit FROM supplier")
    return qa.status_rule(pages, t.sql(BUTTONS_SQL))


@query("Q11", f"""
SELECT DISTINCT source, url FROM ({RESULTS_SQL}) z WHERE (field = 'origin' AND ord = source + 60) OR (field = 'supply_price' AND ord = source + 240)""")
def q11(t):
    pairs = results(t).select("source", "field").distinct().filter("field IN ('origin', 'supply_price')")
    bad = F.when(F.col("field") == "origin", F.array(F.col("source") + 60, F.lit(-1).cast("bigint"), F.lit(10**9).cast("bigint"))).otherwise(F.array(F.col("source") + 240))
    return qa.bad_sample_urls(pairs.withColumn("bad_samples", bad), results(t))


@query("Q12", """
SELECT 'draft' AS kind, product_id, CAST(account_id AS VARCHAR) AS owner, count(*) AS n FROM stored_drafts GROUP BY product_id, account_id, draft_kind HAVING count(*) > 1
UNION ALL SELECT 'mapping', l_partkey, l_returnflag, count(*) FROM lineitem GROUP BY 2, 3 HAVING count(*) > 1""")
def q12(t):
    active = t.stored_drafts.filter(F.col("status").isin(*K.ACTIVE_DRAFT_STATUSES))
    drafts = qa.violations(active, ["product_id", "account_id", "draft_kind"]).select(
        F.lit("draft").alias("kind"), "product_id", F.col("account_id").cast("string").alias("owner"), "n")
    pairs = t.lineitem.select(F.col("l_partkey").alias("product_id"), F.col("l_returnflag").alias("owner"))
    return drafts.unionByName(qa.violations(pairs, ["product_id", "owner"]).select(F.lit("mapping").alias("kind"), "product_id", "owner", "n"))


@query("Q13", """
WITH c AS (SELECT o_custkey AS source, concat('s', CAST(o_orderkey % 6 AS VARCHAR)) AS selector, min(o_orderkey) AS ord FROM orders GROUP BY 1, 2),
n AS (SELECT o_custkey AS source, concat('s', CAST(o_orderkey % 6 AS VARCHAR)) AS selector, count(*) AS matches FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2)
SELECT source, arg_min(selector, (CASE WHEN matches = 1 THEN 0 WHEN matches BETWEEN 1 AND 5 THEN 1 ELSE 2 END, ord)) AS selector FROM c LEFT JOIN n USING (source, selector) GROUP BY source""")
def q13(t):
    named = t.orders.select(F.col("o_custkey").alias("source"), F.concat(F.lit("s"), (F.col("o_orderkey") % 6).cast("string")).alias("selector"), "o_orderkey", "o_orderstatus")
    candidates = named.groupBy("source", "selector").agg(F.min("o_orderkey").alias("ord"))
    counts = named.filter("o_orderstatus <> 'P'").groupBy("source", "selector").agg(F.count(F.lit(1)).alias("matches"))
    return qa.choose_selector(candidates, counts)
