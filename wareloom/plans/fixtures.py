"""Inputs derived from the driver tables, in SQL that Spark and the oracle engine both run unchanged."""

from __future__ import annotations

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

FIXTURES: dict[str, str] = {}

# Text of a whole number and of a product code.
KEY = "CAST(p_partkey AS VARCHAR(20))"
PRICE = "CAST(floor(p_retailprice) AS INT)"
PRICE_TEXT = f"CAST({PRICE} AS VARCHAR(20))"

# Products of two owners, whose sites share codes; some of the first owner's belong to no site.
FIXTURES["owned_parts"] = """
SELECT 1 AS user_id, CASE p_partkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE NULL END AS site_id, p_partkey AS product_id, p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part
UNION ALL
SELECT 2, CASE p_partkey % 2 WHEN 0 THEN 10 ELSE 20 END, p_partkey + 1000000000, p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"""

# Stored catalogue, with the columns that a run maintains.
FIXTURES["ledger_v1"] = f"""
SELECT product_id, user_id, site_id, concat('P-', {KEY}) AS product_code, concat('W', {KEY}) AS wholesale_product_id, p_name AS original_name, {PRICE} AS price_wholesale,
       CASE p_partkey % 4 WHEN 0 THEN '1,000,1,200,1,500' WHEN 1 THEN '740,740' ELSE {PRICE_TEXT} END AS price_wholesale_raw,
       {PRICE} * 2 AS price_retail, {PRICE} + 10 AS price_min_selling, p_brand AS origin,
       CASE p_partkey % 4 WHEN 0 THEN 'S,M,L' WHEN 1 THEN 'Black, White' ELSE NULL END AS option_values_raw,
       concat('variant ', p_type) AS variant_1, concat('standard ', p_type) AS standard_1,
       concat('https://img.example/', {KEY}, '.jpg') AS image_1, concat('<p>', p_name, '</p>') AS image_detail,
       CASE p_partkey % 7 WHEN 0 THEN '품절' WHEN 1 THEN '판매중지' ELSE '판매중' END AS wholesale_status, '2024-01-01' AS wholesale_registered_at,
       CASE p_size % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'pending' ELSE 'failed' END AS status,
       CASE WHEN p_size % 10 = 9 THEN 'removed' WHEN p_size % 10 = 8 THEN 'updated' ELSE NULL END AS change_type,
       CASE p_size % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'not_started' END AS image_status,
       CASE WHEN p_size % 4 = 0 THEN concat('processed/', {KEY}, '.jpg') ELSE NULL END AS processed_image_path,
       CASE WHEN p_size % 2 = 0 THEN 'run-0' ELSE NULL END AS import_id
FROM owned_parts"""


def _uploaded(scopes: str, price: str, name: str) -> str:
    """An upload over the stored catalogue: the PROMO line is gone, some codes are new or missing, each of the fields differs somewhere."""
    return f"""
SELECT p_partkey AS row_no, user_id, site_id,
       CASE WHEN p_partkey % 13 = 0 THEN concat('N-', {KEY}) WHEN p_partkey % 29 = 1 THEN NULL ELSE concat('P-', {KEY}) END AS product_code,
       CASE WHEN p_partkey % 31 = 2 THEN NULL ELSE concat('W', {KEY}) END AS wholesale_product_id, {name} AS original_name, {price} AS price_wholesale,
       CASE p_partkey % 4 WHEN 0 THEN '1,000,1,200,1,500' WHEN 1 THEN '740,740' ELSE CAST({price} AS VARCHAR(20)) END AS price_wholesale_raw,
       {PRICE} * 2 + CASE WHEN p_partkey % 37 = 3 THEN 1 ELSE 0 END AS price_retail, {PRICE} + CASE WHEN p_partkey % 41 = 4 THEN 11 ELSE 10 END AS price_min_selling,
       CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_brand END AS origin,
       CASE p_partkey % 4 WHEN 0 THEN 'S,M,L' WHEN 1 THEN 'Black, White' ELSE NULL END AS option_values_raw,
       concat('variant ', p_type, CASE WHEN p_partkey % 43 = 5 THEN '!' ELSE '' END) AS variant_1, concat('standard ', CASE WHEN p_partkey % 47 = 6 THEN '' ELSE p_type END) AS standard_1,
       concat('https://img.example/', {KEY}, CASE WHEN p_partkey % 19 = 0 THEN '-new.jpg' ELSE '.jpg' END) AS image_1,
       concat('<p>', p_name, CASE WHEN p_partkey % 53 = 7 THEN '<br>' ELSE '' END, '</p>') AS image_detail,
       CASE p_partkey % 7 WHEN 0 THEN '판매중' WHEN 1 THEN '판매중지' ELSE '판매중' END AS wholesale_status,
       CASE WHEN p_partkey % 59 = 8 THEN '2024-02-02' ELSE '2024-01-01' END AS wholesale_registered_at
FROM owned_parts WHERE p_type <> 'PROMO' AND ({scopes})"""


# Uploads of three of the five scopes, and a later batch of four, one of whose ledgers is empty.
FIXTURES["ledger_v2"] = _uploaded("user_id = 1 AND site_id = 10 OR user_id = 1 AND site_id IS NULL OR user_id = 2 AND site_id = 10",
                                  f"{PRICE} + CASE WHEN p_partkey % 5 = 0 THEN 100 ELSE 0 END", "CASE WHEN p_partkey % 11 = 0 THEN upper(p_name) ELSE p_name END")
FIXTURES["ledger_v3"] = _uploaded("user_id = 1 AND site_id = 10 AND p_size % 7 <> 1 OR user_id = 1 AND site_id IS NULL OR user_id = 2 AND site_id = 10",
                                  f"{PRICE} + CASE WHEN p_partkey % 5 = 0 THEN 100 WHEN p_partkey % 23 = 0 THEN 7 ELSE 0 END", "p_name")
FIXTURES["runs_v2"] = """
SELECT CASE r_regionkey WHEN 0 THEN 'run-a' WHEN 1 THEN 'run-b' ELSE 'run-c' END AS import_id, CASE WHEN r_regionkey < 2 THEN 1 ELSE 2 END AS user_id,
       CASE WHEN r_regionkey = 1 THEN NULL ELSE 10 END AS site_id FROM region WHERE r_regionkey < 3"""
FIXTURES["runs_v3"] = """
SELECT CASE r_regionkey WHEN 0 THEN 'run-d' WHEN 1 THEN 'run-e' WHEN 2 THEN 'run-f' ELSE 'run-g' END AS import_id, CASE WHEN r_regionkey IN (0, 1, 3) THEN 1 ELSE 2 END AS user_id,
       CASE r_regionkey WHEN 1 THEN NULL WHEN 3 THEN 20 ELSE 10 END AS site_id FROM region WHERE r_regionkey < 4"""

# Catalogue state rows, one owner per product.
FIXTURES["state_flags"] = f"""
SELECT concat('P-', {KEY}) AS product_code, p_partkey AS product_id,
       CASE p_size % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'pending' ELSE 'failed' END AS status,
       CASE WHEN p_size % 10 = 9 THEN 'removed' WHEN p_size % 10 = 8 THEN 'updated' ELSE NULL END AS change_type,
       CASE p_size % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'not_started' END AS image_status,
       CASE WHEN p_size % 4 = 0 THEN concat('processed/', {KEY}, '.jpg') ELSE NULL END AS processed_image_path,
       CASE WHEN p_size % 6 = 5 THEN NULL ELSE p_size % 5 END AS site_id,
       p_size % 8 AS user_id
FROM part"""

# Market mappings of products: one to three platforms each.
FIXTURES["platform_mappings"] = f"""
SELECT p_partkey AS product_id, 'naver' AS platform_name,
       CASE WHEN p_size % 4 = 0 THEN NULL ELSE concat('5000', CAST(p_size AS VARCHAR(20))) END AS category_id,
       concat('Home>', p_type) AS category_path,
       CASE WHEN p_size % 3 = 0 THEN p_name ELSE NULL END AS product_name,
       CASE p_size % 3 WHEN 0 THEN 'synced' WHEN 1 THEN 'pending_update' ELSE 'draft' END AS sync_status,
       p_size % 7 = 0 AS price_changed, p_size % 9 = 0 AS stock_changed
FROM part
UNION ALL
SELECT p_partkey, 'coupang', concat('77', CAST(p_size AS VARCHAR(20))), NULL, NULL,
       CASE WHEN p_size % 2 = 0 THEN 'pending_update' ELSE 'synced' END, false, false
FROM part WHERE p_type <> 'SMALL'
UNION ALL
SELECT p_partkey, 'smartstore', concat('9000', CAST(p_size AS VARCHAR(20))), concat('Shop>', p_name), upper(p_name),
       'draft', false, true
FROM part WHERE p_type = 'ECONOMY'"""

# Mappings of both owners' products and of products that are gone.
FIXTURES["owner_mappings"] = """
SELECT product_id, CASE user_id WHEN 1 THEN 'first owner' ELSE 'second owner' END AS kind, CASE WHEN p_size % 3 = 0 THEN 'synced' ELSE 'draft' END AS sync_status FROM owned_parts
UNION ALL SELECT p_partkey + 2000000000, 'no product', 'synced' FROM part"""

# Snapshots of product status and price over time.
FIXTURES["snapshots"] = """
SELECT event_id AS snapshot_id, user_id AS product_id, ts AS captured_at,
       CASE event_type WHEN 'error' THEN 'sold_out' WHEN 'signup' THEN NULL WHEN 'purchase' THEN 'stopped'
            ELSE 'available' END AS supplier_status,
       CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(floor(value) AS INT) END AS supply_price
FROM events"""

FIXTURES["crawl_runs"] = """
SELECT o_orderkey AS run_id, o_custkey % 100 AS supplier_id, o_orderdate AS started_at,
       CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_orderdate + INTERVAL '2' HOUR END AS finished_at,
       CASE WHEN o_orderkey % 3 = 0 THEN 'full' ELSE 'stock_check' END AS run_type,
       CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'cancelled' END AS status,
       CASE WHEN o_orderstatus = 'F' THEN concat('timeout ', o_orderpriority)
            WHEN o_orderkey % 31 = 0 THEN 'late error' ELSE NULL END AS error
FROM orders"""

FIXTURES["monitor_suppliers"] = """
SELECT s_suppkey AS supplier_id, s_name AS supplier_name, s_nationkey % 3 <> 0 AS monitor_enabled,
       6 + s_nationkey AS interval_hours
FROM supplier"""

# Stored stock changes, most of them about products of known suppliers.
FIXTURES["stock_changes"] = """
SELECT event_id AS change_id, user_id AS product_id, ts AS detected_at,
       CASE event_type WHEN 'error' THEN 'sold_out' WHEN 'signup' THEN 'restocked' WHEN 'purchase' THEN 'price_changed'
            WHEN 'click' THEN 'stock_changed' ELSE 'status_changed' END AS change_type,
       CAST(CAST(floor(value) AS INT) AS VARCHAR(20)) AS previous_value,
       CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(CAST(floor(value) AS INT) + 1 AS VARCHAR(20)) END AS new_value,
       event_id % 3 = 0 AS acknowledged
FROM events"""

# Crawled products, keyed by supplier and code.
FIXTURES["crawled_products"] = f"""
SELECT p_partkey AS product_id, p_partkey % 60 AS supplier_id,
       CASE WHEN p_partkey % 37 = 5 THEN '' ELSE concat('C-', {KEY}) END AS supplier_product_code,
       concat('SP', {KEY}) AS supplier_product_id,
       CASE WHEN p_partkey % 41 = 3 THEN NULL ELSE p_name END AS raw_product_name,
       CASE p_partkey % 6 WHEN 0 THEN 'sold_out' WHEN 1 THEN 'stopped' WHEN 2 THEN NULL ELSE 'available' END AS supplier_status,
       CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 1 THEN '' ELSE p_brand END AS origin,
       CASE WHEN p_size % 11 = 0 THEN NULL ELSE {PRICE} END AS supply_price,
       CASE WHEN p_size % 13 = 0 THEN '' ELSE concat('https://img.example/', {KEY}, '.jpg') END AS main_image_url,
       concat('<p>', p_name, '</p>') AS detail_content,
       CAST('2024-01-01' AS DATE) + p_size AS first_seen_on,
       CAST('2024-03-01' AS DATE) + p_size AS last_seen_on
FROM part"""

# Options of crawled products; (product, position) is unique.
FIXTURES["crawled_options"] = f"""
SELECT p_partkey AS product_id, 1 AS option_position, 'Black' AS option_display_name, 'Black' AS option_value_1,
       {PRICE} AS option_supply_price, concat('https://img.example/', {KEY}, '-b.jpg') AS option_main_image_url
FROM part WHERE p_type <> 'LARGE'
UNION ALL
SELECT p_partkey, 2, CASE WHEN p_size % 5 = 0 THEN '' ELSE 'White' END, CASE WHEN p_size % 10 = 0 THEN NULL ELSE 'Snow' END,
       CASE WHEN p_size % 4 = 0 THEN NULL ELSE {PRICE} + 50 END, NULL
FROM part WHERE p_type <> 'LARGE'
UNION ALL
SELECT p_partkey, 3, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'Red' END, NULL, {PRICE} + 70, ''
FROM part WHERE p_type = 'ECONOMY'"""

FIXTURES["categories"] = """
SELECT n_nationkey AS category_id, concat('네이버: ', r_name, ' > ', n_name) AS path, n_nationkey AS ord
FROM nation JOIN region ON n_regionkey = r_regionkey"""

# One run per order, with counts of what an upload changed.
FIXTURES["import_runs"] = """
SELECT o_orderkey AS import_id, o_custkey % 8 AS user_id, o_custkey % 6 AS site_id,
       concat('ledger-', CAST(o_orderkey AS VARCHAR(20)), '.csv') AS filename, o_orderdate AS created_at,
       CAST(o_orderkey % 4 AS INT) AS new_count, CAST(o_custkey % 3 AS INT) AS updated_count,
       CAST(o_orderkey % 2 AS INT) * CAST(o_custkey % 2 AS INT) AS removed_count, CAST(o_orderkey % 9 AS INT) AS unchanged_count
FROM orders"""

FIXTURES["sites"] = """
SELECT n_nationkey AS site_id, n_name AS site_name FROM nation WHERE n_regionkey <> 3"""

# An owner has four accounts.
FIXTURES["accounts"] = """
SELECT c_custkey AS account_id, CAST(floor(c_custkey / 4) AS BIGINT) AS user_id,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'smartstore' WHEN 'MACHINERY' THEN 'coupang' WHEN 'FURNITURE' THEN 'smartstore'
            ELSE 'other' END AS market_code,
       CASE WHEN c_acctbal >= 0 THEN 'connected' ELSE 'disconnected' END AS connection_status,
       c_name AS account_name
FROM customer"""

# Stored drafts: one per order, status and date taken from it.
FIXTURES["stored_drafts"] = """
SELECT o_orderkey AS draft_id, o_orderkey % 2000 AS product_id, o_custkey AS account_id, 'create' AS draft_kind,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'generated' WHEN '2-HIGH' THEN 'needs_review' WHEN '3-MEDIUM' THEN 'ready'
            WHEN '4-NOT SPECIFIED' THEN 'submitting' ELSE 'failed' END AS status,
       CASE o_orderstatus WHEN 'F' THEN 'blocked' WHEN 'O' THEN 'valid' ELSE 'warning' END AS validation_status,
       o_orderdate AS updated_at, CAST(floor(o_totalprice) AS INT) AS sale_price
FROM orders"""

# Keyword-like phrases: the distinct two-word pieces do not matter, the first words of each line do.
FIXTURES["seed_phrases"] = """
SELECT p_partkey AS product_id, p_name AS refined_name, p_name AS keyword, 'refined' AS origin FROM part
UNION ALL
SELECT p_partkey, p_name, concat(p_type, ' ', p_name), 'related' FROM part
UNION ALL
SELECT p_partkey, p_name, concat(p_name, ' ', CAST(p_size AS VARCHAR(20)), '개'), 'related' FROM part
UNION ALL
SELECT p_partkey, p_name, CASE p_size % 5 WHEN 0 THEN '무료배송 특가' WHEN 1 THEN concat('삼성 ', p_name)
       WHEN 2 THEN p_name WHEN 3 THEN 'x' ELSE concat('인기 ', p_type) END, 'related' FROM part
UNION ALL
SELECT p_partkey, p_name, concat(p_brand, ' ', p_type, ' ', p_name), 'synonym' FROM part
UNION ALL
SELECT p_partkey, p_name, lower(p_type), 'synonym' FROM part"""

# Messy values as they come out of supplier sheets.
FIXTURES["messy"] = f"""
SELECT p_partkey, p_name, p_brand, p_type, p_size, {PRICE} AS price,
       CASE p_partkey % 9 WHEN 0 THEN concat({PRICE_TEXT}, '원') WHEN 1 THEN concat('  ', {PRICE_TEXT}, '.0 ')
            WHEN 2 THEN concat({PRICE_TEXT}, '원 / 2,820원') WHEN 3 THEN '740,740,740,740' WHEN 4 THEN 'bad'
            WHEN 5 THEN '1.5.2' WHEN 6 THEN '   ' WHEN 7 THEN concat('-', {PRICE_TEXT})
            ELSE concat('1,', {PRICE_TEXT}, ' won') END AS price_text,
       CASE p_partkey % 6 WHEN 0 THEN concat('+ ', {PRICE_TEXT}, '원') WHEN 1 THEN concat('-1,', {PRICE_TEXT})
            WHEN 2 THEN 'none' WHEN 3 THEN ',' WHEN 4 THEN concat('abc ', {PRICE_TEXT}, ' def -3') ELSE NULL END AS signed_text,
       CASE p_partkey % 5 WHEN 0 THEN ' S , M,,L ' WHEN 1 THEN p_name WHEN 2 THEN ' , ,' WHEN 3 THEN NULL
            ELSE concat(p_name, ',', p_brand, ' , ', p_type) END AS csv_text,
       CASE p_partkey % 7 WHEN 0 THEN '2,640원,2,820원' WHEN 1 THEN '2640,2820' WHEN 2 THEN '740,740'
            WHEN 3 THEN '1,234,567' WHEN 4 THEN concat({PRICE_TEXT}, ',,', {PRICE_TEXT})
            WHEN 5 THEN concat('1,', {PRICE_TEXT}, ',500') ELSE NULL END AS price_list,
       CASE p_partkey % 10 WHEN 0 THEN '정상' WHEN 1 THEN ' 판매중 ' WHEN 2 THEN '일시품절' WHEN 3 THEN '중지' WHEN 4 THEN '단종'
            WHEN 5 THEN 'SOLD' WHEN 6 THEN NULL WHEN 7 THEN '품절' WHEN 8 THEN '판매중지' ELSE '' END AS status_text
FROM part"""

# Supplier sheets in three header layouts; one supplier per brand.
FIXTURES["sheet_rows"] = f"""
SELECT p_brand AS site, CAST(substr(p_brand, 7) AS INT) % 3 AS layout, p_partkey AS row_no, p_size,
       CASE CAST(substr(p_brand, 7) AS INT) % 3 WHEN 1 THEN CASE p_size % 3 WHEN 0 THEN 'on' WHEN 1 THEN 'off' ELSE NULL END
            ELSE CASE p_size % 5 WHEN 0 THEN '정상' WHEN 1 THEN '일시품절' WHEN 2 THEN ' 판매중 ' WHEN 3 THEN '이상' ELSE NULL END END AS c_status,
       concat('W', {KEY}) AS c_pid,
       CASE CAST(substr(p_brand, 7) AS INT) % 3 WHEN 1 THEN concat('[code=X', {KEY}, ']') ELSE concat('X', {KEY}) END AS c_code,
       CASE CAST(substr(p_brand, 7) AS INT) % 3 WHEN 1 THEN concat(p_name, ' !!1') ELSE p_name END AS c_name,
       CASE WHEN p_size % 2 = 1 THEN NULL WHEN CAST(substr(p_brand, 7) AS INT) % 3 = 1 THEN '(S) (M)' ELSE 'Red, Blue' END AS c_opts,
       CASE WHEN p_size % 2 = 1 THEN {PRICE_TEXT} WHEN p_size % 3 = 0 THEN '2640,2820' WHEN p_size % 3 = 1 THEN '2640' ELSE 'x,9' END AS c_price,
       '5,000' AS c_retail, concat(CAST(p_size AS VARCHAR(20)), '00원') AS c_min, p_type AS c_origin,
       concat('https://img.example/', {KEY}, '.jpg') AS c_img1, CASE WHEN p_size % 4 = 0 THEN ' ' ELSE 'two.jpg' END AS c_img2,
       concat('<p>', p_name, '</p>') AS c_detail, '2026-05-20' AS c_date
FROM part"""

# Catalogue rows as the product list shows them.
FIXTURES["catalogue"] = f"""
SELECT p_partkey AS product_id, concat('P-', {KEY}) AS product_code, p_name AS original_name, p_size % 8 AS user_id,
       CASE WHEN p_size % 6 = 5 THEN NULL ELSE p_size % 5 END AS site_id, p_partkey % 40 AS import_id,
       CASE p_size % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'pending' WHEN 2 THEN 'completed' ELSE 'failed' END AS status,
       CASE p_size % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'not_started' END AS image_status,
       CASE WHEN p_size % 9 = 0 THEN NULL ELSE {PRICE} END AS price_wholesale,
       CASE p_size % 5 WHEN 0 THEN NULL ELSE p_size % 5 END AS option_count,
       CAST('2024-01-01' AS DATE) + p_size AS created_at,
       CASE WHEN p_size % 7 = 0 THEN NULL ELSE concat(p_type, ' ', p_name) END AS refined_name,
       CASE WHEN p_size % 11 = 0 THEN NULL ELSE concat(p_name, ',', lower(p_type)) END AS keyword_list,
       CASE WHEN p_size % 13 = 0 THEN '' ELSE concat('https://img.example/', {KEY}, '.jpg') END AS image_1,
       CASE WHEN p_size % 4 = 1 THEN NULL ELSE 'https://img.example/second.jpg' END AS image_2,
       CASE WHEN p_size % 12 = 0 THEN concat('processed/', {KEY}, '.jpg') ELSE NULL END AS processed_image_path,
       p_brand AS brand_name, CASE WHEN p_size % 10 = 3 THEN NULL ELSE 'Korea' END AS origin
FROM part"""

# Shop pages composed from the products: metadata in several layouts, images, choices, an order limit.
FIXTURES["product_pages"] = f"""
SELECT p_partkey AS page_id, concat('https://shop.example/goods/view?goodsno=', {KEY}) AS url, p_size, p_name, p_brand, {PRICE} AS price,
  concat('<html><head>', CASE WHEN p_size % 5 = 0 THEN '' ELSE concat('<meta property="og:title" content="', p_name, ' &amp; co">') END,
    '<meta content=''https://img.example/', {KEY}, '.jpg'' property="og:image"><meta property="product:price:amount" content="', {PRICE_TEXT}, '">',
    CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN concat('<script type="application/ld+json">', chr(123), '"@type":"Product","name":"', p_name, '","image":["a', {KEY}, '.jpg","b.jpg"],"offers":', chr(123), '"price":"', {PRICE_TEXT}, '"', chr(125), chr(125), '</script>')
      WHEN 2 THEN concat('<script type="application/ld+json">[', chr(123), '"@type":"Thing"', chr(125), ',', chr(123), '"@type":["Product","X"],"name":"', p_name, '","image":', chr(123), '"url":"u', {KEY}, '.jpg"', chr(125), ',"offers":[', chr(123), '"price":', {PRICE_TEXT}, chr(125), ']', chr(125), ']</script>')
      ELSE concat('<script type="application/ld+json">', chr(123), '"@graph":[', chr(123), '"@type":"Product","name":"', p_name, '"', chr(125), ']', chr(125), '</script>') END,
    '</head><body><div id="main" class="goods view"><h2 class="name">상품명 : ', p_name, '</h2><p class="price">판매가 <b>', {PRICE_TEXT}, '</b>원</p><div class="gallery"><img src="/blank.gif" data-src="/img/',
    {KEY}, '_1.jpg">', CASE WHEN p_size % 2 = 0 THEN concat('<img src="/img/', {KEY}, '_2.jpg" width="100" height="80">') ELSE '' END, CASE WHEN p_size % 3 = 0 THEN concat('<a href="#"><img src="/img/icon-x.png"><img src="/img/', {KEY}, '_3.jpg" width="800"></a>') ELSE '' END,
    '</div><select name="', CASE WHEN p_size % 6 = 0 THEN 'qty' ELSE 'color' END, '"><option>옵션을 선택하세요</option><option value="1">Red</option>', CASE WHEN p_size % 2 = 1 THEN '<option value="2">Blue</option>' ELSE '' END,
    '</select><input type="hidden" name="maxq" value="', CAST(p_size % 3 AS VARCHAR(20)), '"></div><!-- <img src="no.jpg"> --></body></html>') AS html
FROM part"""
