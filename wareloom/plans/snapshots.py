"""Snapshot and monitoring queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wareloom.operators import snapshots as sn
from wareloom.operators.paging import SortedList
from wareloom.plans.fixtures import FIXTURES
from wareloom.plans.registry import query
from wareloom.session import data_folder
from wareloom.streaming.stock_watch import StockWatch

VALUES = ["supplier_status", "supply_price"]


@query("T1", """
SELECT product_id, arg_max(snapshot_id, (captured_at, snapshot_id)) AS snapshot_id, arg_max(coalesce(supplier_status, '-'), (captured_at, snapshot_id)) AS supplier_status
FROM snapshots GROUP BY product_id""")
def t1(t):
    return sn.latest(t.snapshots).select("product_id", "snapshot_id", F.coalesce("supplier_status", F.lit("-")).alias("supplier_status"))


CHANGES_SQL = """p AS (SELECT *, lag(supplier_status) OVER w AS s0, lag(supply_price) OVER w AS p0, row_number() OVER w AS rn
  FROM snapshots WINDOW w AS (PARTITION BY product_id ORDER BY captured_at, snapshot_id)),
ch AS (SELECT snapshot_id, product_id, CASE WHEN s0 = 'available' AND supplier_status = 'sold_out' THEN 'sold_out' WHEN s0 = 'sold_out' AND supplier_status = 'available' THEN 'restocked'
    ELSE 'status_changed' END AS change_type, s0 AS previous_value, supplier_status AS new_value FROM p WHERE rn > 1 AND s0 <> supplier_status
  UNION ALL SELECT snapshot_id, product_id, 'price_changed', CAST(p0 AS VARCHAR), CAST(supply_price AS VARCHAR) FROM p WHERE rn > 1 AND p0 IS DISTINCT FROM supply_price)"""
CHANGE_COLUMNS = ["snapshot_id", "product_id", "change_type", "previous_value", "new_value"]


@query("T2", f"WITH {CHANGES_SQL} SELECT * FROM ch")
def t2(t):
    return sn.detect_changes(sn.with_previous(t.snapshots, VALUES)).select(*CHANGE_COLUMNS)


STOCK_SQL = """SELECT event_id AS snapshot_id, user_id AS product_id, ts AS captured_at, CAST(NULL AS VARCHAR(9)) AS supplier_status, CAST(NULL AS INT) AS supply_price,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(floor(value) AS INT) % 5 END AS a, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id % 4 + event_id % 2 AS INT) END AS b FROM events"""


@query("T3", f"""
WITH s AS ({STOCK_SQL}), p AS (SELECT *, lag(a) OVER w AS a0, lag(b) OVER w AS b0, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY product_id ORDER BY captured_at, snapshot_id))
SELECT snapshot_id, product_id, 'A' AS option_sku, CAST(a0 AS VARCHAR) AS previous_value, CAST(a AS VARCHAR) AS new_value FROM p WHERE rn > 1 AND a IS DISTINCT FROM a0
UNION ALL SELECT snapshot_id, product_id, 'B', CAST(b0 AS VARCHAR), CAST(b AS VARCHAR) FROM p WHERE rn > 1 AND b IS DISTINCT FROM b0""")
def t3(t):
    stock = F.map_filter(F.create_map(F.lit("A"), F.col("a"), F.lit("B"), F.col("b")), lambda k, v: v.isNotNull())
    rows = t.sql(STOCK_SQL).withColumn("stock", stock)
    found = sn.detect_changes(sn.with_previous(rows, VALUES + ["stock"]), stock="stock")
    return found.select("snapshot_id", "product_id", "option_sku", "previous_value", "new_value")


@query("T4", """
WITH k AS (SELECT s.*, row_number() OVER (PARTITION BY s.product_id ORDER BY captured_at, snapshot_id) AS rn FROM snapshots s
  WHERE s.product_id IN (SELECT product_id FROM crawled_products WHERE supplier_status IS NOT NULL))
SELECT snapshot_id, product_id FROM k WHERE rn > 1""")
def t4(t):
    known = sn.known_only(t.snapshots, t.crawled_products.filter("supplier_status is not null"))
    return sn.with_previous(known, VALUES).filter("previous._present").select("snapshot_id", "product_id")


@query("T5", """
WITH l AS (SELECT product_id, arg_max(supplier_status, (captured_at, snapshot_id)) FILTER (supplier_status IS NOT NULL) AS s,
  arg_max(supply_price, (captured_at, snapshot_id)) FILTER (supply_price IS NOT NULL) AS p FROM snapshots GROUP BY product_id)
SELECT c.product_id, coalesce(s, supplier_status) AS supplier_status, coalesce(p, supply_price) AS supply_price FROM crawled_products c LEFT JOIN l USING (product_id)""")
def t5(t):
    return sn.apply_to_products(t.crawled_products, t.snapshots).select("product_id", "supplier_status", "supply_price")


@query("T6", "SELECT product_id, 'run-1' AS crawl_run_id, TIMESTAMP '2024-03-01 00:00:00' AS captured_at, supplier_status, supply_price FROM crawled_products")
def t6(t):
    return sn.baseline(t.crawled_products, "run-1", F.lit("2024-03-01").cast("timestamp_ntz"))


# Listing pages: ten links a page per customer; late pages of some listings repeat earlier links.
LINKS_SQL = """SELECT o_custkey AS category_id, CAST(extract(month FROM o_orderdate) AS INT) AS page, o_orderkey AS ord,
  CASE WHEN extract(month FROM o_orderdate) IN (4, 9) THEN '/p/repeat' ELSE concat('/p/', CAST(o_orderkey % 40 AS VARCHAR(20))) END AS url FROM orders"""


@query("T7", f"""
WITH k AS ({LINKS_SQL}), f AS (SELECT category_id, url, min((page, ord)) AS m FROM k GROUP BY 1, 2), ff AS (SELECT category_id, url, m[1] AS page, m[2] AS ord FROM f),
  st AS (SELECT category_id, min(page) AS stop FROM (SELECT DISTINCT category_id, page FROM k) q WHERE NOT EXISTS (SELECT 1 FROM ff WHERE ff.category_id = q.category_id AND ff.page = q.page) GROUP BY 1)
SELECT ff.category_id, url, page, ord FROM ff LEFT JOIN st USING (category_id) WHERE stop IS NULL OR page < stop""")
def t7(t):
    return sn.cut_pagination(t.sql(LINKS_SQL))


@query("T8", """
SELECT change_id, detected_at, m.supplier_id, supplier_name, product_id, supplier_product_code, raw_product_name, change_type,
  CASE change_type WHEN 'sold_out' THEN '품절' WHEN 'restocked' THEN '재입고' WHEN 'price_changed' THEN '가격 변경' WHEN 'stock_changed' THEN '재고 변경' ELSE '상태 변경' END AS change_label,
  coalesce(previous_value, '') AS previous_value, coalesce(new_value, '') AS new_value, acknowledged
FROM stock_changes JOIN crawled_products USING (product_id) JOIN monitor_suppliers m USING (supplier_id)""")
def t8(t):
    return feed(t)


def feed(t, **filters):
    return sn.event_feed(t.stock_changes, t.crawled_products, t.monitor_suppliers, **filters)


@query("T8_page", """
SELECT change_id, detected_at, supplier_id, change_type FROM (SELECT change_id, detected_at, m.supplier_id, change_type FROM stock_changes JOIN crawled_products USING (product_id) JOIN monitor_suppliers m USING (supplier_id)) f
ORDER BY detected_at DESC, change_id LIMIT 40 OFFSET 120""")
def t8_page(t):
    """The fourth page of the feed, each page after the last row of the one before."""
    listed = SortedList.store(feed(t).select("change_id", "detected_at", "supplier_id", "change_type"), data_folder(t.spark, f"feed-{uuid.uuid4().hex}"), {"detected_at": True, "change_id": False})
    page = listed.page(40)
    for _ in range(3):
        seen = page.collect()
        page = listed.page(40, seen[-1].asDict()) if seen else page
    return page


@query("T9", """
SELECT count(*) FILTER (NOT acknowledged) AS unread, count(*) FILTER (change_type = 'sold_out') AS sold_out, count(*) FILTER (change_type = 'restocked') AS restocked,
  count(*) FILTER (change_type = 'price_changed') AS price_changed,
  (SELECT count(*) FROM crawl_runs WHERE run_type = 'stock_check' AND status = 'failed') AS failed_checks
FROM stock_changes JOIN crawled_products USING (product_id) JOIN monitor_suppliers USING (supplier_id)""")
def t9(t):
    return sn.monitor_metrics(feed(t), t.crawl_runs)


@query("T10", """
WITH c AS (SELECT * FROM crawl_runs WHERE run_type = 'stock_check'),
f AS (SELECT supplier_id, arg_max(coalesce(finished_at, started_at), (started_at, run_id)) AS last_check_at,
  arg_max(coalesce(error, ''), (started_at, run_id)) FILTER (status = 'failed' OR error IS NOT NULL) AS latest_failure FROM c GROUP BY 1)
SELECT supplier_id, supplier_name, monitor_enabled, interval_hours, last_check_at,
  CASE WHEN monitor_enabled THEN last_check_at + to_hours(interval_hours) END AS next_check_at, coalesce(latest_failure, '') AS latest_failure
FROM monitor_suppliers LEFT JOIN f USING (supplier_id)""")
def t10(t):
    return sn.check_schedule(t.monitor_suppliers, t.crawl_runs)


@query("T11", """
SELECT change_id, acknowledged OR change_type = 'sold_out' AS acknowledged,
  CASE WHEN NOT acknowledged AND change_type = 'sold_out' THEN TIMESTAMP '2024-05-01 00:00:00' END AS acknowledged_at
FROM stock_changes""")
def t11(t):
    listed = t.stock_changes.filter("change_type = 'sold_out'")
    return sn.acknowledge(t.stock_changes, listed, F.lit("2024-05-01").cast("timestamp_ntz")).select("change_id", "acknowledged", "acknowledged_at")


@query("T12", """
SELECT supplier_id, supplier_name, last_crawl_at FROM monitor_suppliers LEFT JOIN
  (SELECT supplier_id, max(started_at) AS last_crawl_at FROM crawl_runs GROUP BY 1) r USING (supplier_id)""")
def t12(t):
    return sn.last_runs(t.monitor_suppliers, t.crawl_runs).select("supplier_id", "supplier_name", "last_crawl_at")


TREE_SQL = """SELECT concat('R', CAST(r_regionkey AS VARCHAR(20))) AS id, CAST(NULL AS VARCHAR(20)) AS parent_id, r_name AS name FROM region
UNION ALL SELECT concat('N', CAST(n_nationkey AS VARCHAR(20))), concat('R', CAST(n_regionkey AS VARCHAR(20))), n_name FROM nation
UNION ALL SELECT concat('C', CAST(c_custkey AS VARCHAR(20))), concat('N', CAST(c_nationkey AS VARCHAR(20))), c_name FROM customer
UNION ALL SELECT concat('O', CAST(o_orderkey AS VARCHAR(20))), concat('C', CAST(o_custkey AS VARCHAR(20))), o_orderpriority FROM orders
UNION ALL SELECT concat('L', CAST(l_orderkey AS VARCHAR(20))), concat('O', CAST(l_orderkey AS VARCHAR(20))), concat('lines ', CAST(count(*) AS VARCHAR(20))) FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT concat('X', CAST(l_orderkey AS VARCHAR(20))), concat('L', CAST(l_orderkey AS VARCHAR(20))), 'shipped' FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey"""


@query("T13", f"""
WITH RECURSIVE nodes AS ({TREE_SQL}),
t AS (SELECT id, parent_id, 0 AS depth, CAST(name AS VARCHAR) AS path FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT n.id, n.parent_id, depth + 1, concat(path, ' > ', name) FROM nodes n JOIN t ON n.parent_id = t.id),
up AS (SELECT parent_id AS ancestor, id FROM nodes WHERE parent_id IS NOT NULL
  UNION ALL SELECT n.parent_id, up.id FROM up JOIN nodes n ON n.id = up.ancestor WHERE n.parent_id IS NOT NULL),
c AS (SELECT ancestor AS id, count(*) AS below FROM up GROUP BY 1)
SELECT id, parent_id, depth, path, coalesce(below, 0) AS below FROM t LEFT JOIN c USING (id)""")
def t13(t):
    tree = sn.flatten_tree(t.sql(TREE_SQL))
    below = sn.descendants(tree).groupBy(F.col("ancestor_id").alias("id")).agg(F.count(F.lit(1)).alias("below"))
    return tree.join(below, "id", "left").select("id", "parent_id", "depth", "path", F.coalesce("below", F.lit(0).cast("bigint")).alias("below"))


ENTRIES_SQL = "SELECT substr(url, 1, 9) AS site, page_id AS ord, url, concat('n', CAST(page_id AS VARCHAR(20))) AS name FROM pages"


@query("T14", """
WITH i AS (SELECT substr(url, 1, 9) AS site, page_id AS ord, url, regexp_extract(url, '\\?([^#]*)', 1) AS q,
   regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages),
j AS (SELECT site, ord, url, CASE WHEN regexp_extract(q, '^[^=&]*=([^&]+)', 1) <> '' THEN regexp_extract(q, '^[^=&]*=([^&]+)', 1) ELSE regexp_extract(path, '[^/]*$') END AS cid FROM i)
SELECT site, ord, CASE WHEN ord = min(ord) OVER (PARTITION BY site, cid) THEN cid ELSE url END AS category_id FROM j""")
def t14(t):
    return sn.unique_category_ids(t.sql(ENTRIES_SQL)).select("site", "ord", "category_id")


STREAM_SQL = FIXTURES["snapshots"].replace("\nFROM events", """,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(floor(value) AS INT) % 5 END AS a, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id % 4 + event_id % 2 AS INT) END AS b
FROM events""")
KNOWN_SQL = "product_id IN (SELECT product_id FROM crawled_products WHERE supplier_status IS NOT NULL)"


@query("T15", f"""
WITH known AS (SELECT * FROM snapshots WHERE {KNOWN_SQL}), {CHANGES_SQL.replace('FROM snapshots', 'FROM known')},
s AS (SELECT * FROM ({STOCK_SQL}) q WHERE {KNOWN_SQL}), q AS (SELECT *, lag(a) OVER w AS a0, lag(b) OVER w AS b0, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY product_id ORDER BY captured_at, snapshot_id))
SELECT *, NULL AS option_sku FROM ch
UNION ALL SELECT snapshot_id, product_id, 'stock_changed', CAST(a0 AS VARCHAR), CAST(a AS VARCHAR), 'A' FROM q WHERE rn > 1 AND a IS DISTINCT FROM a0
UNION ALL SELECT snapshot_id, product_id, 'stock_changed', CAST(b0 AS VARCHAR), CAST(b AS VARCHAR), 'B' FROM q WHERE rn > 1 AND b IS DISTINCT FROM b0""")
def t15(t):
    """Four weeks arrive one after the other; each is a run of the stream that takes up where the last one ended."""
    folder = data_folder(t.spark, f"stock-watch-{uuid.uuid4().hex}")
    products = t.crawled_products.filter("supplier_status is not null").select("product_id")
    watch = StockWatch(t.spark, f"{folder}/watch", products, "stock")
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{folder}/arrived/*")
    stock = F.map_filter(F.create_map(F.lit("A"), F.col("a"), F.lit("B"), F.col("b")), lambda k, v: v.isNotNull())
    snapshots = t.spark.sql(STREAM_SQL.replace("FROM events", "FROM {events}"), events=stream).withColumn("stock", stock)
    for week in range(4):
        arrived = t.events.filter(F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3)) == week)
        arrived.write.mode("overwrite").parquet(f"{folder}/arrived/week={week}")
        watch.start(snapshots).awaitTermination()
    return watch.changes().select(*CHANGE_COLUMNS, "option_sku")
