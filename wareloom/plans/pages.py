"""Page queries over stored pages and over shop pages composed from the products."""

from __future__ import annotations

from pyspark.sql import functions as F

from wareloom.operators import pages as pg
from wareloom.plans.registry import query


@query("H1", """
SELECT page_id, CASE WHEN p_size % 8 = 0 THEN url ELSE concat_ws('|', '/blank.gif', CASE WHEN p_size % 2 = 0 THEN concat('/img/', CAST(page_id AS VARCHAR), '_2.jpg') END,
  CASE WHEN p_size % 3 = 0 THEN concat('/img/icon-x.png|/img/', CAST(page_id AS VARCHAR), '_3.jpg') END) END AS images FROM product_pages""")
def h1(t):
    detail = F.when(F.col("p_size") % 8 == 0, F.concat(F.lit(" "), "url")).otherwise(F.col("html"))
    return t.product_pages.select("page_id", F.array_join(pg.detail_images(detail), "|").alias("images"))


@query("H2", """
SELECT page_id, CASE WHEN p_size % 5 <> 0 THEN concat(p_name, ' & co') END AS og_title, concat('https://img.example/', CAST(page_id AS VARCHAR), '.jpg') AS og_image, CAST(price AS VARCHAR) AS og_price,
  CASE WHEN p_size % 4 <> 0 THEN p_name END AS ld_name, CASE p_size % 4 WHEN 1 THEN concat('a', CAST(page_id AS VARCHAR), '.jpg') WHEN 2 THEN concat('u', CAST(page_id AS VARCHAR), '.jpg') END AS ld_image,
  CASE WHEN p_size % 4 IN (1, 2) THEN CAST(price AS VARCHAR) END AS ld_price FROM product_pages""")
def h2(t):
    return t.product_pages.select("page_id", pg.structured_data(F.col("html")).alias("s")).select("page_id", "s.*")


@query("H4", "SELECT page_id, p_size % 6 <> 0 AND p_size % 2 = 1 AS options, p_size % 2 = 0 OR p_size % 3 = 0 AS images FROM product_pages")
def h4(t):
    return pg.evidence(t.nodes("product_pages"), t.product_pages)


LINKS_SQL = """WITH n AS (SELECT page_id, url, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="([^"]*)"', 1) AS hrefs FROM pages),
e AS (SELECT page_id, url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS ord FROM n)"""


@query("H5", f"""
{LINKS_SQL} SELECT page_id, CAST(ord AS INT) AS ord, concat(regexp_extract(url, '^(https?://[^/?#]*)', 1), href) AS url FROM e""")
def h5(t):
    return pg.product_links(t.nodes("pages"), t.pages, "nav a")


PAGE_FIELDS = {
    "raw_product_name": {"selector": "article h1"},
    "links": {"selector": "nav li a", "attribute": "href", "multiple": True, "skip_first": 1},
    "supplier_product_code": {"selector": ".missing", "fallback_from": "url", "url_pattern": "/([0-9]+)"},
    "origin": {"selector": "", "fallback": " Korea "},
    "ad": {"selector": "div.ad", "html": True},
    "brand": {"selector": "div > p:first-child", "fallback": "none"},
}


@query("H6", """
WITH i AS (SELECT page_id, url, html, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="([^"]*)"', 1) AS hrefs FROM pages)
SELECT page_id, 'raw_product_name' AS field, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;?', '&', 'g')) AS shown FROM i
UNION ALL SELECT page_id, 'brand', 'none unsupported selector: div > p:first-child' FROM i
UNION ALL SELECT page_id, 'links', array_to_string(hrefs[2:], '|') FROM i
UNION ALL SELECT page_id, 'supplier_product_code', regexp_extract(url, '/([0-9]+)', 1) FROM i UNION ALL SELECT page_id, 'origin', 'Korea' FROM i
UNION ALL SELECT page_id, 'ad', trim(regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1)) FROM i""")
def h6(t):
    return pg.extract_fields(t.nodes("pages"), t.pages, PAGE_FIELDS).select("page_id", "field", F.concat_ws(" ", F.array_join("values", "|"), "problem").alias("shown"))


@query("H7", """
SELECT page_id, concat('/img/', k, '_1.jpg', CASE WHEN p_size % 3 = 0 THEN concat('|/img/', k, '_3.jpg') ELSE '' END) AS images FROM (SELECT *, CAST(page_id AS VARCHAR) AS k FROM product_pages) p""")
def h7(t):
    found = pg.collect_images(t.nodes("product_pages"), t.product_pages, "#main .gallery")
    return found.select("page_id", F.array_join("images", "|").alias("images"))


SHOP_FIELDS = {
    "raw_product_name": {"selector": "h2.name"}, "supply_price": {"selector": ".price b", "transform": "extract_number"},
    "option_values": {"selector": "select[name=color] option[value='2']"}, "detail_content": {"selector": ".detail"},
    "supplier_status": {"selector": ".stock", "fallback_from": "maxq"}, "brand_name": {"selector": "div > span"}, "main_image_url": {"selector": ".gallery img", "attribute": "src"},
}


@query("H8", """
SELECT 'raw_product_name' AS field, count(*) AS pages, count(*) AS ok_pages FROM product_pages UNION ALL SELECT 'supply_price', count(*), count(*) FROM product_pages
UNION ALL SELECT 'option_values', count(*), count(*) FILTER (p_size % 6 <> 0 AND p_size % 2 = 1) FROM product_pages UNION ALL SELECT 'detail_content', count(*), 0 FROM product_pages
UNION ALL SELECT 'main_image_url', count(*), count(*) FROM product_pages UNION ALL SELECT 'product_link', count(*), count(*) FILTER (p_size % 3 = 0) FROM product_pages""")
def h8(t):
    return pg.audit_extractors(t.nodes("product_pages"), t.product_pages, SHOP_FIELDS, link_selector=".gallery a[href]")
