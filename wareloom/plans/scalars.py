"""Scalar-column queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wareloom import constants as K
from wareloom.functions import documents as docs
from wareloom.functions import numbers as num
from wareloom.functions import option_text as opt
from wareloom.functions import status as st
from wareloom.functions import text as tx
from wareloom.functions import urls as ur
from wareloom.plans.registry import query


def joined(c, sep="|"):
    return F.array_join(c, sep)


def case_map(column: str, mapping: dict[str, str], otherwise: str = "NULL") -> str:
    """A SQL CASE that translates through a fixed dictionary."""
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {otherwise} END"


@query("SC1", """
SELECT doc_id, nullif(regexp_replace(concat(chr(9), text, chr(10), ' '), '^\\s+|\\s+$', '', 'g'), '') AS cleaned,
       lang = 'en' OR trim(source) = '' AS blank_flag
FROM documents""")
def sc1(t):
    padded = F.concat(F.lit("\t"), F.col("text"), F.lit("\n "))
    maybe = F.when(F.col("lang") == "en", F.lit(" \t\n ")).otherwise(F.col("source"))
    return t.documents.select("doc_id", tx.clean_text(padded).alias("cleaned"), tx.is_blank(maybe).alias("blank_flag"))


@query("SC2", f"""
SELECT p_partkey, {case_map("trim(status_text)", K.STATUS_SPELLINGS)} AS status,
       coalesce({case_map("trim(status_text)", K.STATUS_SPELLINGS)}, '') NOT IN ('품절', '판매중지', '단종') AS usable
FROM messy""")
def sc2(t):
    status = st.ledger_status(F.col("status_text"))
    return t.messy.select("p_partkey", status.alias("status"), st.is_available(status).alias("usable"))


INT_PRICE_SQL = """CASE WHEN regexp_matches({0}, '[0-9][^/]*/[^/]*[0-9]') THEN NULL
 WHEN TRY_CAST(regexp_replace({0}, '[^0-9.]', '', 'g') AS DOUBLE) <= 2147483647
 THEN CAST(floor(TRY_CAST(regexp_replace({0}, '[^0-9.]', '', 'g') AS DOUBLE)) AS INT) END"""


@query("SC3", f"SELECT p_partkey, {INT_PRICE_SQL.format('price_text')} AS price FROM messy")
def sc3(t):
    return t.messy.select("p_partkey", num.int_price(F.col("price_text")).alias("price"))


@query("SC4", """
SELECT p_partkey, TRY_CAST(replace(replace(regexp_extract(signed_text, '[+-]?\\s*[0-9,]+'), ' ', ''), ',', '') AS BIGINT) AS amount
FROM messy""")
def sc4(t):
    return t.messy.select("p_partkey", num.signed_int(F.col("signed_text")).alias("amount"))


@query("SC5", """
SELECT p_partkey, coalesce(array_to_string(list_filter(list_transform(string_split(csv_text, ','), lambda x: trim(x)), lambda x: x <> ''), '|'), '') AS parts
FROM messy""")
def sc5(t):
    return t.messy.select("p_partkey", joined(tx.split_csv(F.col("csv_text"))).alias("parts"))


@query("SC6", """
SELECT p_partkey, coalesce(array_to_string(list_filter(list_transform(
    regexp_extract_all(price_list, '[0-9]{1,3}(?:,[0-9]{3})+[^,]*|[^,]+'), lambda x: trim(x)), lambda x: x <> ''), '|'), '') AS prices
FROM messy""")
def sc6(t):
    return t.messy.select("p_partkey", joined(tx.split_prices(F.col("price_list"))).alias("prices"))


@query("SC7", """
SELECT p_partkey, concat_ws('|', nullif(trim(csv_text), ''), nullif(trim(status_text), ''), p_name, nullif(trim(price_text), ''), p_brand) AS images
FROM messy""")
def sc7(t):
    slots = [tx.clean_text(F.col(c)) for c in ("csv_text", "status_text", "p_name", "price_text", "p_brand")]
    return t.messy.select("p_partkey", joined(F.array_compact(F.array(*slots))).alias("images"))


@query("SC8", """
SELECT event_id, concat('{"ts":"', strftime(ts, '%Y-%m-%dT%H:%M:%S'), CASE WHEN extract('us' FROM ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END,
   '","event_type":"', event_type, '","note":"', CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END, '"}') AS raw
FROM events""")
def sc8(t):
    note = F.when(F.col("event_id") % 3 == 0, F.col("event_type"))
    row = F.struct(tx.iso_timestamp(F.col("ts")).alias("ts"), F.coalesce("event_type", F.lit("")).alias("event_type"),
                   F.coalesce(tx.clean_text(note), F.lit("")).alias("note"))
    return t.events.select("event_id", F.to_json(row).alias("raw"))


SC9_INPUT = """
SELECT p_partkey,
  CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN concat('{"supplier_warnings":["', p_name, '"]}')
    WHEN 2 THEN concat('{"warnings":["', p_name, '","x"],"processing_warnings":["old"]}') WHEN 3 THEN '["bare"]'
    WHEN 4 THEN '{"supplier_warnings":"single"}' ELSE '{}' END AS existing
FROM part"""


@query("SC9", f"""
WITH i AS (SELECT p_partkey, p_size % 2 AS has_new FROM part)
SELECT p_partkey, CASE p_partkey % 6
  WHEN 0 THEN CASE WHEN has_new = 0 THEN NULL ELSE '{{"warnings":["new"],"processing_warnings":["new"]}}' END
  WHEN 1 THEN CASE WHEN has_new = 0 THEN concat('{{"warnings":["', p_name, '"],"supplier_warnings":["', p_name, '"]}}')
     ELSE concat('{{"warnings":["', p_name, '","new"],"supplier_warnings":["', p_name, '"],"processing_warnings":["new"]}}') END
  WHEN 2 THEN CASE WHEN has_new = 0 THEN concat('{{"warnings":["', p_name, '","x","old"],"supplier_warnings":["', p_name, '","x"],"processing_warnings":["old"]}}')
     ELSE concat('{{"warnings":["', p_name, '","x","old","new"],"supplier_warnings":["', p_name, '","x"],"processing_warnings":["old","new"]}}') END
  WHEN 3 THEN CASE WHEN has_new = 0 THEN '{{"warnings":["bare"],"supplier_warnings":["bare"]}}'
     ELSE '{{"warnings":["bare","new"],"supplier_warnings":["bare"],"processing_warnings":["new"]}}' END
  WHEN 4 THEN CASE WHEN has_new = 0 THEN '{{"warnings":["single"],"supplier_warnings":["single"]}}'
     ELSE '{{"warnings":["single","new"],"supplier_warnings":["single"],"processing_warnings":["new"]}}' END
  ELSE CASE WHEN has_new = 0 THEN NULL ELSE '{{"warnings":["new"],"processing_warnings":["new"]}}' END END AS merged
FROM i JOIN part USING (p_partkey)""")
def sc9(t):
    src = t.sql(SC9_INPUT).join(t.part.select("p_partkey", "p_size"), "p_partkey")
    added = F.when(F.col("p_size") % 2 == 1, F.array(F.lit('"new"'))).otherwise(tx.no_texts())
    quoted = docs.merge_warnings(F.col("existing"), added)
    return src.select("p_partkey", quoted.alias("merged"))


@query("SC10", """
SELECT p_partkey, concat_ws(' / ', nullif(trim(p_name), ''), nullif(trim(csv_text), ''), nullif(trim(status_text), '')) AS display_name,
       CASE WHEN p_size % 3 = 0 THEN NULL ELSE price + p_size END - CASE WHEN p_size % 4 = 0 THEN NULL ELSE price END AS delta
FROM messy""")
def sc10(t):
    option = F.when(F.col("p_size") % 3 != 0, F.col("price") + F.col("p_size"))
    base = F.when(F.col("p_size") % 4 != 0, F.col("price"))
    return t.messy.select("p_partkey", tx.option_display_name(F.col("p_name"), F.col("csv_text"), F.col("status_text")).alias("display_name"),
                          (option - base).alias("delta"))


@query("SC11", """
SELECT p_partkey, TRY_CAST(replace(regexp_extract(signed_text, '-?[0-9][0-9,]*'), ',', '') AS BIGINT) AS plain,
  CASE WHEN regexp_extract(signed_text, '([+-]?)\\s*([0-9,]+)', 1) = '-' THEN -1 ELSE 1 END
    * TRY_CAST(replace(regexp_extract(signed_text, '([+-]?)\\s*([0-9,]+)', 2), ',', '') AS BIGINT) AS signed
FROM messy""")
def sc11(t):
    return t.messy.select("p_partkey", num.first_number(F.col("signed_text")).alias("plain"),
                          num.first_signed_number(F.col("signed_text")).alias("signed"))


LABELLED = f"""
SELECT p_partkey,
  CASE p_partkey % 4 WHEN 0 THEN concat('브랜드 : V', chr(10), '원산지 : ', p_brand, '(외)') WHEN 1 THEN concat('made in : ', p_brand)
    WHEN 2 THEN p_brand ELSE concat('제조국：', p_brand, ' / x') END AS origin_text,
  CASE p_partkey % 3 WHEN 0 THEN concat('상품명 : ', p_name) WHEN 1 THEN concat('특가 : ', p_name) ELSE p_name END AS name_text,
  CASE p_partkey % 2 WHEN 0 THEN concat('상품코드: V', p_brand) ELSE p_brand END AS code_text,
  CASE p_partkey % 4 WHEN 0 THEN concat('소비자가 : 59,000원 판매가격 : ', CAST(p_size AS VARCHAR(20)), ',400원 수량 1')
    WHEN 1 THEN concat('소비자가 : 59,000원 공급가 : ', CAST(p_size AS VARCHAR(20)), ',000원') WHEN 2 THEN '판매가격 : 35,400원'
    ELSE '35,400원' END AS price_text
FROM part"""


@query("SC12", f"""
SELECT p_partkey,
  CASE p_partkey % 4 WHEN 0 THEN concat(p_brand, '(외)') ELSE p_brand END AS origin,
  CASE p_partkey % 3 WHEN 1 THEN concat('특가 : ', p_name) ELSE p_name END AS name,
  CASE p_partkey % 2 WHEN 0 THEN concat('V', p_brand) ELSE p_brand END AS code,
  CASE p_partkey % 4 WHEN 0 THEN concat(CAST(p_size AS VARCHAR(20)), ',400원') WHEN 1 THEN concat(CAST(p_size AS VARCHAR(20)), ',000원')
    WHEN 2 THEN '판매가격 : 35,400원' ELSE '35,400원' END AS price
FROM part""")
def sc12(t):
    return t.sql(LABELLED).select(
        "p_partkey", tx.strip_labels("origin", F.col("origin_text")).alias("origin"),
        tx.strip_labels("raw_product_name", F.col("name_text")).alias("name"),
        tx.strip_labels("supplier_product_code", F.col("code_text")).alias("code"),
        tx.strip_labels("supply_price", F.col("price_text")).alias("price"))


STATUS_RULES = {"구매가능": "available", "soldout": "sold_out", "중단": "stopped"}
STATUS_TEXT = """CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN ' stopped ' WHEN 2 THEN '구매가능' WHEN 3 THEN concat('/img/BTN_SoldOut_', p_brand, '.gif')
  WHEN 4 THEN '판매 중단 안내' WHEN 5 THEN p_name WHEN 6 THEN '' ELSE '0' END"""


@query("SC13", f"""
WITH i AS (SELECT p_partkey, {STATUS_TEXT} AS s FROM part)
SELECT p_partkey, CASE WHEN coalesce(s, '') = '' THEN 'unknown' WHEN trim(s) IN ('available', 'sold_out', 'stopped', 'unknown') THEN trim(s)
   WHEN trim(s) = '구매가능' THEN 'available' WHEN trim(s) = 'soldout' THEN 'sold_out' WHEN trim(s) = '중단' THEN 'stopped'
   WHEN contains(lower(s), '구매가능') THEN 'available' WHEN contains(lower(s), 'soldout') THEN 'sold_out'
   WHEN contains(lower(s), '중단') THEN 'stopped' ELSE 'sold_out' END AS status,
   CASE WHEN trim(s) = '0' THEN 'sold_out' WHEN trim(s) <> '' THEN 'available' END AS by_limit
FROM i""")
def sc13(t):
    s = F.col("s")
    return t.sql(f"SELECT p_partkey, {STATUS_TEXT} AS s FROM part").select(
        "p_partkey", st.map_status(s, STATUS_RULES, "sold_out").alias("status"), st.limit_status(s).alias("by_limit"))


SOLD_TEXT = """CASE p_partkey % 8 WHEN 0 THEN '[품절] ring' WHEN 1 THEN '품절 아님' WHEN 2 THEN 'Sold  Out' WHEN 3 THEN p_name WHEN 4 THEN '재고 없음'
  WHEN 5 THEN '품절아님, 색상 품절' WHEN 6 THEN NULL ELSE concat(p_name, ' 매진') END"""


@query("SC14", f"""
WITH i AS (SELECT p_partkey, {SOLD_TEXT} AS s FROM part)
SELECT p_partkey, coalesce(len(regexp_extract_all(s, '품절')) > len(regexp_extract_all(s, '품절\\s*아님'))
   OR regexp_matches(s, '(?i)매진|완판|sold\\s*out|재고\\s*없'), false) AS sold_out
FROM i""")
def sc14(t):
    return t.sql(f"SELECT p_partkey, {SOLD_TEXT} AS s FROM part").select("p_partkey", st.is_sold_out_text(F.col("s")).alias("sold_out"))


PROMPT_TEXT = """CASE p_partkey % 7 WHEN 0 THEN '- [필수] 옵션을 선택해 주세요 -' WHEN 1 THEN '선택' WHEN 2 THEN concat('선택 ', p_name)
  WHEN 3 THEN p_name WHEN 4 THEN '---' WHEN 5 THEN NULL ELSE '색상 선택하세요' END"""


@query("SC15", f"""
WITH i AS (SELECT p_partkey, lower(regexp_replace(coalesce({PROMPT_TEXT}, ''), '[\\s\\-\\[\\]()<>]+', '', 'g')) AS s FROM part)
SELECT p_partkey, s = '' OR s = '선택' OR (contains(s, '선택') AND regexp_matches(s, '필수|옵션|하세요|주세요|바랍니다')) AS prompt FROM i""")
def sc15(t):
    return t.sql(f"SELECT p_partkey, {PROMPT_TEXT} AS s FROM part").select("p_partkey", opt.is_placeholder(F.col("s")).alias("prompt"))


OPTION_TEXT = """CASE p_partkey % 8 WHEN 0 THEN concat(p_name, ' (+', CAST(p_size AS VARCHAR(20)), ',000원)') WHEN 1 THEN concat(p_name, ' - ', CAST(p_size AS VARCHAR(20)), '00원')
  WHEN 2 THEN p_name WHEN 3 THEN concat(p_name, '  / ', CAST(p_size AS VARCHAR(20)), ',900원') WHEN 4 THEN '옵션을 선택하세요'
  WHEN 5 THEN concat(p_brand, ' [-1,', CAST(100 + p_size AS VARCHAR(20)), ']') WHEN 6 THEN concat(p_name, ' + 0원') ELSE NULL END"""
SUPPLY_PARSER = {"enabled": True, "confidence": "medium", "price_kind": "supply",
                 "pattern": r"^(?P<value>.*?)\s*/\s*(?P<price>[\d,]+)원?$"}


@query("SC16", f"""
WITH i AS (SELECT p_partkey, p_name, p_brand, p_size, CAST(floor(p_retailprice) AS BIGINT) AS base FROM part)
SELECT p_partkey,
  CASE p_partkey % 8 WHEN 4 THEN NULL WHEN 7 THEN NULL WHEN 5 THEN p_brand ELSE p_name END AS value,
  CASE p_partkey % 8 WHEN 0 THEN p_size * 1000 WHEN 1 THEN -p_size * 100 WHEN 2 THEN 0 WHEN 3 THEN p_size * 1000 + 900 - base WHEN 5 THEN -(1100 + p_size) WHEN 6 THEN 0 END AS delta,
  CASE p_partkey % 8 WHEN 0 THEN base + p_size * 1000 WHEN 1 THEN base - p_size * 100 WHEN 2 THEN base WHEN 3 THEN p_size * 1000 + 900 WHEN 5 THEN base - (1100 + p_size) WHEN 6 THEN base END AS supply
FROM i""")
def sc16(t):
    src = t.sql(f"SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS base, {OPTION_TEXT} AS s FROM part")
    got = opt.parse_option(F.col("s"), F.col("base"), SUPPLY_PARSER)
    return src.select("p_partkey", got.alias("o")).select("p_partkey", "o.value", "o.delta", "o.supply")


@query("SC17", """
SELECT p_partkey, concat('3개 · S (기본), ', p_name, ', L / -, +', format('{:,}', p_size * 100), '원, -', format('{:,}', p_size * 1000), '원') AS summary
FROM part""")
def sc17(t):
    size = F.col("p_size").cast("string")
    texts = F.array(F.lit("옵션을 선택하세요"), F.lit("S (기본)"), F.concat("p_name", F.lit(" (+"), size, F.lit("00원)")),
                    F.concat(F.lit("L (-"), size, F.lit("000원)")))
    return t.part.select("p_partkey", opt.group_summary(F.transform(texts, lambda s: opt.parse_option(s))).alias("summary"))


@query("SC18", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 2 = 0 THEN concat('og ', p_name) ELSE concat('ld ', p_name) END AS name,
  CASE WHEN p_size % 4 = 0 THEN 'a.jpg' WHEN p_size % 2 = 1 THEN 'ld.jpg' ELSE NULL END AS image,
  CAST(CASE WHEN p_size % 5 = 0 THEN p_size WHEN p_size % 2 = 0 THEN p_size * 1000 + 100 ELSE p_size END AS BIGINT) AS price
FROM part""")
def sc18(t):
    size = F.col("p_size")
    even = size % 2 == 0
    data = F.struct(
        F.when(even, F.concat(F.lit(" og "), "p_name")).alias("og_title"), F.lit("  ").alias("og_image"),
        size.cast("string").alias("og_price"), F.concat(F.lit("ld "), "p_name").alias("ld_name"),
        F.when(~even, F.lit("ld.jpg")).alias("ld_image"),
        F.when(even, F.concat(size.cast("string"), F.lit(",100원"))).alias("ld_price"))
    got = docs.fill_from_structured(F.when(size % 3 == 0, F.col("p_brand")).otherwise(F.lit(None).cast("string")),
                                    F.when(size % 4 == 0, F.lit("a.jpg")).otherwise(F.lit(None).cast("string")),
                                    F.when(size % 5 == 0, size), data)
    return t.part.select("p_partkey", got.alias("g")).select("p_partkey", "g.name", "g.image", "g.price")


@query("SC19", """
SELECT p_partkey,
  CASE p_partkey % 6 WHEN 0 THEN concat('https://shop.example/goods/img/', k, '_s.jpg') WHEN 1 THEN concat('https://shop.example/big/', k, '.PNG?w=2')
    WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN concat('https://cdn.example/view/', k) ELSE concat('https://shop.example/goods/thumb_', k, '.webp') END AS url,
  CASE p_partkey % 6 WHEN 0 THEN concat(k, '.jpg') WHEN 1 THEN concat(k, '.png') WHEN 2 THEN 'spacer.gif' WHEN 3 THEN concat(k, '.gif') WHEN 4 THEN k ELSE concat(k, '.webp') END AS key,
  concat('/small/', k, 'x.jpg') AS others
FROM (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS k FROM part)""")
def sc19(t):
    k = F.col("p_partkey").cast("string")
    m = F.col("p_partkey") % 6
    url = (F.when(m == 0, F.concat(F.lit("img/"), k, F.lit("_s.jpg"))).when(m == 1, F.concat(F.lit(" /big/"), k, F.lit(".PNG?w=2")))
           .when(m == 2, F.lit("/a/spacer.gif")).when(m == 3, F.concat(F.lit("/b/"), k, F.lit(".gif")))
           .when(m == 4, F.concat(F.lit("https://cdn.example/view/"), k)).otherwise(F.concat(F.lit("thumb_"), k, F.lit(".webp"))))
    base = F.lit("https://shop.example/goods/view?x=1")
    gallery = F.array(F.concat(F.lit("/small/"), k, F.lit("_thumb.jpg")), F.concat(F.lit("/small/"), k, F.lit("x.jpg")))
    main = F.concat(F.lit("https://shop.example/big/"), k, F.lit(".jpg?v=3"))
    return t.part.select("p_partkey", ur.image_url(url, base).alias("url"), ur.image_key(url, base).alias("key"),
                         joined(ur.without_image(gallery, main, base)).alias("others"))


@query("SC20", """
WITH i AS (SELECT page_id, url, regexp_extract(url, '\\?([^#]*)', 1) AS q,
   regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages)
SELECT page_id,
  CASE WHEN regexp_extract(q, '^[^=&]*=([^&]+)', 1) <> '' THEN regexp_extract(q, '^[^=&]*=([^&]+)', 1)
       WHEN regexp_extract(path, '[^/]*$') <> '' THEN regexp_extract(path, '[^/]*$') ELSE 'none' END AS category,
  nullif(regexp_extract(q, '(?:^|&)page=([^&]*)', 1), '') AS by_param,
  CASE WHEN regexp_matches(url, '/(?:en|fr|de|es)/([0-9]+)') THEN regexp_extract(url, '/(?:en|fr|de|es)/([0-9]+)', 1) END AS by_pattern,
  concat(url, CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'p=3') AS listing
FROM i""")
def sc20(t):
    url = F.col("url")
    return t.pages.select("page_id", ur.category_id(url, F.lit("none")).alias("category"), ur.url_value(url, param="page").alias("by_param"),
                          ur.url_value(url, pattern="/(?:en|fr|de|es)/([0-9]+)").alias("by_pattern"),
                          ur.listing_url(F.lit("c"), url, F.lit(3), page_param="p").alias("listing"))


@query("SC21", """
SELECT n_nationkey, concat(r_name, '>', n_name) AS path FROM nation JOIN region ON n_regionkey = r_regionkey""")
def sc21(t):
    src = t.sql("SELECT n_nationkey, concat('  NAVER : ', r_name, ' > > ', n_name, ' >') AS raw FROM nation JOIN region ON n_regionkey = r_regionkey")
    return src.select("n_nationkey", tx.normalize_category_path(F.col("raw")).alias("path"))


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


@query("SC22", f"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(concat('Authorization: "Bearer abc" x ', text, ' token=s3cr;'),
     '{_re2(K.SECRET_PATTERNS[0])}', '\\1\\2\\3[REDACTED]\\2\\3', 'g'), '{_re2(K.SECRET_PATTERNS[1])}', '\\1[REDACTED]', 'g'),
     '{_re2(K.SECRET_PATTERNS[2])}', '\\1\\2\\3[REDACTED]\\2\\3', 'g') AS redacted,
   trim(regexp_replace(regexp_replace(regexp_replace(concat(text, ' <i title="', repeat('long ', 100), '">end</i>'), '`', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS clean
FROM documents""")
def sc22(t):
    tagged = F.concat("text", F.lit(f' <i title="{"long " * 100}">end</i>'))
    secret = F.concat(F.lit('Authorization: "Bearer abc" x '), "text", F.lit(" token=s3cr;"))
    return t.documents.select("doc_id", tx.redact_credentials(secret).alias("redacted"),
                              tx.sanitize_text(tagged, drop_tags=True).alias("clean"))


@query("SC23", """
WITH i AS (SELECT page_id, lower(concat(html, chr(10), url, CASE page_id % 6 WHEN 0 THEN '/Product/detail.html' WHEN 1 THEN '/shopdetail.html'
   WHEN 2 THEN '/goods/goods_view.php' WHEN 3 THEN '/shop/item.php' WHEN 4 THEN 'WISA' ELSE '' END)) AS h FROM pages)
SELECT page_id, CASE WHEN contains(h, 'xans-') OR contains(h, '/product/detail.html') OR contains(h, 'ec-base-') THEN 'cafe24'
  WHEN contains(h, 'mk_menu') OR contains(h, 'shopdetail.html') OR contains(h, 'shopbrand.html') THEN 'makeshop'
  WHEN contains(h, '/goods/goods_view.php') OR contains(h, 'godomall') OR contains(h, 'godo.co.kr') THEN 'godomall'
  WHEN contains(h, '/shop/item.php') OR contains(h, 'g5_') OR contains(h, 'sit_title') THEN 'youngcart'
  WHEN contains(h, 'wisa') OR contains(h, '/shop/goods/goods_view.php') THEN 'wisa' END AS platform
FROM i""")
def sc23(t):
    tails = ["/Product/detail.html", "/shopdetail.html", "/goods/goods_view.php", "/shop/item.php", "WISA", ""]
    tail = F.element_at(F.array(*[F.lit(x) for x in tails]), (F.col("page_id") % 6 + 1).cast("int"))
    return t.pages.select("page_id", tx.detect_platform(F.col("html"), F.concat("url", tail)).alias("platform"))


@query("SC24", """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 OR (p_size % 2 = 0 AND p_size % 3 <> 0) THEN 'sold_out'
   WHEN p_size % 3 = 0 AND p_size % 2 <> 0 THEN 'available' ELSE 'unknown' END AS status FROM part""")
def sc24(t):
    size = F.col("p_size")
    limit = F.when(size % 5 == 0, F.lit(" 0 ")).otherwise(F.lit("12"))
    return t.part.select("p_partkey", st.classify_page(limit, size % 2 == 0, size % 3 == 0).alias("status"))


@query("SC25", """
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '새 도매처 상품' WHEN p_size % 4 = 1 THEN '도매처 목록에서 사라진 단종 상품'
   WHEN p_size % 4 = 2 THEN concat('도매가: ', CAST(p_size AS VARCHAR), ' → null', chr(10), '목록 이미지: 변경됨')
   ELSE '변경 항목: origin, note' END AS tooltip
FROM part""")
def sc25(t):
    size = F.col("p_size")
    kind = F.when(size % 4 == 0, F.lit("new")).when(size % 4 == 1, F.lit("removed")).otherwise(F.lit("updated"))
    detailed = size % 4 == 2
    fields = F.when(detailed, F.array(F.lit("price_wholesale"), F.lit("images_list"))).otherwise(F.array(F.lit("origin"), F.lit("note")))
    known = F.when(detailed, fields).otherwise(tx.no_texts())
    old = F.create_map(F.lit("price_wholesale"), size.cast("string"))
    new = F.create_map(F.lit("price_wholesale"), F.lit(None).cast("string"))
    return t.part.select("p_partkey", tx.change_tooltip(kind, fields, tx.change_lines(known, old, new)).alias("tooltip"))


@query("SC26", """
WITH i AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN split_part(p_name, ' ', 1) ELSE p_brand END AS b,
  CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END AS r, CASE WHEN p_size % 3 = 0 THEN p_type ELSE split_part(p_name, ' ', 2) END AS k FROM part),
j AS (SELECT p_partkey, k, CASE WHEN coalesce(b, '') <> '' AND r <> '' AND NOT contains(r, b) THEN concat(b, ' ', r)
  WHEN r <> '' THEN r ELSE coalesce(b, '') END AS h FROM i)
SELECT p_partkey, CASE WHEN contains(h, k) THEN h WHEN h = '' THEN k ELSE concat(h, ' ', k) END AS title FROM j""")
def sc26(t):
    size, name = F.col("p_size"), F.col("p_name")
    brand = F.when(size % 4 == 0, F.lit(None)).when(size % 4 == 1, F.substring_index(name, " ", 1)).otherwise(F.col("p_brand"))
    refined = F.when(size % 5 == 0, F.lit(" ")).otherwise(name)
    keyword = F.when(size % 3 == 0, F.col("p_type")).otherwise(F.substring_index(name, " ", -1))
    return t.part.select("p_partkey", tx.compose_title(brand, refined, F.array(F.lit(" "), keyword)).alias("title"))


@query("SC27", """
WITH i AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(nfc_normalize(source), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS tk FROM documents)
SELECT doc_id, array_to_string(tk, ' ') AS tokens, len(tk) > 0 AND len(tk) <= 9 AND length(array_to_string(tk, ' ')) <= 50 AS fits FROM i""")
def sc27(t):
    tokens = tx.tokens_of(F.col("source"))
    return t.documents.select("doc_id", tokens.alias("tk")).select(
        "doc_id", F.array_join("tk", " ").alias("tokens"), tx.tokens_fit(F.col("tk")).alias("fits"))


@query("SC28", """
SELECT p_partkey, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'base' END AS brand,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS price, CASE WHEN p_size % 2 = 0 THEN 'x' END AS extra
FROM part""")
def sc28(t):
    size = F.col("p_size")
    base = F.to_json(F.struct(F.struct(F.col("p_name").alias("name"), F.lit("base").alias("brand")).alias("product"), size.alias("price")))
    brand = F.concat(F.lit('{"product":{"brand":"'), "p_brand", F.lit('","extra":"x"}'))
    patch = F.concat(F.when(size % 2 == 0, brand).otherwise(F.lit('{"note":[]')), F.when(size % 3 == 0, F.lit(',"price":null}')).otherwise(F.lit("}")))
    merged = t.part.select("p_partkey", docs.json_merge(base, patch).alias("m"))
    leaf = lambda path, name: F.get_json_object("m", path).alias(name)
    return merged.select("p_partkey", leaf("$.product.name", "name"), leaf("$.product.brand", "brand"), leaf("$.price", "price"), leaf("$.product.extra", "extra"))


@query("SC29", """
SELECT page_id, TRY_CAST(regexp_extract(replace(concat('1,2', CAST(page_id AS VARCHAR), '.5 won'), ',', ''), '[0-9][0-9.]*') AS DOUBLE) AS price,
  regexp_extract(string_split(url, '?')[1], '[^/]*$') AS file,
  array_to_string(list_sort(list_distinct(regexp_extract_all(lower(html), '[0-9a-z가-힣]+'))), ' ') AS words
FROM pages""")
def sc29(t):
    price = F.concat(F.lit("1,2"), F.col("page_id").cast("string"), F.lit(".5 won"))
    return t.pages.select("page_id", num.price_number(price).alias("price"), ur.basename(F.col("url")).alias("file"),
                          F.array_join(F.array_sort(tx.word_set(F.col("html"))), " ").alias("words"))
