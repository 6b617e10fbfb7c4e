"""Option queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wareloom.functions.rows import explode_built
from wareloom.operators import options as op
from wareloom.plans.registry import query

# Names and prices of every case: no names, matching, single price, mismatch, unreadable, differences.
PAIRS = """
SELECT p_partkey, concat('X', CAST(p_partkey AS VARCHAR(20))) AS code, p_size,
  CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 7 THEN ' ' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'S, M' ELSE concat(p_name, ',L') END END AS names,
  CASE p_partkey % 8 WHEN 1 THEN '2,640원,2,820원' WHEN 2 THEN '740,740' WHEN 3 THEN CAST(p_size + 100 AS VARCHAR(20)) WHEN 4 THEN '100,2000,30000'
    WHEN 5 THEN 'bad,2820' WHEN 7 THEN 'bad' ELSE CAST(p_size * 10 AS VARCHAR(20)) END AS prices,
  CASE p_partkey % 8 WHEN 6 THEN '0, +500' ELSE NULL END AS deltas,
  CASE WHEN p_size % 2 = 0 THEN 'a.jpg' ELSE NULL END AS images, CASE WHEN p_size % 3 = 0 THEN '품절' ELSE '판매중' END AS status
FROM part"""
PRICE_SQL = """CASE p_partkey % 8 WHEN 1 THEN 2640 WHEN 2 THEN 740 WHEN 3 THEN p_size + 100 WHEN 4 THEN 100 WHEN 5 THEN NULL WHEN 7 THEN NULL
  ELSE p_size * 10 END"""
SECOND_SQL = "CASE p_partkey % 8 WHEN 1 THEN 2820 WHEN 2 THEN 740 WHEN 3 THEN p_size + 100 WHEN 6 THEN p_size * 10 + 500 END"


@query("O1", f"""
WITH i AS ({PAIRS})
SELECT p_partkey, CAST({PRICE_SQL} AS BIGINT) AS price,
  CASE WHEN {SECOND_SQL} IS NULL THEN '' ELSE concat(trim(split_part(names, ',', 1)), ':', CAST({PRICE_SQL} AS VARCHAR), '|', trim(split_part(names, ',', 2)), ':', CAST({SECOND_SQL} AS VARCHAR)) END AS variants,
  CASE p_partkey % 8 WHEN 4 THEN 'option_variants 2/3' WHEN 5 THEN 'price_wholesale_raw bad,2820' WHEN 7 THEN 'price_wholesale_raw bad' ELSE '' END AS warnings
FROM i""")
def o1(t):
    df = op.pair_variants(t.sql(PAIRS), "names", "prices", "deltas")
    show = F.transform("option_variants", lambda v: F.concat_ws(":", v["name"], v["price_wholesale"].cast("string")))
    note = F.transform("option_warnings", lambda w: F.concat_ws(" ", w["field"], w["raw_value"], F.concat(
        w["option_count"].cast("string"), F.lit("/"), w["price_count"].cast("string"))))
    return df.select("p_partkey", F.col("price_wholesale").alias("price"), F.array_join(show, "|").alias("variants"), F.array_join(note, "|").alias("warnings"))


@query("O2", f"""
WITH i AS ({PAIRS}), k AS (SELECT *, unnest([1, 2]) AS position FROM i WHERE p_partkey % 8 NOT IN (0, 7))
SELECT p_partkey, position, concat(code, '-', CAST(position AS VARCHAR)) AS sku, trim(split_part(names, ',', position)) AS name,
  CAST(CASE WHEN p_partkey % 8 = 4 THEN CASE position WHEN 1 THEN 100 ELSE 2000 END WHEN p_partkey % 8 = 5 THEN CASE position WHEN 2 THEN 2820 END
       WHEN position = 1 THEN {PRICE_SQL} ELSE {SECOND_SQL} END AS BIGINT) AS supply,
  CAST(CASE WHEN p_partkey % 8 = 4 THEN CASE position WHEN 1 THEN 0 ELSE 1900 END WHEN p_partkey % 8 = 5 THEN NULL
       WHEN position = 1 THEN 0 ELSE {SECOND_SQL} - {PRICE_SQL} END AS BIGINT) AS delta,
  status, p_size % 3 <> 0 AS usable, CASE WHEN position = 1 THEN images END AS image
FROM k""")
def o2(t):
    df = op.pair_variants(t.sql(PAIRS), "names", "prices", "deltas")
    df = op.standard_options(df, code="code", status="status", names="names", prices="prices", images="images", deltas="deltas")
    o = explode_built(df, F.col("standard_options"), "p_partkey")
    return o.select("p_partkey", F.col("o.option_position").alias("position"), F.col("o.option_sku").alias("sku"), F.col("o.option_display_name").alias("name"),
                    F.col("o.option_supply_price").alias("supply"), F.col("o.option_price_delta").alias("delta"), F.col("o.option_status").alias("status"),
                    F.col("o.option_usable").alias("usable"), F.col("o.option_main_image_url").alias("image"))


@query("O3", """
SELECT p_partkey, position, CASE WHEN p_size % 2 = 0 THEN p_size * 10 + position ELSE CASE WHEN position - 1 < 3 THEN p_size * 10 + position - 1 END END AS price
FROM (SELECT p_partkey, p_size, unnest([1, 2, 3]) AS position FROM part)""")
def o3(t):
    # Four elements, the first a placeholder; the price list covers all four, or three only.
    size = F.col("p_size")
    prices = F.when(size % 2 == 0, F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: size * 10 + i)).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: size * 10 + i))
    rows = t.part.select("p_partkey", prices.alias("prices"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("position"))
    return rows.select("p_partkey", "position", op.aligned_price(F.col("prices"), F.lit(4), F.col("position"), F.col("position") - 1).alias("price"))


@query("O4", """
WITH n AS (SELECT *, coalesce(nullif(option_display_name, ''), nullif(option_value_1, '')) AS name FROM crawled_options)
SELECT product_id, string_agg(name, ',' ORDER BY option_position) AS names,
  string_agg(coalesce(CAST(option_supply_price AS VARCHAR), ''), ',' ORDER BY option_position) AS prices,
  string_agg(coalesce(option_main_image_url, ''), ',' ORDER BY option_position) AS images
FROM n WHERE name IS NOT NULL GROUP BY product_id""")
def o4(t):
    return op.inline_options(t.crawled_options)


@query("O5", """
WITH k AS (SELECT p_partkey, p_size, p_name, CAST(floor(p_retailprice) AS BIGINT) AS base, unnest([1, 2, 3, 4]) AS position FROM part)
SELECT p_partkey, position, concat('X', CAST(p_partkey AS VARCHAR), '-', CAST(position AS VARCHAR)) AS sku,
  concat(CASE WHEN position <= 2 THEN p_name ELSE 'White' END, ' / ', CASE WHEN position % 2 = 1 THEN 'S' ELSE 'M 품절' END) AS name,
  base AS supply, CAST(0 AS BIGINT) AS delta, position % 2 = 1 AS usable
FROM k""")
def o5(t):
    child = F.array(F.lit("선택하세요"), F.lit(" S "), F.lit("M 품절"))
    level = lambda v: F.struct(v.alias("value"), child.alias("children"))
    levels = F.array(level(F.lit("- 옵션 선택 -")), level(F.col("p_name")), level(F.lit("White")))
    code = F.concat(F.lit("X"), F.col("p_partkey").cast("string"))
    made = op.combined_options(levels, code, F.floor("p_retailprice").cast("bigint"), "색상", "사이즈")
    return _shown(explode_built(t.part, made, "p_partkey"))


def _shown(df):
    return df.select("p_partkey", F.col("o.option_position").alias("position"), F.col("o.option_sku").alias("sku"), F.col("o.option_display_name").alias("name"),
                     F.col("o.option_supply_price").alias("supply"), F.col("o.option_price_delta").alias("delta"), F.col("o.option_usable").alias("usable"))


@query("O6", """
WITH k AS (SELECT p_partkey, p_size, p_name, CAST(floor(p_retailprice) AS BIGINT) AS base, unnest([1, 2, 3]) AS position FROM part)
SELECT p_partkey, position, concat('X', CAST(p_partkey AS VARCHAR), '-', CAST(position AS VARCHAR)) AS sku,
  CASE position WHEN 1 THEN p_name WHEN 2 THEN 'L' ELSE 'XL [품절]' END AS name,
  CASE WHEN p_size % 2 = 0 THEN position * 1000 WHEN position = 1 THEN base + p_size * 100 END AS supply,
  CASE WHEN p_size % 2 = 0 THEN position * 1000 - base WHEN position = 1 THEN p_size * 100 END AS delta, position = 1 AS usable
FROM k""")
def o6(t):
    texts = F.array(F.lit("옵션을 선택하세요"), F.concat("p_name", F.lit(" (+"), F.col("p_size").cast("string"), F.lit("00원)")), F.lit("L"), F.lit("XL [품절]"))
    prices = F.when(F.col("p_size") % 2 == 0, F.array(*[F.lit(x).cast("bigint") for x in (0, 1000, 2000, 3000)])).otherwise(F.array().cast("array<bigint>"))
    made = op.flat_options(texts, F.concat(F.lit("X"), F.col("p_partkey").cast("string")), F.floor("p_retailprice").cast("bigint"), "사이즈", prices=prices,
                           disabled=F.array(F.lit(False), F.lit(False), F.lit(True), F.lit(False)))
    return _shown(explode_built(t.part, made, "p_partkey"))


def sample_options(levels_from="p_size"):
    """Two options per product on one or two levels; the second is unusable for every fifth size."""
    size = F.col(levels_from)
    code = F.concat(F.lit("X"), F.col("p_partkey").cast("string"))
    two = size % 3 == 0

    def option(i, usable, sale):
        o = op.standard_option(
            code=code, sku=F.when(size % 4 == 0, F.lit(" ")).otherwise(F.concat(code, F.lit(f"-{i}"))), groups=[F.lit("Color"), F.when(two, F.lit("Size"))],
            values=[F.col("p_name") if i == 1 else F.lit("White"), F.when(two, F.lit("M"))], supply=size * 10, delta=size * i, status=F.lit(None).cast("string"),
            usable=usable, image=F.when(size % 2 == 0, F.lit(f"o{i}.jpg")), position=F.lit(i), raw_text=F.lit("x"), metadata=F.lit("{}"), stock=F.when(size % 2 == 1, size))
        return o.withField("option_sale_price", sale.cast("bigint")).cast(op.STANDARD_OPTION)

    return F.array(option(1, F.lit(True), F.when(size % 7 == 0, size * 1000)), option(2, size % 5 != 0, F.lit(0)))


@query("O7", """
WITH k AS (SELECT p_partkey, p_size, p_name, unnest(CASE WHEN p_size % 5 = 0 THEN [1] ELSE [1, 2] END) AS i FROM part)
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Color|Size' ELSE 'Color' END AS groups, CAST(i AS INT) AS position,
  CASE i WHEN 1 THEN p_name ELSE 'White' END AS name1, CASE WHEN p_size % 3 = 0 THEN 'M' END AS name2, CASE WHEN p_size % 2 = 1 THEN p_size END AS stock,
  CAST(p_size * i AS BIGINT) AS price, true AS usable, CASE WHEN p_size % 4 <> 0 THEN concat('X', CAST(p_partkey AS VARCHAR), '-', CAST(i AS VARCHAR)) END AS sku
FROM k""")
def o7(t):
    info = t.part.select("p_partkey", op.market_a_options(op.usable_options(sample_options())).alias("i"))
    rows = explode_built(info, F.col("i.optionCombinations"), "p_partkey", F.array_join("i.optionCombinationGroupNames", "|").alias("groups"), name="c", position="pos")
    return rows.select("p_partkey", "groups", (F.col("pos") + 1).alias("position"), F.col("c.optionName1").alias("name1"), F.col("c.optionName2").alias("name2"),
                       F.col("c.stockQuantity").alias("stock"), F.col("c.price").alias("price"), F.col("c.usable").alias("usable"), F.col("c.sellerManagerCode").alias("sku"))


@query("O8", """
WITH k AS (SELECT p_partkey, p_size, p_name, unnest(CASE WHEN p_size % 6 = 0 THEN [0] WHEN p_size % 5 = 0 THEN [1] ELSE [1, 2] END) AS i FROM part)
SELECT p_partkey, CAST(CASE WHEN i = 0 THEN 1 ELSE i END AS INT) AS position,
  CASE i WHEN 0 THEN 'title' ELSE concat(CASE i WHEN 1 THEN p_name ELSE 'White' END, CASE WHEN p_size % 3 = 0 THEN ' / M' ELSE '' END) END AS name,
  CAST(CASE WHEN i = 1 AND p_size % 7 = 0 THEN p_size * 1000 ELSE 9900 END AS BIGINT) AS price,
  CASE WHEN i > 0 AND p_size % 2 = 0 THEN concat('REPRESENTATION:o', CAST(i AS VARCHAR), '.jpg') ELSE 'REPRESENTATION:a.jpg|DETAIL:b.jpg' END AS images,
  CASE i WHEN 0 THEN '' ELSE concat('Color=', CASE i WHEN 1 THEN p_name ELSE 'White' END, CASE WHEN p_size % 3 = 0 THEN '|Size=M' ELSE '' END) END AS attributes,
  CASE WHEN i > 0 AND p_size % 4 <> 0 THEN concat('X', CAST(p_partkey AS VARCHAR), '-', CAST(i AS VARCHAR)) END AS sku,
  CASE WHEN i > 0 AND p_size % 2 = 1 THEN p_size END AS stock
FROM k""")
def o8(t):
    options = F.when(F.col("p_size") % 6 == 0, F.array().cast(f"array<{op.STANDARD_OPTION}>")).otherwise(sample_options())
    items = op.market_b_items(op.usable_options(options), F.lit("title"), F.lit(9900), F.array(F.lit("a.jpg"), F.lit("b.jpg")), F.lit("<p>"), F.lit("KR"))
    rows = explode_built(t.part, items, "p_partkey", name="i", position="pos")
    pair = lambda c, a, b, sep: F.array_join(F.transform(c, lambda x: F.concat_ws(sep, x[a], x[b])), "|")
    return rows.select("p_partkey", (F.col("pos") + 1).alias("position"), F.col("i.itemName").alias("name"), F.col("i.salePrice").alias("price"),
                       pair("i.images", "imageType", "vendorPath", ":").alias("images"), pair("i.attributes", "attributeTypeName", "attributeValueName", "=").alias("attributes"),
                       F.col("i.externalVendorSku").alias("sku"), F.col("i.maximumBuyCount").alias("stock"))
