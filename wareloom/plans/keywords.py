"""Keyword, name, category and attribute queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wareloom import constants as K
from wareloom.operators import keywords as kw
from wareloom.operators import names as nm
from wareloom.operators import reads as rd
from wareloom.plans.reads import MARKETS_SQL
from wareloom.plans.registry import query


def seeds(t):
    s = t.seed_phrases
    of = lambda kind: s.filter(F.col("origin") == kind)
    return kw.keyword_seeds(of("refined"), of("related"), of("synonym"))


SEEDS_SQL = "SELECT DISTINCT product_id, keyword FROM seed_phrases WHERE keyword IS NOT NULL"
STOP_SQL = " OR ".join(f"contains(keyword, '{w}')" for w in K.KEYWORD_STOP_WORDS)
SCORED_SQL = f"""SELECT product_id, keyword, 10 + CASE WHEN len(string_split(keyword, ' ')) >= 3 THEN 5 WHEN len(string_split(keyword, ' ')) = 2 THEN 3 ELSE 0 END
  - CASE WHEN regexp_matches(keyword, '{K.QUANTITY_PATTERN}') THEN 10 ELSE 0 END AS score FROM ({SEEDS_SQL}) s WHERE length(keyword) >= 2 AND NOT ({STOP_SQL})"""


@query("K1", SEEDS_SQL)
def k1(t):
    return seeds(t)


@query("K2", SCORED_SQL)
def k2(t):
    return kw.score_keywords(seeds(t))


VERDICTS_SQL = """SELECT p_partkey AS product_id, p_name AS keyword, 'brand_suspected' AS verdict FROM part WHERE p_size > 40
UNION ALL SELECT p_partkey, concat(p_type, ' ', p_name), 'generic' FROM part"""
MARK_SQL = " OR ".join(f"contains(keyword, '{w}')" for w in K.TRADEMARKS)


@query("K3", f"""
WITH s AS ({SCORED_SQL}), v AS ({VERDICTS_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, keyword) AS q FROM s),
m AS (SELECT r.*, EXISTS (SELECT 1 FROM v WHERE v.product_id = r.product_id AND v.keyword = r.keyword AND verdict = 'brand_suspected') AS bad FROM r WHERE q <= 20 AND NOT ({MARK_SQL})),
k AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, keyword) AS rank FROM m WHERE NOT bad)
SELECT 'kept' AS kind, product_id, keyword, CAST(rank AS INT) AS rank FROM k WHERE rank <= 10 UNION ALL SELECT 'warning', product_id, keyword, NULL FROM m WHERE bad""")
def k3(t):
    return kw.screen_brands(kw.score_keywords(seeds(t)), t.sql(VERDICTS_SQL)).drop("score")


def named(t):
    """Products with keywords: the type, the name, the name with its type, and a name that repeats a brand token."""
    return t.part.select(
        F.col("p_partkey").alias("product_id"), F.array(F.concat_ws(" ", F.lower("p_type"), F.substring_index("p_name", " ", 1)), F.col("p_name"),
                                                       F.concat("p_brand", F.lit(" "), F.substring_index("p_name", " ", -1)), F.lit("!!")).alias("keywords"),
        F.col("p_name").alias("refined_name"), F.col("p_brand").alias("brand_name"), F.col("p_type").alias("original_name"))


# Names are an adjective and a noun; the brand's tokens are "Brand" and its number.
PARTS_SQL = "SELECT p_partkey AS product_id, lower(p_type) AS ty, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun, p_name FROM part"


@query("K4", f"""
WITH i AS ({PARTS_SQL})
SELECT product_id, 1 AS position, concat(ty, ' ', adj) AS tokens FROM i UNION ALL SELECT product_id, 2, p_name FROM i""")
def k4(t):
    kept = nm.with_tokens(named(t)).select("product_id", F.posexplode("_keywords").alias("i", "k"))
    return kept.select("product_id", (F.col("i") + 1).alias("position"), F.array_join("k", " ").alias("tokens"))


@query("K5", f"""
WITH i AS ({PARTS_SQL}) SELECT product_id, concat(ty, ' ', adj, ' ', noun) AS name FROM i""")
def k5(t):
    return nm.generate_names(named(t)).select("product_id", F.col("generated_name").alias("name"))


def with_candidates(t):
    reversed_name = F.concat_ws(" ", F.substring_index("refined_name", " ", -1), F.substring_index("refined_name", " ", 1))
    type_word = F.lower("original_name")
    # Out: a word nobody allowed, punctuation, a brand token. In: the full phrase late, the full phrase first.
    odd = F.array(F.concat("refined_name", F.lit(" zzz")), F.concat("refined_name", F.lit("!")), F.concat(F.lit("brand "), "refined_name"),
                  F.concat_ws(" ", type_word, "refined_name"), F.concat_ws(" ", "refined_name", type_word), reversed_name)
    return named(t).withColumn("candidates", F.when(F.col("product_id") % 4 == 0, F.array(reversed_name)).otherwise(odd))


@query("K6", f"""
WITH i AS ({PARTS_SQL})
SELECT product_id, concat(ty, ' ', p_name) AS name, product_id % 4 <> 0 AS from_candidate FROM i""")
def k6(t):
    return nm.select_names(with_candidates(t)).select("product_id", F.col("product_name").alias("name"), "from_candidate")


SEARCH_SQL = """SELECT c_custkey AS product_id, CASE c_custkey % 5 WHEN 0 THEN r_name WHEN 1 THEN 'X' ELSE concat(' ', r_name, ' ') END AS level1,
  CASE c_custkey % 5 WHEN 0 THEN n_name WHEN 1 THEN 'Y' WHEN 2 THEN concat(n_name, ' ') ELSE '' END AS level2,
  CASE c_custkey % 5 WHEN 1 THEN n_name WHEN 3 THEN substr(r_name, 2, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 3 END) WHEN 4 THEN 'nowhere' ELSE '' END AS level3,
  CASE WHEN c_custkey % 15 = 3 THEN 'IC' ELSE NULL END AS level4,
  CASE c_custkey % 11 WHEN 0 THEN 'failed' WHEN 1 THEN 'empty' ELSE 'hit' END AS outcome
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


@query("K7", f"""
WITH d AS (SELECT CAST(category_id AS VARCHAR) AS id, replace(replace(path, '네이버: ', ''), ' > ', '>') AS path, ord FROM categories),
s AS (SELECT product_id, outcome, array_to_string(list_filter([trim(level1), trim(level2), trim(level3), trim(coalesce(level4, ''))], lambda x: x <> ''), '>') AS path,
  trim(coalesce(nullif(level4, ''), nullif(level3, ''), '')) AS term FROM ({SEARCH_SQL}) q),
p AS (SELECT term, arg_min(d.path, ord) AS path, arg_min(id, ord) AS id FROM (SELECT DISTINCT term FROM s WHERE term <> '') u JOIN d ON contains(d.path, term) GROUP BY 1)
SELECT product_id, CASE outcome WHEN 'failed' THEN 'Error' WHEN 'empty' THEN '' ELSE CASE WHEN d.id IS NOT NULL THEN s.path ELSE coalesce(p.path, s.path) END END AS path,
  CASE WHEN outcome IN ('failed', 'empty') THEN '' ELSE coalesce(d.id, p.id, 'Manual Check') END AS category_id
FROM s LEFT JOIN d ON d.path = s.path LEFT JOIN p ON p.term = s.term""")
def k7(t):
    return kw.match_categories(t.sql(SEARCH_SQL), kw.read_dictionary(t.categories))


@query("K8", """
SELECT product_id, CASE WHEN user_id % 4 = 0 THEN 'Error' WHEN user_id % 4 = 1 THEN 'Manual Check' ELSE concat('77', CAST(product_id AS VARCHAR)) END AS category_id FROM catalogue""")
def k8(t):
    predictions = t.catalogue.filter("user_id % 4 <> 0").select(
        "product_id", F.when(F.col("user_id") % 4 == 1, F.lit(" ")).otherwise(F.concat(F.lit("77"), F.col("product_id").cast("string"))).alias("predicted_id"))
    return kw.predicted_category(t.catalogue, predictions)


def specs(t):
    """Specs of a product: brand, size, type and one attribute no schema knows."""
    pairs = F.create_map(F.lit("Brand"), F.col("p_brand"), F.lit("Size"), F.col("p_size").cast("string"), F.lit("Type"), F.col("p_type"), F.lit("Ghost"), F.lit("x"))
    return t.part.select(F.col("p_partkey").alias("product_id"), F.concat(F.lit("C"), (F.col("p_size") % 3).cast("string")).alias("category_id"), pairs.alias("specs"))


def schema(t):
    """Attribute definitions of three categories; Type is enumerated and lacks one value, Brand is missing in one category."""
    rows = t.part.select(F.concat(F.lit("C"), (F.col("p_size") % 3).cast("string")).alias("category_id")).distinct()
    values = F.create_map(*[x for i, v in enumerate(("ECONOMY", "SMALL", "MEDIUM", "LARGE", "STANDARD")) for x in (F.lit(v), F.lit(i + 1))])
    none = F.lit(None).cast("map<string,int>")
    attr = lambda name, seq, unit, ids, exposed: F.struct(F.lit(name).alias("attribute"), F.lit(seq).alias("attribute_seq"), F.lit(unit).cast("string").alias("unit_code"),
                                                         ids.alias("value_ids"), F.lit(exposed).alias("exposed"))
    attrs = F.array(attr("Brand", 10, None, none, "NONE"), attr("Size", 11, "CM", none, "EXPOSED"), attr("Type", 12, None, values, "EXPOSED"))
    out = rows.select("category_id", F.explode(attrs).alias("a")).select("category_id", "a.*")
    return out.filter(~((F.col("category_id") == "C2") & (F.col("attribute") == "Brand")))


TYPE_ID = "CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'LARGE' THEN 4 WHEN 'STANDARD' THEN 5 END"


@query("K9", f"""
SELECT p_partkey AS product_id, 10 AS attribute_seq, CAST(NULL AS INT) AS value_id, p_brand AS real_value, '' AS unit_code FROM part WHERE p_size % 3 <> 2
UNION ALL SELECT p_partkey, 11, NULL, CAST(p_size AS VARCHAR), 'CM' FROM part
UNION ALL SELECT p_partkey, 12, {TYPE_ID}, NULL, NULL FROM part WHERE {TYPE_ID} IS NOT NULL""")
def k9(t):
    return kw.map_attributes_a(specs(t), schema(t)).drop("ord")


@query("K10", """
SELECT p_partkey AS product_id, CASE WHEN p_size % 3 = 2 THEN '' ELSE concat('Brand=', p_brand) END AS product_attributes,
  concat('Size=', CAST(p_size AS VARCHAR), '|Type=', p_type) AS item_attributes FROM part""")
def k10(t):
    show = lambda c: F.array_join(F.transform(c, lambda e: F.concat_ws("=", e["attributeTypeName"], e["attributeValueName"])), "|").alias(c)
    return kw.map_attributes_b(specs(t), schema(t)).select("product_id", show("product_attributes"), show("item_attributes"))


PAYLOADS_SQL = """SELECT 'smartstore' AS market, CAST(s_suppkey AS VARCHAR(20)) AS category_id, concat('[{"attributeName":"Color","attributeSeq":', CAST(s_suppkey AS VARCHAR(20)),
  ',"required":', CASE WHEN s_nationkey % 2 = 0 THEN 'true' ELSE 'false' END, '},{"attributeName":"","attributeSeq":5},{"attributeName":"NoSeq"}]') AS payload FROM supplier
UNION ALL SELECT 'coupang', CAST(s_suppkey AS VARCHAR(20)), concat('{"code":"SUCCESS","data":{"attributes":[{"attributeTypeName":"Size ', CAST(s_nationkey AS VARCHAR(20)),
  '","required":"', CASE WHEN s_nationkey % 3 = 0 THEN 'MANDATORY' ELSE 'OPTIONAL' END, '","inputType":"SELECT","basicUnit":"cm","exposed":"EXPOSED","inputValues":["S","M"]},{"attributeTypeName":"Memo","inputValues":[]},{"attributeTypeName":""}]}}') FROM supplier"""


@query("K11", """
SELECT 'smartstore' AS market, CAST(s_suppkey AS VARCHAR) AS category_id, 'Color' AS attribute, s_nationkey % 2 = 0 AS required, 'STRING' AS data_type, 'INPUT' AS input_type, NULL AS unit, NULL AS valid_values,
  CAST(s_suppkey AS VARCHAR) AS attribute_seq, 'NONE' AS exposed FROM supplier
UNION ALL SELECT 'coupang', CAST(s_suppkey AS VARCHAR), concat('Size ', CAST(s_nationkey AS VARCHAR)), s_nationkey % 3 = 0, 'STRING', 'SELECT', 'cm', 'S|M', NULL, 'EXPOSED' FROM supplier
UNION ALL SELECT 'coupang', CAST(s_suppkey AS VARCHAR), 'Memo', false, 'STRING', 'INPUT', NULL, NULL, NULL, 'NONE' FROM supplier""")
def k11(t):
    return kw.normalize_schemas(t.sql(PAYLOADS_SQL)).withColumn("valid_values", F.array_join("valid_values", "|"))


@query("K12", f"WITH {MARKETS_SQL} SELECT * FROM m")
def k12(t):
    return rd.market_categories(t.platform_mappings)
