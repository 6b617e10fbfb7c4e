"""Keyword curation, category matching and attribute mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareloom import constants as K
from wareloom.functions import text as tx
from wareloom.functions.rows import explode_built
from wareloom.functions.skew import join_per_key, salted
from wareloom.functions.text import clean_text


def keyword_seeds(refined: DataFrame, related: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Distinct (product, keyword) from the refined name, related terms and synonyms; a missing source adds nothing."""
    name = refined.select("product_id", F.col("refined_name").alias("keyword"))
    rows = name.unionByName(related.select("product_id", "keyword")).unionByName(synonyms.select("product_id", "keyword"))
    return rows.filter(F.col("keyword").isNotNull()).dropDuplicates(["product_id", "keyword"])


def score_keywords(seeds: DataFrame) -> DataFrame:
    """Keywords of two or more characters without stop words, with their quality score."""
    keyword = F.col("keyword")
    words = F.size(F.filter(F.split(tx.squash(keyword), " "), lambda w: w != ""))
    kept = seeds.filter((F.char_length(keyword) >= 2) & ~tx.contains_any(keyword, K.KEYWORD_STOP_WORDS))
    bonus = F.when(words >= 3, 5).when(words >= 2, 3).otherwise(0)
    penalty = F.when(keyword.rlike(K.QUANTITY_PATTERN), 10).otherwise(0)
    return kept.withColumn("score", F.lit(10) + bonus - penalty)


def _best(rows: DataFrame, n: int) -> DataFrame:
    """Top ``n`` keywords per product by score, then text. Spark cuts each partition to ``n`` before it shuffles."""
    order = Window.partitionBy("product_id").orderBy(F.desc("score"), "keyword")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def screen_brands(scored: DataFrame, verdicts: DataFrame, examined: int = 20, kept: int = 10) -> DataFrame:
    """Kept and suspected keywords per product, ``kind`` telling which: of the best twenty, trademarks drop out,
    brand-suspected ones become warnings, and at most ten others stay, in score order.

    ``verdicts``: ``product_id, keyword, verdict``; a product without verdicts keeps all, an unlisted keyword counts as
    generic.
    """
    top = _best(scored, examined).drop("rank").filter(~tx.contains_any(F.col("keyword"), K.TRADEMARKS))
    suspected = verdicts.filter(F.col("verdict") == "brand_suspected").select("product_id", "keyword").dropDuplicates()
    marked = top.join(suspected.withColumn("suspect", F.lit(True)), ["product_id", "keyword"], "left")
    marked = marked.withColumn("suspect", F.coalesce("suspect", F.lit(False)))
    # At most twenty rows per product are left here; the others come first, so that their ranks are final.
    order = Window.partitionBy("product_id").orderBy("suspect", F.desc("score"), "keyword")
    ranked = marked.withColumn("rank", F.row_number().over(order)).filter(F.col("suspect") | (F.col("rank") <= kept))
    kind = F.when(F.col("suspect"), F.lit("warning")).otherwise(F.lit("kept"))
    return ranked.select(kind.alias("kind"), "product_id", "keyword", "score", F.when(~F.col("suspect"), F.col("rank")).alias("rank"))


def read_dictionary(rows: DataFrame) -> DataFrame:
    """Category dictionary with normalised paths and text ids, in file order. A path given twice keeps its first place
    and takes the last id."""
    clean = rows.select(tx.normalize_category_path(F.col("path")).alias("path"), F.col("category_id").cast("string").alias("category_id"), "ord")
    return clean.groupBy("path").agg(F.max_by("category_id", "ord").alias("category_id"), F.min("ord").alias("ord"))


def first_paths_containing(terms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """For each distinct ``term`` the first dictionary path that contains it, as ``term, path, category_id``.

    Every path is cut into its pieces of the lengths that occur among the terms; the first path of each piece is found by a minimum that combines
    before the shuffle, and the terms are joined to the pieces as a whole.
    """
    wanted = terms.select("term").distinct().filter(F.col("term") != "")
    # One row: the lengths of terms, at most as many as the longest path has characters.
    lengths = wanted.agg(F.collect_set(F.char_length("term")).alias("lengths"))
    paths = dictionary.filter(F.col("path") != "").select("path", "category_id", "ord", lengths.scalar().alias("lengths"))

    def pieces(n):
        return F.when(n <= F.char_length("path"), F.transform(F.sequence(F.lit(1), F.char_length("path") - n + 1), lambda i: F.substr(F.col("path"), i, n)))

    cut = F.array_distinct(F.flatten(F.transform("lengths", lambda n: F.coalesce(pieces(n), F.array().cast("array<string>")))))
    indexed = explode_built(paths, cut, "path", "category_id", "ord", name="term")
    first = indexed.groupBy("term").agg(F.min(F.struct("ord", "path", "category_id")).alias("m"))
    return wanted.join(first, "term").select("term", "m.path", "m.category_id")


def match_categories(searches: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Category of every search result: exact path, else the first path containing the last level, else a manual check.

    ``searches``: ``product_id, level1..level4, outcome`` with outcome hit, empty or failed. ``dictionary`` as read.
    """
    levels = [F.coalesce(f"level{i}", F.lit("")) for i in (1, 2, 3, 4)]
    path = tx.normalize_category_path(F.concat_ws(">", *levels))
    last = F.coalesce(tx.null_if_empty(F.col("level4")), tx.null_if_empty(F.col("level3")))
    rows = searches.withColumns({"path": path, "term": tx.normalize_category_path(last)})
    exact = dictionary.select("path", F.col("category_id").alias("exact_id"))
    # A popular category may hold a large share of the rows, so these are spread by salt.
    rows = join_per_key(salted(rows, ["product_id", "path"]), exact, ["path"], "left").drop("_salt")
    open_terms = rows.filter((F.col("outcome") == "hit") & F.col("exact_id").isNull())
    partial = first_paths_containing(open_terms, dictionary).select(
        F.col("term").alias("_key"), F.col("path").alias("near_path"), F.col("category_id").alias("near_id"))
    # Rows that need no partial match get a key of their own, so that they do not meet in one partition.
    needs = (F.col("outcome") == "hit") & F.col("exact_id").isNull() & (F.col("term") != "")
    apart = F.concat(F.lit("\x00"), F.col("product_id").cast("string"))
    rows = rows.withColumn("_key", F.when(needs, F.col("term")).otherwise(apart))
    rows = join_per_key(salted(rows, ["product_id", "path"]), partial, ["_key"], "left").drop("_salt")
    by = F.col("outcome")
    shown = F.when(by == "failed", F.lit("Error")).when(by == "empty", F.lit("")).when(F.col("exact_id").isNotNull(), F.col("path")).otherwise(
        F.coalesce("near_path", "path"))
    code = F.when(by.isin("failed", "empty"), F.lit("")).otherwise(F.coalesce("exact_id", "near_id", F.lit("Manual Check")))
    return rows.select("product_id", shown.alias("path"), code.alias("category_id"))


def predicted_category(products: DataFrame, predictions: DataFrame) -> DataFrame:
    """Second market: the predicted id, else a manual check; a product without any row had a failing call."""
    p = predictions.select("product_id", F.struct(clean_text(F.col("predicted_id")).alias("id")).alias("p"))
    joined = products.select("product_id").join(p, "product_id", "left")
    return joined.select("product_id", F.when(F.col("p").isNull(), F.lit("Error")).otherwise(F.coalesce("p.id", F.lit("Manual Check"))).alias("category_id"))


def _specs(specs: DataFrame, schema: DataFrame) -> DataFrame:
    """Product specs next to the attribute definitions of the product's category."""
    rows = specs.select("product_id", "category_id", F.posexplode(F.map_entries("specs")).alias("ord", "e"))
    rows = rows.select("product_id", "category_id", "ord", F.col("e.key").alias("attribute"), F.col("e.value").alias("value"))
    return join_per_key(salted(rows, ["product_id", "ord"]), schema, ["category_id", "attribute"]).drop("_salt")


def map_attributes_a(specs: DataFrame, schema: DataFrame) -> DataFrame:
    """Market A attributes, one row each: value id for an enumerated attribute, text and unit for a free one.

    ``schema``: ``category_id, attribute, attribute_seq, unit_code, value_ids map``; values outside an enumeration drop out.
    """
    value_id = F.try_element_at("value_ids", F.col("value"))
    free = F.col("value_ids").isNull()
    rows = _specs(specs, schema).filter(free | value_id.isNotNull())
    return rows.select("product_id", "ord", "attribute_seq", value_id.alias("value_id"), F.when(free, F.col("value")).alias("real_value"),
                       F.when(free, F.coalesce("unit_code", F.lit(""))).alias("unit_code"))


def map_attributes_b(specs: DataFrame, schema: DataFrame) -> DataFrame:
    """Market B attributes per product: ``product_attributes`` and, for exposed ones, ``item_attributes``.

    A product has one entry per spec, so both lists are as short as its spec map.
    """
    entry = F.struct("ord", F.col("attribute").alias("attributeTypeName"), F.col("value").alias("attributeValueName"))
    exposed = F.col("exposed") == "EXPOSED"
    grouped = _specs(specs, schema).groupBy("product_id").agg(
        F.array_sort(F.collect_list(F.when(~exposed, entry))).alias("product_attributes"),
        F.array_sort(F.collect_list(F.when(exposed, entry))).alias("item_attributes"))
    bare = lambda c: F.transform(c, lambda e: F.struct(e["attributeTypeName"].alias("attributeTypeName"), e["attributeValueName"].alias("attributeValueName"))).alias(c)
    return grouped.select("product_id", bare("product_attributes"), bare("item_attributes"))


RAW_A = "array<struct<attributeName:string,attributeSeq:string,required:string>>"
RAW_B = ("struct<data:struct<attributes:array<struct<attributeTypeName:string,required:string,inputType:string,dataType:string,"
         "basicUnit:string,exposed:string,inputValues:array<string>>>>>")


def normalize_schemas(payloads: DataFrame) -> DataFrame:
    """Attribute definitions out of raw category payloads of both markets, nameless ones dropped.

    ``payloads``: ``market, category_id, payload`` (JSON).
    """
    a = payloads.filter(F.col("market") == "smartstore").select("market", "category_id", F.explode(F.from_json("payload", RAW_A)).alias("r"))
    a = a.filter((F.col("r.attributeName") != "") & F.col("r.attributeSeq").isNotNull()).select(
        "market", "category_id", F.col("r.attributeName").alias("attribute"), (F.col("r.required") == "true").alias("required"),
        F.lit("STRING").alias("data_type"), F.lit("INPUT").alias("input_type"), F.lit(None).cast("string").alias("unit"),
        F.lit(None).cast("array<string>").alias("valid_values"), F.col("r.attributeSeq").alias("attribute_seq"), F.lit("NONE").alias("exposed"))
    b = payloads.filter(F.col("market") == "coupang").select("market", "category_id", F.explode(F.from_json("payload", RAW_B)["data"]["attributes"]).alias("r"))
    b = b.filter(F.col("r.attributeTypeName") != "").select(
        "market", "category_id", F.col("r.attributeTypeName").alias("attribute"), F.coalesce(F.col("r.required") == "MANDATORY", F.lit(False)).alias("required"),
        F.coalesce("r.dataType", F.lit("STRING")).alias("data_type"), F.coalesce("r.inputType", F.lit("INPUT")).alias("input_type"), F.col("r.basicUnit").alias("unit"),
        F.when(F.size("r.inputValues") > 0, F.col("r.inputValues")).alias("valid_values"), F.lit(None).cast("string").alias("attribute_seq"),
        F.coalesce("r.exposed", F.lit("NONE")).alias("exposed"))
    return a.withColumn("required", F.coalesce("required", F.lit(False))).unionByName(b)
