"""The registered queries of the operators, with production parameters over whole tables, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.llm import (byte_bpe, conversation_repair, html_extract, license_bank, license_scan, mixing, oracles, quality_classifier, quality_rules, secret_scan,
                          sharding, simhash, spelling_groups, top_k, url_rules)
from wareloom.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


@query("op1_secret_scan", oracles.secret_spans())
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"),
                        secret_scan.joined(F.col("spans")).alias("spans"))


@query("op2_top_k", oracles.TOP_PRODUCTS)
def top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op3_byte_bpe")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks()
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks)
    return byte_bpe.decode(ids, ranks).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                                              F.sha2("raw", 256).alias("decoded_sha256"))


@query("op4_quality_rules", oracles.quality_rules_sql())
def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         F.array_join("broken_rules", ",").alias("broken_rules"))


@query("op5_html_extraction")
def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


@query("op6_source_mixing", oracles.mixture())
def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = mixing.schedule(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return timed.select(F.col("doc")["doc_id"].alias("doc_id"), F.col("doc")["source"].alias("source"), "class", "block", "place", "release", "deadline", "slot")


@query("op7_sharding", oracles.shards())
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op8_license_scan", oracles.licenses())
def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = license_bank.bank()
    return license_scan.named(table(spark, sf_dir, "documents"), texts, {n.split("|")[0]: license_bank.family(n.split("|")[0]) for n in texts})


@query("op9_quality_classifier")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    good = (F.col("score") >= quality_classifier.THRESHOLD).cast("int")
    return quality_classifier.score(docs, net).select("doc_id", quality_classifier.is_held_out(F.col("doc_id")).alias("held_out"), "score", good.alias("predicted"))


@query("op10_simhash")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op11_conversation_repair", oracles.repairs())
def repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audited(table(spark, sf_dir, "conversations"))


@query("op12_url_filter", oracles.url_verdicts())
def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(table(spark, sf_dir, "pages"))


@query("op13_spelling_groups", oracles.SPELLING)
def spelling_groups_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.grouped(table(spark, sf_dir, "documents"))
