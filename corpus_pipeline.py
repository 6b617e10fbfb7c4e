"""From raw documents to training tokens: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.llm import byte_bpe, mixing, quality_classifier, secret_scan, simhash
from wareloom.llm.tables import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    net = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.scored(docs, net).filter(F.col("score") >= quality_classifier.THRESHOLD).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay."""
    return secret_scan.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an order that holds the sources' target weights; all stay."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the digests of the ids and of the bytes they decode to, in the order of the stored mixture."""
    ranks = byte_bpe.read_ranks()
    # Encoded once: ordering by ranges reads its input twice.
    ids = Scratch(spark, "tokens").keep(byte_bpe.encode(mixing.placed(docs), ranks, carried=("position",)))
    return byte_bpe.decode(ids.orderBy("position"), ranks).select("position", "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                                              F.sha2("raw", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources", mixture),
    ("byte-level BPE", tokens),
]

ORACLE_SQL = None  # a trained network, tokens and fingerprints have no SQL form; tests/llm compares with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
