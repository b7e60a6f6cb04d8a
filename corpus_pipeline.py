"""The corpus pipeline: quality, near copies, secrets, mixture, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and returns what it keeps; ``run`` writes each result to the shared folder and
reads it as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cvegrid.llm import bpe_prefix, curriculum, ngram_join, quality_cnn, secret_scan
from cvegrid.llm.common import in_fold, stored, table

#: Documents below this probability of quality go.
QUALITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network accepts. It learns from labelled documents outside the held-out fold."""
    network = quality_cnn.fit(docs, table(spark, sf_dir, "labels"), ~in_fold(F.col("doc_id"), 4, 2))
    return quality_cnn.score(docs, network, into="__score").where(F.col("__score") >= QUALITY).drop("__score")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity 0.8 or more: the one with the smallest id."""
    return ngram_join.keep_one(docs, n=5, similarity=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets that one or two owners hold masked, and ``n_chars`` of masked texts counted anew."""
    masked = F.col("text").contains(secret_scan.MASK)
    return secret_scan.redact(docs).withColumn(
        "n_chars", F.when(masked, F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of training."""
    return curriculum.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) instead of texts; ``exact`` says that they decode to the text."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return bpe_prefix.round_trip(docs).select(
        "doc_id", "lang", "source", "n_chars", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        (F.col("decoded") == text).alias("exact"),
    )


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", secrets),
    ("mixing to target weights", mixture),
    ("byte-level BPE", tokens),
]

#: A trained network decides, which SQL does not express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return docs
