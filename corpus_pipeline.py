"""From raw documents to packed training sequences: stages that each read what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm.decontaminate import decontaminated
from wardlight.llm.order_minhash import deduplicated
from wardlight.llm.packing import best_fit_packing
from wardlight.llm.quality import quality_filter, quality_model
from wardlight.llm.queries import table, word_tokenizer
from wardlight.llm.secret_forest import redacted, secret_model
from wardlight.llm.text import small_batches
from wardlight.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail the base rules or the trees go."""
    return quality_filter(docs, quality_model(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Order MinHash: one document of each class of near copies stays."""
    small_batches(spark)
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash windows: documents that hold a benchmark item go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Random forest: secrets are masked in the texts, and ``n_chars`` follows there."""
    small_batches(spark)
    clean = redacted(docs, secret_model(docs))
    length = F.when(F.contains("text", F.lit("[secret]")), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Minimum bin slack: what is left, as pieces of packed sequences."""
    small_batches(spark)
    return best_fit_packing(docs, word_tokenizer())


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]
ORACLE_SQL = None  # boosted trees, sketches, forests and bin plans are not SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
