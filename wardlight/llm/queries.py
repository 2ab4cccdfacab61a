"""Registered queries of the operators in this subpackage and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm import oracles
from wardlight.llm.chat import chat_digest, chat_windows
from wardlight.llm.decontaminate import contamination
from wardlight.llm.order_minhash import near_duplicates
from wardlight.llm.lexical import lexical_search
from wardlight.llm.orchard import orchard_clusters
from wardlight.llm.packing import best_fit_packing
from wardlight.llm.pseudo_likelihood import pseudo_likelihood, pseudo_likelihood_model
from wardlight.llm.quality import COUNTS, quality_model, quality_rules
from wardlight.llm.secret_forest import secret_findings, secret_model
from wardlight.llm.sharding import grown, shard_rows, tree
from wardlight.llm.substring import substring_dedup
from wardlight.llm.text import small_batches
from wardlight.llm.toxicity import toxicity_model, toxicity_scores
from wardlight.llm.zip_warc import read_packages, write_packages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_k")


def op2_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_findings(docs, secret_model(docs))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op4_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_packages(write_packages(table(spark, sf_dir, "pages")))
    return back.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_digest(chat_windows(turns.unionByName(hard)))


def word_tokenizer() -> str:
    """Path of the public word tokenizer on this installation."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return quality_rules(docs, model).select("doc_id", *COUNTS, "base_failed", "kept", "score")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), word_tokenizer())


def op8_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    eight = tree(8)
    return shard_rows(table(spark, sf_dir, "documents"), eight, grown(eight)).withColumn("law", F.lit("key"))


def op9_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pseudo_likelihood(docs, pseudo_likelihood_model(docs))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


def op11_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def op12_orchard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard_clusters(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_decontamination": op1_simhash_decontamination,
    "op2_secret_forest": op2_secret_forest,
    "op3_order_minhash": op3_order_minhash,
    "op4_zip_warc": op4_zip_warc,
    "op5_chat_windows": op5_chat_windows,
    "op6_quality_rules": op6_quality_rules,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_hash_tree_sharding": op8_hash_tree_sharding,
    "op9_pseudo_likelihood": op9_pseudo_likelihood,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_toxicity_machine": op11_toxicity_machine,
    "op12_orchard_clusters": op12_orchard_clusters,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES: dict[str, str] = {
    "op1_simhash_decontamination": oracles.CONTAMINATION,
    "op10_substring_dedup": oracles.SUBSTRING,
    "op12_orchard_clusters": oracles.clusters(),
    "op13_lexical_search": oracles.SEARCH,
}
