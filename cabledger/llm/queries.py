"""The text operators applied to the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cabledger.llm import (decontaminate, line_dedup, main_text, mixing, quality, secrets, simhash, sql, token_alignment, token_counts,
                           toxicity, url_filter, whitening, winnowing)

TOKEN_LIMIT = 2048
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]
TOXIC_FROM, GOOD_FROM = 0.5, 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "score", "verdict")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")  # a second parameter would be the position
    each = [count(k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return found.select(F.col("id").alias("doc_id"), *each, F.sha2(secrets.span_text(F.col("base")), 256).alias("base_sha256"),
                        secrets.span_text(F.col("spans")).alias("spans"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprints(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return drawn.select("doc_id", "source", "lang", "topic", "tokens", "weight", "copies")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return found.withColumnsRenamed({"id": "doc_id", "groups": "groups_sha256"})


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_line_dedup": op2_line_dedup,
    "op3_secrets": op3_secrets,
    "op4_toxicity": op4_toxicity,
    "op5_winnowing": op5_winnowing,
    "op6_decontaminate": op6_decontaminate,
    "op7_quality": op7_quality,
    "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing,
    "op10_simhash": op10_simhash,
    "op11_token_alignment": op11_token_alignment,
    "op12_main_text": op12_main_text,
    "op13_whitening": op13_whitening,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {"op6_decontaminate": sql.OP6}
