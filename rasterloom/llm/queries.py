"""The registered queries over the driver's tables, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import decontaminate, exact_substrings, html_text, language_id, lm_score, near_dup, oracle, packing, sharding, topk, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn(docs))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op3_exact_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of strings of 400 bytes, and how many passages of over 50 words are repeated, by windows of 200 bytes."""
    return exact_substrings.duplicates(_table(spark, sf_dir, "documents"), exact_substrings.Params(passage=200, hot=16_384)).drop("spans")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).withColumn("score", F.round("score", 6))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lm_score.score(docs, lm_score.train(docs))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_html_text, op3_exact_substrings, op4_url_filter, op5_lm_score, op6_sharding, op7_topk_search, op8_decontamination, op9_packing, op10_near_dup)}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_substrings": oracle.OP3, "op4_url_filter": oracle.op4(4), "op7_topk_search": oracle.OP7, "op8_decontamination": oracle.OP8, "op10_near_dup": oracle.OP10}
