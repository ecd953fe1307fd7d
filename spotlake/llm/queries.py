"""The queries of this subpackage and the SQL that says what some of them return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spotlake.llm import byte_bpe, chat_format, exact_dedup, language_id, language_model, minhash, mixing, pivot_index, secret_scan, token_shards


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.digest(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.in_training_order(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(_table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trips(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.read_back(chat_format.windows(chat_format.with_probe(_table(spark, sf_dir, "conversations"))))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.SQL, "op7_pivot_index": pivot_index.SQL, "op10_chat_format": chat_format.SQL}
