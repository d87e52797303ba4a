"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe, chat, embedding, langid, media, minhash, mixing, quality, sharding, substring


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.93)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"), 24)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.encode_texts(_table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(*langid.sample(docs)))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ids=False)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(*quality.sample(docs, _table(spark, sf_dir, "labels"))))


def queries() -> dict:
    return {f.__name__: f for f in (op1_substring, op2_mixing, op3_embedding, op4_sharding, op5_media, op6_chat, op7_language, op8_bpe, op9_minhash, op10_quality)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring": substring.ORACLE,
        "op2_mixing": mixing.ORACLE,
        "op3_embedding": embedding.ORACLE,
        "op4_sharding": sharding.ORACLE,
        "op6_chat": chat.ORACLE,
        "op9_minhash": minhash.ORACLE,
    }
