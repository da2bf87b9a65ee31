"""The labelled-text views of the test tables: ``(doc_id, ticket_text, category)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagekit.sources.labelled import scan


def table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    return scan(spark, f"{sf_dir}/{name}.parquet", key)


def t_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id").select(
        "doc_id", F.col("text").alias("ticket_text"), F.col("lang").alias("category")
    )


def t_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id").select("doc_id", F.col("text").alias("ticket_text"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("category"))
    return docs.join(labels, "doc_id")


def t_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations", "conv_id").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"),
        F.col("text").alias("ticket_text"),
        F.col("role").alias("category"),
    )


def t_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings", "vec_id").select(
        F.col("vec_id").alias("doc_id"), "embedding", F.col("label").cast("string").alias("category")
    )
