"""Corpus pipeline: quality rules, quality classifier, near-duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept; all but the last
return the columns of documents. ``run`` writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagekit.llm import fm, pack, rules, simhash
from triagekit.sources.store import materialize

QUALITY_AT = 0.5
SEQUENCE, PACK_END = 2048, 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return rules.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least one half, by a model of the labelled documents.

    The model sees all of them, also those that the rules rejected: what is left may hold no bad ones.
    """
    documents, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    machine = fm.fit_quality(documents, labels, F.lit(True))
    return docs.where(fm.quality_score(docs, machine) >= QUALITY_AT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs, words_each=3, radius=2)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return pack.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), SEQUENCE, PACK_END)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]

#: Tokenisation and fitted models are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
