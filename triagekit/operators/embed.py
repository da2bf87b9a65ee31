"""Text embeddings from a supplied encoder, and a classifier on top of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagekit.constants import ENCODE_BATCH, HEAD_C
from triagekit.operators.logistic import fit_head, head_oof, index_labels, ranked_by_head
from triagekit.operators.profile import label_list


def encode_texts(
    df: DataFrame, make_encoder: Callable[[], Callable], text: str = "ticket_text", out: str = "embedding",
    batch_size: int = ENCODE_BATCH,
) -> DataFrame:
    """Add the vectors of an encoder, in Arrow batches.

    ``make_encoder`` runs once per Python worker and returns a function from an array of texts to a
    2-d float array. The encoder itself (weights, runtime) belongs to the caller.
    """
    encode = predict_batch_udf(make_encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn(out, encode(F.col(text)))


def embedding_rows(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(embedding).cast("array<double>")))


def embedding_oof(dev: DataFrame, folds: int, C: float = HEAD_C, embedding: str = "embedding") -> DataFrame:
    """Out-of-fold ranked probabilities of a logistic head on embeddings."""
    return head_oof(embedding_rows(dev, embedding).select("doc_id", "category", "fold", "features"), folds, C)


def fit_embedding_head(train: DataFrame, C: float = HEAD_C) -> tuple[LogisticRegressionModel, list[str]]:
    labels = label_list(train, least=2)
    rows = index_labels(embedding_rows(train), labels).select("label", "features").persist()
    model = fit_head(rows, rows.count(), C)
    rows.unpersist()
    return model, labels


def score_embeddings(model: LogisticRegressionModel, labels: list[str], df: DataFrame, *keep: str) -> DataFrame:
    return ranked_by_head(model, embedding_rows(df), labels, *keep)
