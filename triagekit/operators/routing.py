"""Scored texts to answers and routes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagekit.constants import CONFIDENCE_THRESHOLD, REVIEW_LABEL, TOP_K
from triagekit.functions.text import summary_line
from triagekit.operators.clean import check_requests
from triagekit.operators.ranking import confidence, top_k, top_label
from triagekit.operators.thresholds import is_low_confidence
from triagekit.sources.store import materialize


def answer(df: DataFrame, threshold: float = CONFIDENCE_THRESHOLD, k: int = TOP_K, ranked: str = "ranked") -> DataFrame:
    """Add the answer columns to ranked rows.

    The review flag looks at the unrounded confidence; rounding is for output only.
    """
    conf = confidence(ranked)
    flag = is_low_confidence(conf, threshold)
    return df.select(
        *[c for c in df.columns if c != ranked],
        F.when(flag, REVIEW_LABEL).otherwise(top_label(ranked)).alias("category"),
        F.round(conf, 4).alias("confidence"),
        flag.alias("needs_review"),
        top_k(ranked, k).alias("top_k"),
    )


def classify(
    requests: DataFrame,
    score: Callable[..., DataFrame],
    threshold: float = CONFIDENCE_THRESHOLD,
    k: int = TOP_K,
) -> DataFrame:
    """Answer a table ``(doc_id, text)``; rows that cannot be scored come back with their reason.

    ``score`` turns ``(doc_id, ticket_text, reject_reason, request_id)`` into ``(doc_id,
    reject_reason, request_id, ranked)``; it may sum over the rows of a ``doc_id``. Each row goes
    through it under a number of its own, so that callers may repeat ids or leave them null. The numbered
    rows are written first: an input that is computed again after a loss may come in another order, and
    words of two requests must not meet under one number. A stream is scored row by row and keeps its
    ids. Rejected rows go through with a null text, which costs nothing, so the input is read once and
    nothing has to be joined back.
    """
    own = F.col("doc_id") if requests.isStreaming else F.monotonically_increasing_id()
    checked = check_requests(requests).select(
        own.alias("doc_id"), F.col("clean_text").alias("ticket_text"), "reject_reason", F.col("doc_id").alias("request_id")
    )
    if not requests.isStreaming:
        checked = materialize(checked, "requests")
    scored = score(checked, "request_id").select(F.col("request_id").alias("doc_id"), "reject_reason", "ranked")
    ok = F.col("reject_reason").isNull()
    answers = answer(scored, threshold, k)
    return answers.select(
        "doc_id",
        *[F.when(ok, F.col(c)).alias(c) for c in ("category", "confidence", "needs_review", "top_k")],
        "reject_reason",
        route(F.col("needs_review"), F.col("reject_reason")).alias("route"),
    )


def route(needs_review: Column, reason: Column) -> Column:
    return F.when(reason.isNotNull(), "rejected").when(needs_review, REVIEW_LABEL).otherwise("accepted")


def route_counts(answers: DataFrame) -> DataFrame:
    return answers.groupBy("route").agg(F.count("*").alias("count"))


def write_routes(answers: DataFrame, path: str) -> None:
    """One write, one folder per route."""
    answers.write.mode("overwrite").partitionBy("route").parquet(path)


def response_json(answers: DataFrame) -> DataFrame:
    """Answers as JSON text in the response's field order."""
    return answers.select(
        "doc_id", F.to_json(F.struct("category", "confidence", "needs_review", "top_k")).alias("response")
    )


def with_summary(answers: DataFrame) -> DataFrame:
    top = F.get("top_k", F.lit(0))["category"]
    return answers.withColumn("summary", summary_line(F.col("needs_review"), top, F.col("confidence")))
