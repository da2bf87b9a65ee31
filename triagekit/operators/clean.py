"""Cleaning of labelled texts and checking of incoming texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagekit.constants import KEPT_CHARACTER, MAX_TEXT_CHARS
from triagekit.functions.text import strip


def clean_labelled(df: DataFrame, text: str = "ticket_text", label: str = "category") -> DataFrame:
    """Drop rows without text or label; drop rows where stripping leaves nothing; strip both.

    The filter looks for one character that stripping keeps, which ends at the start of most texts;
    jobs that need ids and labels only never run the replacement.
    """
    df = df.na.drop(how="any", subset=[text, label])
    for column in (text, label):
        df = df.where(F.col(column).cast("string").rlike(KEPT_CHARACTER))
    for column in (text, label):
        df = df.withColumn(column, strip(F.col(column).cast("string")))
    return df


def reject_reason(text: Column, max_chars: int = MAX_TEXT_CHARS) -> Column:
    """Why a text cannot be scored, or null. Blank is tested first; length counts blanks too."""
    return F.when(text.isNull() | ~text.rlike(KEPT_CHARACTER), "empty").when(F.length(text) > max_chars, "too_long")


def check_requests(df: DataFrame, text: str = "text", max_chars: int = MAX_TEXT_CHARS) -> DataFrame:
    """Add ``reject_reason`` (null = accepted) and ``clean_text`` (null = rejected). What parsing has
    found (``request_error``, if there is such a column) is the reason before any other."""
    reason = reject_reason(F.col(text), max_chars)
    if "request_error" in df.columns:
        reason = F.coalesce("request_error", reason)
    df = df.withColumn("reject_reason", reason)
    return df.withColumn("clean_text", F.when(F.col("reject_reason").isNull(), strip(F.col(text))))
