"""Joins of term rows with a table keyed by term: broadcast when measured small; where both lie in the same
buckets, without a shuffle; salted otherwise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagekit.session import setting

BROADCAST_BYTES = 64 * 1024 * 1024
ROWS_PER_SALT = 2_000_000
MAX_HOT_TERMS = 100_000
NULL_SALTS = 1024


@dataclass(frozen=True)
class TermTable:
    """A written table keyed by ``term``, with what its joins need to know about its size.

    ``buckets``: the table is written in so many buckets of terms (0: in no order). ``rows_behind`` is the number of fact rows that the table's ``total`` column adds up to. A term with
    more than a salt's rows of them is *hot*. A salt takes ``rowsPerSalt`` rows, or more where the facts
    are so many that over ``maxHotTerms`` terms could exceed that; so the list of hot terms never has
    more rows than that, however large the data.
    """

    df: DataFrame
    rows: int
    bytes: int
    rows_behind: int
    buckets: int = 0

    @classmethod
    def measure(cls, df: DataFrame, row_width: int, buckets: int = 0) -> TermTable:
        """Count rows and estimate bytes of a written table with columns ``term`` and ``total``.

        ``row_width`` is the size of the other columns. A table may have several rows per term; the
        fact rows behind a term are counted once, on the row where ``lead`` is true.
        """
        lead = F.col("lead") if "lead" in df.columns else F.lit(True)
        size = F.coalesce(F.sum(F.octet_length("term") + 48 + row_width), F.lit(0))
        behind = F.coalesce(F.sum(F.when(lead, F.col("total"))), F.lit(0))
        row = df.agg(F.count("*"), size, behind).first()
        return cls(df, int(row[0]), int(row[1]), int(row[2]), buckets)

    def fits_broadcast(self) -> bool:
        """Small enough to copy to every executor; one thread builds the copy, so the limit is modest."""
        return self.bytes <= setting(self.df.sparkSession, "broadcastBytes", BROADCAST_BYTES)

    def hot_terms(self) -> DataFrame:
        spark = self.df.sparkSession
        least = -(-self.rows_behind // setting(spark, "maxHotTerms", MAX_HOT_TERMS))
        per_salt = max(setting(spark, "rowsPerSalt", ROWS_PER_SALT), least)
        rows = self.df.where("lead") if "lead" in self.df.columns else self.df
        return rows.where(F.col("total") > per_salt).select(
            "term", F.ceil(F.col("total") / per_salt).cast("int").alias("n_salts")
        )


def join_terms(facts: DataFrame, table: TermTable, columns: list[str | Column], spread_by: str, how: str = "left") -> DataFrame:
    """Join ``facts`` with ``columns`` of ``table`` on ``term``.

    Beyond the broadcast limit the join is shuffled on ``(term, salt)``: rows of a hot term are
    spread over as many salts as it needs tasks, and only its few table rows are repeated. Rows
    without a term (empty texts) are spread as well; they match nothing. A table in buckets needs no salt:
    the facts lie in the same buckets, or are put into as many.
    """
    right = table.df.select("term", *columns)
    if table.buckets:
        return facts.repartition(table.buckets, "term").join(right, "term", how)
    if table.fits_broadcast():
        return facts.join(F.broadcast(right), "term", how)
    hot = F.broadcast(table.hot_terms())
    salts = F.when(F.col("term").isNull(), NULL_SALTS).otherwise(F.coalesce("n_salts", F.lit(1)))
    salted = facts.join(hot, "term", "left").withColumn("salt", F.pmod(F.xxhash64(spread_by), salts).cast("int"))
    repeated = right.join(hot, "term", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce("n_salts", F.lit(1)) - 1))
    )
    return salted.drop("n_salts").join(repeated.drop("n_salts"), ["term", "salt"], how).drop("salt")
