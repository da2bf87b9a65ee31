"""Term counts, document frequencies and TF-IDF weights, per training part.

*Parts.* Every row carries ``part``: the part it is held out from (-1: from none). Statistics come
as arrays with one entry per part, entry ``p`` taken over the rows whose part is not ``p``. Folds of
a cross-validation are parts 0..k-1; a holdout is part 0 with the development rows at -1; a plain
fit is one part that no row belongs to. So each job reads every row once, however many parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagekit.constants import STOP_WORDS
from triagekit.functions.text import count_terms, term_list
from triagekit.operators.lookup import BROADCAST_BYTES, TermTable, join_terms
from triagekit.session import setting
from triagekit.sources.store import materialize, materialize_buckets

#: Term rows that are put into buckets, and the size of a bucket.
BUCKETED_ROWS = 1_000_000
ROWS_PER_BUCKET = 2_500_000
#: Vector lengths up to this size are copied to every executor.
NORM_BYTES = 128 * 1024 * 1024


def add_terms(df: DataFrame, text: str = "ticket_text", ngram_max: int = 1, stop_words=STOP_WORDS) -> DataFrame:
    """Replace the text by ``terms array<struct<term, tf>>``."""
    listed = term_list(df, text, "_terms", ngram_max, stop_words)
    return count_terms(listed, "_terms", "terms").drop("_terms", text)


def term_rows(features: DataFrame, *keep: str, outer: bool = False) -> DataFrame:
    """One row per document and term. ``outer`` keeps documents without terms.

    Always an outer explode: for an inner one Catalyst infers a filter on the size of the array and
    pushes it below the steps that build the array, which would then be built twice.
    """
    rows = features.select(*keep, F.explode_outer("terms").alias("_t")).select(*keep, "_t.term", "_t.tf")
    return rows if outer else rows.where(F.col("term").isNotNull())


@dataclass(frozen=True)
class Facts:
    """``doc_id, category, part, term, tf`` of all documents, written once in buckets of terms.

    Counts, idf joins, class sums and scores of a study read these files as they lie: a term's rows and its row in
    any model table are in buckets of the same number. What moves is one partial sum per document and bucket.
    """

    df: DataFrame
    buckets: int


def term_facts(features: DataFrame, parts: int = 1) -> Facts | None:
    """Term rows in buckets; none where tables of the terms are small enough to be copied instead."""
    spark = features.sparkSession
    rows = features.agg(F.sum(F.greatest(F.size("terms"), F.lit(0)))).first()[0] or 0
    if rows <= setting(spark, "bucketedRows", BUCKETED_ROWS):
        return None
    terms = term_rows(features).agg(F.approx_count_distinct("term")).first()[0]
    if terms * (64 + 8 * parts) <= setting(spark, "broadcastBytes", BROADCAST_BYTES):
        return None
    buckets = max(spark.sparkContext.defaultParallelism, -(-rows // setting(spark, "rowsPerBucket", ROWS_PER_BUCKET)))
    named = features if "category" in features.columns else features.withColumn("category", F.lit(None).cast("string"))
    facts = term_rows(named, "doc_id", "category", "part")
    return Facts(materialize_buckets(facts, "term-facts", "term", buckets), buckets)


def write_terms(df: DataFrame, name: str, facts: Facts | None) -> DataFrame:
    """A table with rows by term, in the buckets of the facts where there are any."""
    return materialize_buckets(df, name, "term", facts.buckets) if facts else materialize(df, name)


def smooth_idf(n: Column, df: Column) -> Column:
    return F.ln((n + 1.0) / (df + 1.0)) + 1.0


@dataclass(frozen=True)
class DocFrequency:
    """Documents per term: ``term, total`` and ``own_p``, the documents held out from part ``p``."""

    table: TermTable
    n_train: list[int]

    @property
    def parts(self) -> int:
        return len(self.n_train)


@dataclass(frozen=True)
class TermRule:
    """Which terms a vectoriser uses."""

    ngram_max: int = 1
    min_df: int = 1

    def allows(self, df: Column) -> Column:
        rule = df >= max(self.min_df, 1)
        return rule if self.ngram_max > 1 else rule & (F.instr("term", " ") == 0)


def train_df(part: int) -> Column:
    return F.col("total") - F.col(f"own_{part}")


def train_idf(part: int, n_train: list[int]) -> Column:
    """Smoothed idf of a part; null for a term that its training rows do not have."""
    df = train_df(part)
    return F.when(df > 0, smooth_idf(F.lit(n_train[part]), df))


def slots(parts: int, rules: list[TermRule]) -> list[tuple[int, TermRule]]:
    """All (part, rule) pairs; their place in this list is their slot number."""
    return [(p, rule) for p in range(parts) for rule in rules]


def train_sizes(features: DataFrame, parts: int) -> list[int]:
    row = features.agg(*[F.count_if(F.col("part") != p) for p in range(parts)]).first()
    return [int(x) for x in row]


def doc_frequency(features: DataFrame, parts: int = 1, facts: Facts | None = None) -> DocFrequency:
    """Count documents per term once; a part's own documents come off the total."""
    rows = facts.df if facts else term_rows(features, "part")
    counts = rows.groupBy("term").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("part") == p).alias(f"own_{p}") for p in range(parts)]
    )
    written = write_terms(counts, "doc-frequency", facts)
    return DocFrequency(TermTable.measure(written, 8 * parts, facts.buckets if facts else 0), train_sizes(features, parts))


def doc_norms(
    features: DataFrame, freq: DocFrequency, rules: list[TermRule], own_part: bool = False, facts: Facts | None = None
) -> DataFrame:
    """``(doc_id, norm_0, ...)``: lengths of the TF-IDF vectors, one per slot.

    Only vectors that training needs are computed: a row is not measured for its own part, unless
    ``own_part`` asks for that.
    """
    pairs = slots(freq.parts, rules)
    idf = [
        F.when(rule.allows(train_df(p)), train_idf(p, freq.n_train)).alias(f"idf_{i}")
        for i, (p, rule) in enumerate(pairs)
    ]
    rows = facts.df.select("doc_id", "part", "term", "tf") if facts else term_rows(features, "doc_id", "part")
    met = join_terms(rows, freq.table, idf, "doc_id", "inner")
    sums = []
    for i, (p, _) in enumerate(pairs):
        u = F.col("tf") * F.col(f"idf_{i}")
        sums.append(F.sqrt(F.sum(u * u if own_part else F.when(F.col("part") != p, u * u))).alias(f"norm_{i}"))
    return met.groupBy("doc_id").agg(*sums)


def with_norms(facts: Facts, norms: DataFrame) -> DataFrame | None:
    """Term rows with their document's vector lengths, where those are few enough to be copied; else none."""
    limit = setting(norms.sparkSession, "normBytes", NORM_BYTES)
    if norms.count() * (32 + 8 * len(norms.columns)) > limit:
        return None
    return facts.df.join(F.broadcast(norms), "doc_id")


def tfidf_weights(
    features: DataFrame, freq: DocFrequency, rule: TermRule = TermRule(), facts: Facts | None = None
) -> DataFrame:
    """Unit-length TF-IDF rows ``(doc_id, term, tf, weight)`` for part 0's statistics.

    Documents without a known term have no row.
    """
    norms = doc_norms(features, freq, [rule], own_part=True, facts=facts)
    idf = F.when(rule.allows(train_df(0)), train_idf(0, freq.n_train)).alias("idf")
    if facts:
        norms = materialize(norms, "norms")
        rows = with_norms(facts, norms)
        known = join_terms(facts.df if rows is None else rows, freq.table, [idf], "doc_id", "inner").where("idf IS NOT NULL")
        known = known if rows is not None else known.select("doc_id", "term", "tf", "idf").join(norms, "doc_id")
    else:
        rows = term_rows(features.join(norms, "doc_id"), "doc_id", "norm_0")
        known = join_terms(rows, freq.table, [idf], "doc_id", "inner").where("idf IS NOT NULL")
    return known.select("doc_id", "term", "tf", (F.col("tf") * F.col("idf") / F.col("norm_0")).alias("weight"))
