"""Text expressions. All of them are built-in column expressions; nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagekit.constants import STRIP_PATTERN, TOKEN_PATTERN


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` would remove blanks only)."""
    return F.regexp_replace(text, STRIP_PATTERN, "")


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN_PATTERN})"), 1)


def without(words: Column, stop_words: Iterable[str]) -> Column:
    """Drop stop words; the list becomes one hash set inside the plan."""
    stop = list(stop_words)
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def with_bigrams(words: Column) -> Column:
    """The words followed by all pairs of neighbours joined by a blank."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(words, F.lit(1), n),
        F.slice(words, F.lit(2), n),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(words, pairs)


def term_list(df: DataFrame, text: str, out: str, ngram_max: int, stop_words) -> DataFrame:
    """Add the ordered term list of ``text``. Words are their own column so they are cut once."""
    df = df.withColumn(out, without(tokens(F.col(text)), stop_words))
    return df.withColumn(out, with_bigrams(F.col(out))) if ngram_max > 1 else df


def count_terms(df: DataFrame, terms: str, out: str) -> DataFrame:
    """Replace a term list by ``array<struct<term, tf>>``.

    A row holds its whole text, so counting needs no shuffle: sort the list, find where runs of
    equal terms start, and read each run's length off the next start.
    """
    n = F.size("_sorted")
    at = lambda i: F.get(F.col("_sorted"), i)  # noqa: E731 - null outside the list
    starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(
        F.filter(F.sequence(F.lit(1), n), lambda i: ~at(i - 1).eqNullSafe(at(i - 2)))
    )
    runs = F.transform(
        F.col("_starts"),
        lambda start, j: F.struct(
            F.element_at("_sorted", start).alias("term"),
            (F.coalesce(F.get(F.col("_starts"), j + 1), n + 1) - start).cast("int").alias("tf"),
        ),
    )
    return (
        df.withColumn("_sorted", F.sort_array(terms))
        .withColumn("_starts", starts)
        .withColumn(out, runs)
        .drop("_sorted", "_starts")
    )


def display_label(label: Column) -> Column:
    """``a_b`` -> ``A B``: blanks for underscores, first ASCII letter of each word in capitals.

    The split points are the empty matches in front of each word that starts with a small letter,
    so the rest of the text stays as it is.
    """
    pieces = F.split(F.replace(label, F.lit("_"), F.lit(" ")), r"(?<![A-Za-z0-9])(?=[a-z])")
    return F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(
                p.rlike("^[a-z]"), F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))
            ).otherwise(p),
        ),
        "",
    )


def percent(share: Column) -> Column:
    """Whole-number percentage; halves go to the even number."""
    return F.bround(share * 100).cast("int")


def summary_line(needs_review: Column, top_label: Column, confidence: Column) -> Column:
    """One line of text that says what became of a row."""
    pct = percent(confidence).cast("string")
    return F.when(
        needs_review,
        F.concat(F.lit("NEEDS REVIEW (top guess '"), top_label, F.lit("' at only "), pct, F.lit("% confidence)")),
    ).otherwise(F.concat(F.lit("Predicted category: "), top_label, F.lit(" ("), pct, F.lit("% confidence)")))
