import pytest
from pyspark.sql import functions as F

from triagekit.constants import STOP_WORDS
from triagekit.functions import text as fx
from triagekit.operators.clean import check_requests, clean_labelled
from triagekit.operators.vectorize import add_terms


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "raw", ["  a b ", " a b ", "\t\na b\x1c", "a b"]
)
def test_strip_takes_all_white_space(spark, raw):
    assert one(spark, raw, fx.strip) == raw.strip() == "a b"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("The Été x ab_1, 12", ["the", "été", "ab_1", "12"]),
        ("", []),
        ("a b c", []),
        ("don't", ["don"]),
    ],
)
def test_tokens(spark, raw, want):
    assert one(spark, raw, fx.tokens) == want


def test_stop_words_are_those_of_spark_that_can_be_tokens(spark):
    from pyspark.ml.feature import StopWordsRemover

    words = StopWordsRemover.loadDefaultStopWords("english")
    assert tuple(w for w in words if len(w) > 1 and "'" not in w) == STOP_WORDS


def test_stop_words_go_before_pairs_are_made(spark):
    df = spark.createDataFrame([(1, "lost the card"), (2, "card"), (3, "the")], "doc_id int, t string")
    got = {r.doc_id: r.terms for r in fx.term_list(df, "t", "terms", 2, STOP_WORDS).collect()}
    assert got == {1: ["lost", "card", "lost card"], 2: ["card"], 3: []}


def test_term_counts_match_a_counter(spark):
    from collections import Counter

    texts = ["bb aa bb cc aa bb", "", None, "aa", "zz zz zz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, ticket_text string")
    for r in add_terms(df, stop_words=()).collect():
        text = texts[r.doc_id]
        want = None if text is None else dict(Counter(text.split()))
        assert (r.terms and {t.term: t.tf for t in r.terms}) == (want or r.terms)
        assert text is None or len(r.terms) == len(want)


def test_clean_drops_nulls_and_blanks(spark):
    rows = [("ok ", " a"), (None, "a"), ("x", None), ("  ", "a"), ("x", " "), ("null", "b")]
    got = clean_labelled(spark.createDataFrame(rows, "ticket_text string, category string")).collect()
    assert sorted(map(tuple, got)) == [("null", "b"), ("ok", "a")]


@pytest.mark.parametrize(
    "text, reason, clean",
    [
        (None, "empty", None), ("   ", "empty", None), ("a" * 5000, None, "a" * 5000), ("a" * 5001, "too_long", None),
        (" " * 6000, "empty", None), (" ok ", None, "ok"), (" " * 10 + "a" * 4995, "too_long", None),
    ],
)
def test_request_checks(spark, text, reason, clean):
    r = check_requests(spark.createDataFrame([(text,)], "text string")).first()
    assert (r.reject_reason, r.clean_text) == (reason, clean)


@pytest.mark.parametrize(
    "raw, want",
    [
        ("order_physical_card", "Order Physical Card"), ("Refund_not_showing_up", "Refund Not Showing Up"),
        ("reverted_card_payment?", "Reverted Card Payment?"), ("aBC", "ABC"),
    ],
)
def test_display_label(spark, raw, want):
    assert one(spark, raw, fx.display_label) == want
