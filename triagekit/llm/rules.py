"""Quality rules as weak supervision.

Each rule votes for a text (1), against it (-1) or abstains (0). Expectation-maximisation over the
vote patterns of all documents that pass the base rules estimates, without labels, the share of good texts and how often each
rule is right on good and on bad texts when it votes; a document is kept when the posterior probability
that it is good is at least one half. As a pattern decides the posterior, documents are counted by
pattern first: at most 3 to the power of the number of rules, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagekit.llm.structure import Structure, structure
from triagekit.sources.store import materialize

MIN_WORDS = 50
MOST_REPEAT_PERCENT = 50
KEEP_AT = 0.5
#: What the first vote against a text leaves of the belief that it is good, before the first round.
DOUBT = 0.2


@dataclass(frozen=True)
class Rule:
    """Votes against a text when its ratio is outside ``ok``, for it when the ratio is inside ``good``."""

    name: str
    top: str
    bottom: str
    good: tuple[float, float]
    ok: tuple[float, float]

    def vote(self, s: Structure) -> int:
        below = getattr(s, self.bottom)
        if below == 0:
            return 0
        x = getattr(s, self.top) / below
        if not self.ok[0] <= x <= self.ok[1]:
            return -1
        return int(self.good[0] <= x <= self.good[1])


NO_LIMIT = float("inf")
#: Ratios of structure counts, with what speaks for a text and what does not speak against it. What depends on
#: blanks between words abstains where the script has none.
RULES = (
    Rule("repeats", "n_repeat_words", "n_words", (0.0, 0.1), (0.0, 0.3)),
    Rule("symbols", "n_symbols", "n_words", (0.0, 0.02), (0.0, 0.1)),
    Rule("copied_lines", "n_dup_lines", "n_lines", (0.0, 0.1), (0.0, 0.3)),
    Rule("word_length", "word_chars", "n_spaced", (3.0, 9.0), (2.0, 13.0)),
    Rule("upper_case", "n_capitals", "n_alphabetic", (0.0, 0.1), (0.0, 0.3)),
    Rule("short_words", "n_brief", "n_spaced", (0.15, 0.8), (0.05, 0.95)),
    Rule("sentences", "n_ends", "n_spaced", (0.02, 0.25), (0.005, 0.5)),
    Rule("no_letters", "n_bare", "n_words", (0.0, 0.05), (0.0, 0.2)),
    Rule("variety", "n_distinct", "n_words", (0.2, 1.0), (0.08, 1.0)),
)

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FAILED = f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MOST_REPEAT_PERCENT} * n_words"
FEATURES = f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, votes string"


def votes_of(s: Structure, rules: tuple[Rule, ...] = RULES) -> str:
    """One character per rule: + for, - against, 0 abstains."""
    return "".join("-0+"[r.vote(s) + 1] for r in rules)


def base_failed(s: Structure) -> bool:
    return s.n_words < MIN_WORDS or 100 * s.n_repeat_words > MOST_REPEAT_PERCENT * s.n_words


def document_votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and votes per row; a null text has no words, on which all rules abstain."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [structure(t.as_py()) for t in batch.column(1)]
            counts = [pa.array([getattr(s, c) for s in found], pa.int64()) for c in COUNTS]
            votes = pa.array([votes_of(s) for s in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, votes], names=["doc_id", *COUNTS, "votes"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, FEATURES)


@dataclass(frozen=True)
class LabelModel:
    """Share of good texts and, per rule, the chance to be right on good and on bad texts when it votes."""

    prior: float
    right_on_good: np.ndarray
    right_on_bad: np.ndarray

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """Probability that a text with this vote pattern is good."""
        log_odds = np.full(len(patterns), np.log(self.prior / (1 - self.prior)))
        for j, (a, b) in enumerate(zip(self.right_on_good, self.right_on_bad)):
            vote = np.array([p[j] for p in patterns])
            log_odds += np.where(vote == "+", np.log(a / (1 - b)), np.where(vote == "-", np.log((1 - a) / b), 0.0))
        return 1 / (1 + np.exp(-log_odds))


def fit_label_model(counts: dict[str, int], rules: int = len(RULES), rounds: int = 200, smooth: float = 5.0) -> LabelModel:
    """Expectation-maximisation over counted vote patterns.

    Most texts pass most rules, so a vote for a text says little and one against it much: the rounds start
    by doubting each text in proportion to the votes against it (``DOUBT``). The smoothing takes each rule
    to have been right four times in five on ``smooth`` texts of either kind, which also fixes which of the
    two kinds is the good one. Without any pattern, that assumption is the model.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    votes = np.array([["-0+".index(c) - 1 for c in p] for p in patterns], float).reshape(len(patterns), rules)
    good = 0.95 * DOUBT ** (votes < 0).sum(1)
    model = LabelModel(0.5, np.full(rules, 0.8), np.full(rules, 0.8))
    for _ in range(rounds if patterns else 0):
        g, b = n * good, n * (1 - good)
        plus, minus = votes > 0, votes < 0
        model = LabelModel(
            float((g.sum() + 1) / (n.sum() + 2)),
            (g @ plus + 0.8 * smooth) / (g @ (plus | minus) + smooth),
            (b @ minus + 0.8 * smooth) / (b @ (plus | minus) + smooth),
        )
        before, good = good, model.posterior(patterns)
        if np.abs(good - before).max() < 1e-9:
            break
    return model


def pattern_counts(votes: DataFrame) -> dict[str, int]:
    """Documents per vote pattern, of those that pass the base rules and so need a verdict; few rows, as
    a pattern is one of three letters per rule."""
    return {r["votes"]: r["n"] for r in votes.where(f"not ({FAILED})").groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, votes, posterior and verdict of every row.

    Repeated rows and null ids are judged like others; a text without words fails the base rules. An
    empty table gives no rows. Other columns are ignored.
    """
    table = materialize(document_votes(docs, id_col, text_col), "votes")
    model = fit_label_model(pattern_counts(table))
    patterns = [r["votes"] for r in table.select("votes").distinct().collect()]  # few, as above
    spark = docs.sparkSession
    known = spark.createDataFrame(
        [(p, float(x)) for p, x in zip(patterns, model.posterior(patterns))], "votes string, posterior double"
    )
    return (
        table.join(F.broadcast(known), "votes")  # as few rows as there are patterns
        .withColumn("base_failed", F.expr(FAILED))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_AT))
        .select("doc_id", *COUNTS, "base_failed", "kept", "posterior", "votes")
    )


def keep(model: LabelModel, text: Column) -> Column:
    """Whether a text passes the base rules and the fitted model; for use in a filter."""
    known: dict[str, bool] = {}

    def verdict(text: str | None) -> bool:
        s = structure(text)
        votes = votes_of(s)
        if votes not in known:
            known[votes] = bool(model.posterior([votes])[0] >= KEEP_AT)
        return known[votes] and not base_failed(s)

    @F.pandas_udf("boolean")
    def passes(texts: pd.Series) -> pd.Series:
        return texts.map(verdict)

    return passes(text)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with all their columns; rows stay where they are."""
    model = fit_label_model(pattern_counts(document_votes(docs, id_col, text_col)))
    return docs.where(keep(model, F.col(text_col)))
