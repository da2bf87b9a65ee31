"""From class scores to ranked probabilities, and from those to a row's label and confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagekit.constants import TOP_K


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once per row and use it inside ``body``.

    A lambda would otherwise compute an outer expression again for every element of its array.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rank_classes(df: DataFrame, scores: str, out: str = "ranked") -> DataFrame:
    """Softmax ``array<struct<category, score>>`` and sort it: probability falling, then label.

    A class without a score has probability 0. Probabilities are rounded to 12 places, far below
    what is reported, so that the order does not hang on the order of a sum.
    """

    def weights(best: Column) -> Column:
        return F.transform(
            scores,
            lambda s: F.struct(
                F.coalesce(F.exp(s["score"] - best), F.lit(0.0)).alias("p"), s["category"].alias("category")
            ),
        )

    def shares(weighted: Column) -> Column:
        total = F.aggregate(weighted, F.lit(0.0), lambda acc, w: acc + w["p"])
        return let(
            total,
            lambda t: F.transform(
                weighted,
                lambda w: F.struct((-F.round(w["p"] / t, 12)).alias("neg"), w["category"].alias("category")),
            ),
        )

    best = F.array_max(F.transform(scores, lambda s: s["score"]))
    ranked = let(let(best, weights), shares)
    return df.withColumn(out, _as_ranked(F.sort_array(ranked))).drop(scores)


def rank_probabilities(labels: list[str], probabilities: Column) -> Column:
    """Rank an ``array<double>`` that is aligned with ``labels``."""
    pairs = F.transform(
        probabilities,
        lambda p, i: F.struct((-F.round(p, 12)).alias("neg"), F.get(F.lit(labels), i).alias("category")),
    )
    return _as_ranked(F.sort_array(pairs))


def _as_ranked(pairs: Column) -> Column:
    return F.transform(
        pairs, lambda x: F.struct(x["category"].alias("category"), F.abs(x["neg"]).alias("probability"))
    )


def top_label(ranked: str = "ranked") -> Column:
    return F.get(ranked, F.lit(0))["category"]


def confidence(ranked: str = "ranked") -> Column:
    return F.get(ranked, F.lit(0))["probability"]


def top_k(ranked: str = "ranked", k: int = TOP_K, places: int | None = 4) -> Column:
    first = F.slice(ranked, 1, k)
    if places is None:
        return first
    return F.transform(
        first,
        lambda x: F.struct(x["category"].alias("category"), F.round(x["probability"], places).alias("probability")),
    )
