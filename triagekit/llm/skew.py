"""Joins in which a few keys may hold most of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy when it holds more than this share of all rows, so fewer than that many keys are heavy.
HEAVY_KEYS = 1000


def heavy(counted: DataFrame, total: int, n_col: str = "n") -> DataFrame:
    """Rows of ``counted`` (one per key) whose key holds over 1 / ``HEAVY_KEYS`` of ``total`` rows."""
    return counted.where(F.col(n_col) * HEAVY_KEYS > total)


def _equal(keys: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)])


def join_by_weight(rows: DataFrame, table: DataFrame, keys: list[str], total: int, n_col: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row per key and in ``n_col`` the number of its rows.

    Heavy keys, at most ``HEAVY_KEYS`` of them, are broadcast and their rows stay where they are; the rows of
    the others are shuffled, and none of those keys holds more than 1 / ``HEAVY_KEYS`` of ``total``. Null keys
    are equal. ``rows`` is read twice, so it should be a written table. ``n_col`` is dropped.
    """
    added = [c for c in table.columns if c not in (*keys, n_col)]
    named = table.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], *added, n_col)
    few = F.broadcast(heavy(named, total, n_col).drop(n_col))
    light = named.where(F.col(n_col) * HEAVY_KEYS <= total).drop(n_col)
    in_place = rows.join(few, _equal(keys))
    others = rows.join(few, _equal(keys), "left_anti")
    moved = others.join(light, _equal(keys))
    return in_place.unionByName(moved).select(*rows.columns, *added)
