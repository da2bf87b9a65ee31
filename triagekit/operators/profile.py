"""Profile of a labelled table: sizes, classes, duplicates, medians."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagekit.constants import MAX_CLASSES
from triagekit.errors import LimitExceeded, TooFewClasses
from triagekit.session import setting
from triagekit.sources.store import materialize


def class_counts(df: DataFrame, label: str = "category") -> DataFrame:
    """Rows per class. Partial counts per task make the shuffle as small as the class list."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("count"))


def class_histogram(df: DataFrame, label: str = "category") -> DataFrame:
    return class_counts(df, label).orderBy(F.desc("count"), label)


def class_extremes(df: DataFrame, label: str = "category") -> DataFrame:
    """Rows, classes, and the smallest and largest class, all from the small class table.

    Ties go to the first label in code-point order.
    """
    rows = df.groupBy(label).agg(F.count("*").alias("count"))
    named = F.col(label).isNotNull()
    small = F.min(F.when(named, F.struct(F.col("count").alias("n"), F.col(label).alias("l"))))
    large = F.min(F.when(named, F.struct((-F.col("count")).alias("n"), F.col(label).alias("l"))))
    return rows.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("row_count"),
        F.count(label).alias("class_count"),
        small.alias("s"),
        large.alias("g"),
    ).select(
        "row_count",
        "class_count",
        F.col("s.n").alias("min_count"),
        F.col("s.l").alias("min_category"),
        (-F.col("g.n")).alias("max_count"),
        F.col("g.l").alias("max_category"),
    )


def duplicate_rate(df: DataFrame, text: str = "ticket_text") -> DataFrame:
    """Share of rows that repeat an earlier text; all nulls count as one text.

    Texts are grouped by their SHA-256 digest: the shuffle moves 32 bytes per distinct text and
    task, not the texts, and a text with very many copies is already one row per task.
    """
    digest = F.unhex(F.sha2(text, 256))
    per_text = df.select(digest.alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    return per_text.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count("*").alias("distinct_count"),
        ((F.sum("n") - F.count("*")) / F.sum("n")).alias("duplicate_rate"),
    )


def sorted_labels(df: DataFrame, label: str = "category") -> DataFrame:
    return df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label)


def label_list(df: DataFrame, label: str = "category", least: int = 1) -> list[str]:
    """The class list on the driver, in code-point order; its size is checked first."""
    rows = sorted_labels(df, label).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise LimitExceeded(f"more than {MAX_CLASSES} classes in column {label}")
    if len(rows) < least:
        raise TooFewClasses(f"need at least {least} classes to train, found {len(rows)}")
    return [r[0] for r in rows]


#: The largest finite double.
LARGEST = sys.float_info.max


def exact_median(df: DataFrame, group: str, value: str, out: str = "median") -> DataFrame:
    """Exact interpolated median per group, for groups of any size.

    ``median`` keeps all distinct values of a group in one buffer. Here equal values are counted
    first. While a group has too many distinct values left, a histogram over its remaining range
    finds the one or two bins that hold the middle ranks; only those bins go on, the rows below
    them are carried as a number. The last step ranks the few values left. Null is a group like others;
    infinities count as the largest doubles while ranges are cut.
    """
    limit = setting(df.sparkSession, "medianRows", 1_000_000)
    left = materialize(
        df.where(F.col(value).isNotNull())
        .groupBy(F.array(F.col(group)).alias("g"), F.col(value).cast("double").alias("x"))
        .agg(F.count("*").alias("n"))
        .withColumn("v", F.greatest(F.least("x", F.lit(LARGEST)), F.lit(-LARGEST))),
        "median-values",
    )
    spec = left.groupBy("g").agg(
        F.sum("n").alias("total"),
        F.lit(0).cast("long").alias("below"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
        F.count("*").alias("distinct_values"),
    )
    while True:
        spec = _copied_if_small(materialize(spec, "median-spec"))
        if spec.where((F.col("distinct_values") > limit) & (F.col("lo") < F.col("hi"))).isEmpty():
            break
        spec = _narrow(left, spec)
    ranked = (
        left.join(spec, "g")
        .where(F.col("v").between(F.col("lo"), F.col("hi")))
        .withColumn("upto", F.col("below") + F.sum("n").over(Window.partitionBy("g").orderBy("v", "x")))
    )
    return (
        ranked.groupBy(F.col("g").alias(group))
        .agg(
            F.min(F.when(F.col("upto") > _low_rank(), F.col("x"))).alias("v0"),
            F.min(F.when(F.col("upto") > _high_rank(), F.col("x"))).alias("v1"),
            F.first("total").alias("row_count"),
        )
        .select(F.get(group, F.lit(0)).alias(group), "row_count", (F.col("v0") / 2 + F.col("v1") / 2).alias(out))
    )


def _copied_if_small(spec: DataFrame, rows: int = 200_000) -> DataFrame:
    """One row per group: copied to all tasks when counted small, so a large group stays spread.
    With more groups than that the join is shuffled, and AQE splits the partitions of large ones."""
    return F.broadcast(spec) if spec.limit(rows + 1).count() <= rows else spec


def _low_rank():
    return F.floor((F.col("total") - 1) / 2)


def _high_rank():
    return F.floor(F.col("total") / 2)


def _narrow(left: DataFrame, spec: DataFrame, bins: int = 4096) -> DataFrame:
    """One histogram round: the same table as ``spec`` with a narrower range per group.

    Every round leaves out at least the first or the last bin, or both middle ranks lie at the facing
    ends of two bins and the range shrinks to these. Halves keep differences finite.
    """
    share = (F.col("v") / 2 - F.col("lo") / 2) / F.nullif(F.col("hi") / 2 - F.col("lo") / 2, F.lit(0.0))
    hist = (
        left.join(spec.drop("distinct_values"), "g")
        .where(F.col("v").between(F.col("lo"), F.col("hi")))
        .withColumn("bin", F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)))
        .groupBy("g", "total", "below", "bin")
        .agg(
            F.sum("n").alias("n"),
            F.min("v").alias("lo"),
            F.max("v").alias("hi"),
            F.count("*").alias("distinct_values"),
            F.max(F.struct("v", "n")).alias("last"),
        )
        .withColumn("upto", F.col("below") + F.sum("n").over(Window.partitionBy("g").orderBy("bin")))
    )
    middle = (F.col("upto") > _low_rank()) & (F.col("upto") - F.col("n") <= _high_rank())
    two = F.count("*") > 1
    first = F.min(F.struct("bin", "last", "upto"))
    return hist.where(middle).groupBy("g", "total").agg(
        F.when(two, first["upto"] - first["last"]["n"]).otherwise(F.min(F.col("upto") - F.col("n"))).alias("below"),
        F.when(two, first["last"]["v"]).otherwise(F.min("lo")).alias("lo"),
        F.when(two, F.max(F.struct("bin", "lo"))["lo"]).otherwise(F.max("hi")).alias("hi"),
        F.when(two, F.lit(2)).otherwise(F.sum("distinct_values")).cast("long").alias("distinct_values"),
    )
