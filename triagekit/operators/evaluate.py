"""Confusion counts and everything that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagekit.constants import DEFAULT_MODEL, N_CONFUSED_PAIRS, N_WORST_ERRORS, QUALITY_FLOOR


def confusion_long(preds: DataFrame, *by: str, true: str = "category", pred: str = "predicted_label") -> DataFrame:
    """Counts of (true, predicted) pairs that occur."""
    return preds.groupBy(*by, F.col(true).alias("true_label"), F.col(pred).alias("predicted_label")).agg(
        F.count("*").alias("count")
    )


def confusion_wide(preds: DataFrame, labels: list[str], prefix: str = "", **names: str) -> DataFrame:
    """One row and one column per class of a fixed list; cells without rows hold 0."""
    spark = preds.sparkSession
    pairs = confusion_long(preds, **names)
    wide = pairs.groupBy("true_label").pivot("predicted_label", labels).agg(F.sum("count"))
    rows = spark.createDataFrame([(x,) for x in labels], "true_label string")
    # Both sides have at most one row per class.
    full = rows.join(F.broadcast(wide), "true_label", "left")
    return full.select(
        "true_label", *[F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias(f"{prefix}{x}") for x in labels]
    ).orderBy("true_label")


def class_scores(confusion: DataFrame, *by: str) -> DataFrame:
    """Per class: tp, fp, fn and F1 (0 where undefined), over classes that are true or predicted."""
    n, hit = F.col("count"), F.col("true_label") == F.col("predicted_label")
    zero = F.lit(0).cast("long")
    as_true = F.struct(
        F.col("true_label").alias("label"), F.when(hit, n).otherwise(zero).alias("tp"), zero.alias("fp"),
        F.when(hit, zero).otherwise(n).alias("fn"),
    )
    as_pred = F.struct(
        F.col("predicted_label").alias("label"), zero.alias("tp"), F.when(hit, zero).otherwise(n).alias("fp"),
        zero.alias("fn"),
    )
    sums = (
        confusion.select(*by, F.explode(F.array(as_true, as_pred)).alias("r"))
        .groupBy(*by, "r.label")
        .agg(F.sum("r.tp").alias("tp"), F.sum("r.fp").alias("fp"), F.sum("r.fn").alias("fn"))
    )
    bottom = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return sums.withColumn("f1", F.coalesce(2.0 * F.col("tp") / F.nullif(bottom, F.lit(0)), F.lit(0.0)))


def macro_f1(preds: DataFrame, *by: str, **names: str) -> DataFrame:
    """Plain mean of class F1 per group. The data is read once, to count pairs."""
    scores = class_scores(confusion_long(preds, *by, **names), *by)
    return scores.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def cv_summary(fold_scores: DataFrame, *by: str) -> DataFrame:
    """Mean and population standard deviation over folds."""
    return fold_scores.groupBy(*by).agg(
        F.avg("macro_f1").alias("mean"), F.stddev_pop("macro_f1").alias("std"), F.count("*").alias("folds")
    )


def select_model(summary: DataFrame, challenger: str, default: str = DEFAULT_MODEL) -> DataFrame:
    """The higher mean wins only if the gap exceeds the larger deviation; else the default stays."""

    def of(name: str, column: str) -> Column:
        return F.max(F.when(F.col("model") == name, F.col(column)))

    row = summary.agg(
        of(default, "mean").alias("dm"), of(default, "std").alias("ds"),
        of(challenger, "mean").alias("cm"), of(challenger, "std").alias("cs"),
    )
    gap, bar = F.abs(F.col("dm") - F.col("cm")), F.greatest("ds", "cs")
    return row.select(
        gap.alias("gap"),
        bar.alias("bar"),
        (gap > bar).alias("distinct"),
        F.when((gap > bar) & (F.col("cm") > F.col("dm")), challenger).otherwise(default).alias("chosen"),
    )


def misclassified(preds: DataFrame, true: str = "category", pred: str = "predicted_label") -> DataFrame:
    return preds.where(F.col(true) != F.col(pred))


def confused_pairs(confusion: DataFrame, n: int = N_CONFUSED_PAIRS) -> DataFrame:
    """The ``n`` most frequent confusions; ties in label order."""
    pairs = confusion.where("true_label <> predicted_label and count > 0")
    return pairs.orderBy(F.desc("count"), "true_label", "predicted_label").limit(n)


def worst_errors(preds: DataFrame, texts: DataFrame, n: int = N_WORST_ERRORS, key: str = "doc_id") -> DataFrame:
    """The ``n`` most confident wrong predictions with their texts, which are found by ``key``.

    ``key`` is unique in both tables, while ``doc_id`` may repeat. The report is cut first, so the text
    table is joined with ``n`` rows only.
    """
    order = [F.desc("confidence"), "doc_id", key]
    worst = misclassified(preds).orderBy(*order).limit(n)
    return texts.select(F.col(key).alias("_key"), "ticket_text").join(F.broadcast(worst), F.col("_key") == F.col(key)).orderBy(
        *order
    ).select("doc_id", "ticket_text", F.col("category").alias("true_label"), "predicted_label", "confidence")


def quality_gate(summary: DataFrame, floor: float = QUALITY_FLOOR) -> DataFrame:
    """Does the mean exceed the floor? One row per model."""
    return summary.select(
        "model", F.col("mean").alias("value"), F.lit(floor).alias("floor"), (F.col("mean") > floor).alias("passed")
    )
