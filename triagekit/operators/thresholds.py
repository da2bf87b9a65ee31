"""Confidence thresholds: sweep, choice, display rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagekit.constants import CONFIDENCE_THRESHOLD, PRECISION_TARGET, SWEEP_POINTS


def is_low_confidence(confidence: Column, threshold: float = CONFIDENCE_THRESHOLD) -> Column:
    return confidence < F.lit(threshold)


def is_accepted(confidence: Column, threshold: float = CONFIDENCE_THRESHOLD) -> Column:
    return confidence >= F.lit(threshold)


def highest_passed(confidence: Column, points: int = SWEEP_POINTS) -> Column:
    """Index of the highest threshold ``i * step`` that a confidence reaches.

    The quotient can be one off because ``i * step`` is itself rounded; one comparison with each
    neighbour puts that right.
    """
    step = 1.0 / points
    guess = F.floor(confidence / step).cast("int")
    at = lambda i: i * F.lit(step)
    fixed = (
        F.when(at(guess + 1) <= confidence, guess + 1).when(at(guess) > confidence, guess - 1).otherwise(guess)
    )
    return F.least(fixed, F.lit(points - 1))


def threshold_sweep(
    preds: DataFrame, points: int = SWEEP_POINTS, true: str = "category", pred: str = "predicted_label"
) -> DataFrame:
    """Coverage and precision at every threshold, from one pass that counts rows per step.

    The rows of a threshold are those of its own step and of all higher ones: a running sum over
    the ``points`` rows of the count table. Precision is null where nothing is accepted.
    """
    counts = (
        preds.select(
            highest_passed(F.col("confidence"), points).alias("idx"),
            (F.col(true) == F.col(pred)).cast("long").alias("hit"),
        )
        .groupBy("idx")
        .agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    )
    grid = preds.sparkSession.range(points).select(F.col("id").cast("int").alias("idx"))
    zero = F.lit(0).cast("long")
    # At most ``points`` rows on either side, and in the windows.
    steps = grid.join(F.broadcast(counts), "idx", "left").select(
        "idx", F.coalesce("n", zero).alias("n"), F.coalesce("hits", zero).alias("hits")
    )
    from_top = Window.orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        steps.withColumn("accepted", F.sum("n").over(from_top))
        .withColumn("correct", F.sum("hits").over(from_top))
        .withColumn("total", F.sum("n").over(Window.partitionBy()))
        .select(
            "idx",
            F.round(F.col("idx") / points, 12).alias("threshold"),
            "accepted",
            (F.col("accepted") / F.nullif("total", F.lit(0))).alias("coverage"),
            (F.col("correct") / F.nullif("accepted", F.lit(0))).alias("precision"),
        )
        .orderBy("idx")
    )


def choose_threshold(sweep: DataFrame, target: float = PRECISION_TARGET) -> DataFrame:
    """The smallest threshold whose precision exceeds the target, with its row; nulls if none does.

    Precision need not rise with the threshold, so all rows are looked at.
    """
    hit = F.min(F.when(F.col("precision") > target, F.struct("threshold", "accepted", "coverage", "precision")))
    return sweep.agg(hit.alias("r")).select("r.threshold", "r.accepted", "r.coverage", "r.precision")


def display_rows(sweep: DataFrame, every: int = 10) -> DataFrame:
    return sweep.where(F.col("idx") % every == 0).orderBy("idx")
