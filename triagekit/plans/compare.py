"""Side-by-side metrics of several approaches."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from triagekit.sources.store import stored_megabytes


def approach_metrics(name: str, summary: DataFrame, holdout: DataFrame | None = None) -> DataFrame:
    """``(metric, value)`` rows from a one-row CV summary and a one-row holdout score."""
    rows = summary.select(
        F.explode(
            F.array(
                F.struct(F.lit(f"{name}_cv_f1_mean").alias("metric"), F.col("mean").alias("value")),
                F.struct(F.lit(f"{name}_cv_f1_std").alias("metric"), F.col("std").alias("value")),
            )
        ).alias("m")
    ).select("m.metric", "m.value")
    if holdout is not None:
        rows = rows.unionByName(
            holdout.select(F.lit(f"{name}_holdout_f1").alias("metric"), F.col("macro_f1").alias("value"))
        )
    return rows


def measured(spark: SparkSession, values: dict[str, float | None]) -> DataFrame:
    """Measured numbers (sizes, rates); a missing one stays null and gets no report line."""
    return spark.createDataFrame(list(values.items()), "metric string, value double")


def rows_per_second(scored: DataFrame) -> float | None:
    """The rate at which a scoring job answers: rows observed while it runs, over its time; null without rows.

    One text alone tells nothing about a distributed job, so this is the rate of the whole table.
    """
    seen = Observation("scored")
    start = time.perf_counter()
    scored.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - start
    return seen.get["rows"] / seconds if seen.get["rows"] else None


def measures(name: str, spark: SparkSession, stored: str, scored: DataFrame) -> DataFrame:
    """Size of a stored model and the rate of the job that scores with it, as metric rows."""
    return measured(spark, {f"{name}_size_mb": stored_megabytes(spark, stored), f"{name}_rows_per_second": rows_per_second(scored)})


def gains(metrics: DataFrame, name: str, base: str, suffixes: tuple[str, ...]) -> DataFrame:
    """Differences and ratios of two approaches for the given metric suffixes; tiny tables."""
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    out = []
    for s in suffixes:
        a, b = pick(f"{name}_{s}"), pick(f"{base}_{s}")
        out.append(F.struct(F.lit(f"{name}_{s}_gain").alias("metric"), (a - b).alias("value")))
        out.append(F.struct(F.lit(f"{name}_{s}_ratio").alias("metric"), (a / F.nullif(b, F.lit(0.0))).alias("value")))
    return metrics.agg(F.array(*out).alias("x")).select(F.explode("x").alias("m")).select("m.metric", "m.value")


def compare(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
