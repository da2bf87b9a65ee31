"""Session settings that the jobs rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str, cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own settings."""
    cpus = cpus or min(8, os.cpu_count() or 1)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Lets AQE skip the sorts of a shuffled join where every measured partition is small.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "128m")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def setting(spark: SparkSession, key: str, default: int) -> int:
    """An integer tuning knob, read from the session under ``spark.triagekit.*``."""
    return int(spark.conf.get(f"spark.triagekit.{key}", str(default)))
