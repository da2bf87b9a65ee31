"""Tables written and read back: intermediate results, caches, reports and sizes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagekit.errors import ModelNotFound, NoSharedFolder

_local_roots: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can reach, as named by the session.

    Only a local session without the setting gets a folder of its own; on a cluster a folder of
    one machine would lose its tables with that machine, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_roots:
        _local_roots[sc.applicationId] = tempfile.mkdtemp(prefix="triagekit-")
    return _local_roots[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/triagekit/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    Used where several later jobs read the same result: lineage ends at files that survive the loss
    of any executor, and readers get column pruning and file statistics.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As ``materialize``, one sorted file per bucket of ``key``: joins and sums by ``key`` with tables in as many
    buckets need no shuffle. The files lie in the shared folder; the session's catalog holds their name only."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    placed = df.repartition(buckets, key)  # no step of the plan where the rows lie so already
    placed.write.format("parquet").option("compression", "zstd").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table)


def overwrite_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As ``materialize_buckets``, in the place of an earlier table of this name, for rows that are large arrays of
    numbers: one task holds all rows of a key already, so they are not moved again."""
    spark = df.sparkSession
    path, table = f"{shared_folder(spark)}/triagekit/{spark.sparkContext.applicationId}/{name}", name.replace("-", "_")
    writer = df.write.format("parquet").option("compression", "none").mode("overwrite")
    writer.bucketBy(buckets, key).option("path", path).saveAsTable(table)
    return spark.table(table)


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the table cached at ``path``; build and write it when it is absent.

    Files move to their place only when the whole write commits, so a write that was cut short
    leaves no table behind and is done again.
    """
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise  # something is there, but not a table: it stays
        build().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Write a table as CSV with a header; order inside a partition is kept."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def metric_lines(metrics: DataFrame, places: int | None = None) -> DataFrame:
    """``key=value`` text lines from ``(metric, value)``, with a fixed number of decimal places if given;
    a metric without a value has no line."""
    value = F.col("value").cast("string") if places is None else F.format_string(f"%.{places}f", "value")
    return metrics.where(F.col("value").isNotNull()).select(F.concat_ws("=", "metric", value).alias("value"))


def write_metrics(metrics: DataFrame, path: str, places: int | None = None) -> None:
    metric_lines(metrics, places).write.mode("overwrite").text(path)


@F.udf(T.StringType())
def real_path(path):
    """The file that a path names in the end; only mounted file systems have links."""
    return os.path.realpath(path.removeprefix("file:")) if path.startswith("file:") else path


def stored_megabytes(spark: SparkSession, path: str) -> float:
    """Total size of all files below ``path`` in MiB; contents are never read, and a file that links name
    as well counts once."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        size = files.select(real_path("path").alias("path"), "length").distinct().agg(F.sum("length").alias("n")).first()["n"]
    except AnalysisException as exc:
        raise ModelNotFound(path) from exc
    return (size or 0) / (1024 * 1024)
