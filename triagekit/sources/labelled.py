"""Labelled texts in: scans, input checks, appends and writes."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagekit.constants import CSV_NULL_TOKENS
from triagekit.errors import MissingColumns, NoUsableRows, SourceEmpty, SourceMissing
from triagekit.operators.clean import clean_labelled

REQUIRED = ("ticket_text", "category")


def scan(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Read a Parquet table.

    A table that arrives in fewer splits than the session has task slots (one small file) is spread
    by ``key`` once; tables with enough splits are left where they are.
    """
    df = spark.read.parquet(path)
    slots = spark.sparkContext.defaultParallelism
    if key and df.rdd.getNumPartitions() < slots:
        df = df.repartition(slots, key)
    return df


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    null_tokens: Iterable[str] = CSV_NULL_TOKENS,
    multiline: bool = True,
) -> DataFrame:
    """Read a CSV with a header; every column is a string and ``null_tokens`` become nulls.

    ``multiline`` allows line ends inside quoted cells, at the price of one task per file. Large
    files without such cells should be read with ``multiline=False``, which splits them.
    """
    try:
        df = (
            spark.read.option("header", True)
            .option("multiLine", multiline)
            .option("escape", '"')
            .csv(path)
        )
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise SourceMissing(str(path)) from exc
        raise
    if not df.columns:
        raise SourceEmpty(str(path))
    stop = list(null_tokens)
    if not stop:
        return df
    return df.select(*[F.when(~F.col(f"`{c}`").isin(stop), F.col(f"`{c}`")).alias(c) for c in df.columns])


def require_columns(df: DataFrame, required: Iterable[str] = REQUIRED) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise MissingColumns(f"columns {missing} are missing; found {df.columns}")
    return df


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise NoUsableRows("no row has both a text and a category")
    return df


def load_labelled(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Read, check and clean labelled texts; each unusable input has its own error."""
    df = clean_labelled(require_columns(read_csv(spark, path, **options)).select(*REQUIRED))
    return require_rows(df)


def with_row_id(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """Number rows of a source that brings no key.

    The numbers follow the splits of the scan, so write the result (``load_or_build``) before
    anything depends on them.
    """
    return df.select(F.monotonically_increasing_id().alias(name), *df.columns)


def append_by_name(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Append tables by column name: absent columns are null, copies stay."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, first)


def as_ticket_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Bring a ``(text, category)`` source to the two standard columns, in order."""
    return df.withColumnRenamed(text, "ticket_text").select(*REQUIRED)


def tag_and_append(tables: dict[str, DataFrame]) -> DataFrame:
    """Append one table per class, each row tagged with the name of its class."""
    tagged = [df.withColumn("category", F.lit(name)) for name, df in tables.items()]
    return append_by_name(*tagged)


def write_labelled(df: DataFrame, path: str) -> None:
    df.select(*REQUIRED).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


REQUEST_SCHEMA = T.StructType([T.StructField("text", T.StringType())])


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests as JSON lines ``{"text": ...}``; a line without the field has a null text."""
    return spark.read.schema(REQUEST_SCHEMA).json(path)


def parse_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """The request text out of a JSON string column, and ``request_error``: ``malformed`` for what is not
    a JSON object, ``not_text`` for a text that is not a string; the text is null then."""
    parsed = F.try_parse_json(F.col(body))
    kind = F.schema_of_variant(F.try_variant_get(parsed, "$.text", "variant"))
    whole = F.schema_of_variant(parsed)
    error = F.when(F.col(body).isNotNull() & (parsed.isNull() | ~whole.startswith("OBJECT")), "malformed").when(
        ~kind.isin("STRING", "VOID"), "not_text"
    )
    text = F.when(error.isNull(), F.try_variant_get(parsed, "$.text", "string"))
    return df.withColumn("request_error", error).withColumn("text", text)
