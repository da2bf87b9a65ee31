"""Continuous scoring of arriving texts: the batch answer, applied to every micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from triagekit.constants import CONFIDENCE_THRESHOLD, TOP_K
from triagekit.operators.logistic import logistic_scorer
from triagekit.operators.routing import classify


def request_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", **options: str) -> DataFrame:
    """Files that arrive in a folder."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(folder)


def classify_stream(
    requests: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    threshold: float = CONFIDENCE_THRESHOLD,
    k: int = TOP_K,
    **trigger,
) -> StreamingQuery:
    """Answer a stream ``(doc_id, text)`` with any scorer, also one that sums per text.

    Each micro-batch replaces its own folder, so a batch that is repeated after a failure leaves
    one copy of its answers.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        answers = classify(batch, score, threshold, k)
        answers.write.mode("overwrite").parquet(f"{out}/batch_{batch_id}")

    return (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def classify_stream_pipeline(
    requests: DataFrame, model: PipelineModel, out: str, checkpoint: str, threshold: float = CONFIDENCE_THRESHOLD,
    k: int = TOP_K, **trigger,
) -> StreamingQuery:
    """The same with a fitted pipeline: row by row, so the plan itself is the stream."""
    answers = classify(requests, logistic_scorer(model), threshold, k)
    return (
        answers.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", out)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_answers(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).parquet(out)
