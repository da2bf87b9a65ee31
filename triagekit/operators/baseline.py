"""The majority-class baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def majority_by_part(docs: DataFrame, parts: int, label: str = "category") -> DataFrame:
    """``(part, predicted_label, train_count)``: the most frequent class among each part's training
    rows, ties to the first label. One pass counts (part, class); the rest works on that table."""
    counts = docs.groupBy("part", label).agg(F.count("*").alias("n"))
    per_part = counts.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), "part", F.col(label).alias("l"), "n"
    ).where("part <> p")
    trained = per_part.groupBy("p", "l").agg(F.sum("n").alias("n"))
    best = trained.groupBy(F.col("p").alias("part")).agg(F.min(F.struct((-F.col("n")).alias("n"), "l")).alias("b"))
    return best.select("part", F.col("b.l").alias("predicted_label"), (-F.col("b.n")).alias("train_count"))


def predict_majority(docs: DataFrame, parts: int, label: str = "category") -> DataFrame:
    """Every row of a part gets the label that its training rows have most; one row per part is
    what is broadcast."""
    best = majority_by_part(docs, parts, label).drop("train_count")
    return docs.join(F.broadcast(best), "part").select("doc_id", label, "part", "predicted_label")
