"""Benchmark: prints one JSON line with seconds per query.

Each query starts from the source tables; nothing written by an earlier query is reused, and every
result is computed in full (a noop sink reads all rows). One small untimed run warms the JVM up.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from triagekit.catalog import queries as q
from triagekit.session import local_session


def sink(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def stages(spark: SparkSession, sf_dir: str) -> dict:
    """The steps of one study, timed one by one; each uses only what the steps before it wrote."""
    st = q.study(spark, sf_dir, "t_lang")
    return {
        "study_features": lambda: st.counted,
        "study_split": lambda: st.cuts,
        "study_oof": lambda: st.oof,
        "study_sweep": lambda: sink(q.thresholds.threshold_sweep(st.oof)),
        "study_scores": lambda: sink(st.summary),
    }


HEADLINE = [
    "clean_filter", "duplicate_rate", "median_by_group", "holdout_split", "tokens", "term_counts", "doc_freq", "tfidf",
    "nb_oof_topk", "threshold_sweep", "confused_pairs", "worst_errors", "holdout_eval", "classify_batch",
]
#: Timed as well, but not part of the total.
FURTHER = ["lr_oof", "nb_grid", "embedding_head", "stream_classify", "chosen_model"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("bench", cpus)
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        sink(q.QUERIES["nb_oof_topk"](spark, warm))
    seconds: dict[str, float] = {}

    def timed(name: str, job) -> None:
        start = time.perf_counter()
        job()
        seconds[name] = round(time.perf_counter() - start, 3)

    for name in [*HEADLINE, *FURTHER]:
        q.forget_studies()
        timed(name, lambda: sink(q.QUERIES[name](spark, sf_dir)))
    q.forget_studies()
    for name, job in stages(spark, sf_dir).items():
        timed(name, job)

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rates = {n: round(docs / seconds[n], 1) for n in ("tokens", "tfidf", "nb_oof_topk", "classify_batch")}
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(seconds[n] for n in HEADLINE), 3), "unit": "sec",
                "queries": seconds, "documents_per_second": rates, "documents": docs, "sf": sf_dir.rstrip("/").split("/sf")[-1],
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
