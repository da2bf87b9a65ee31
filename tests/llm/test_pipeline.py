"""Stages of the corpus pipeline, each against brute force on its own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_texts import SF, plain_components, plain_fingerprint
from tests.llm.test_tokens import check_packed
from triagekit.llm import fm, rules, structure


@pytest.fixture(scope="module")
def stages(spark, sf, documents):
    docs, out = documents, [documents]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        out.append(docs)
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages, documents):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "packing"]
    assert all(s.columns == documents.columns for s in stages[:-1])


def test_rules(stages):
    rows = [(r.doc_id, structure.structure(r.text)) for r in stages[0].collect()]
    model = rules.fit_label_model(dict(Counter(rules.votes_of(s) for _, s in rows if not rules.base_failed(s))))
    kept = [k for k, s in rows if model.posterior([rules.votes_of(s)])[0] >= 0.5 and not rules.base_failed(s)]
    assert ids(stages[1]) == Counter(kept)


def test_classifier(spark, sf, stages, documents):
    machine = fm.fit_quality(documents, spark.read.parquet(f"{sf}/labels.parquet"), F.lit(True))
    kept = [r.doc_id for r in stages[1].collect() if machine.score(r.text, r.n_chars) >= 0.5]
    assert ids(stages[2]) == Counter(kept)


def test_classifier_rejects(spark):
    """Given bad documents too, the stage drops most of them and keeps most good ones."""
    documents, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    kept = set(ids(corpus_pipeline.quality_classifier(spark, documents, SF)))
    labels = [(r.doc_id, r.quality) for r in labels.collect()]
    bad, good = ([k for k, q in labels if q == x] for x in (0, 1))
    assert bad and sum(k in kept for k in bad) <= 0.1 * len(bad)
    assert sum(k in kept for k in good) >= 0.95 * len(good)


def test_near_duplicates(stages):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in stages[2].collect()]
    assert ids(stages[3]) == Counter({c for _, _, c in plain_components(rows, 2)})


def test_packing(stages):
    check_packed(stages[3], stages[4], 2048, 1)


def test_edges(spark, sf, edge, none):
    for docs in (edge, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf).cache()
        assert docs.count() >= 0


def test_run(spark, sf, stages):
    # Which pieces there are depends on the order of rows; the documents and their ids do not.
    both = [Counter(df.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()) for df in (corpus_pipeline.run(spark, sf), stages[-1])]
    assert both[0] == both[1]
