import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagekit.operators import evaluate as ev
from triagekit.operators import profile, split, thresholds as th
from triagekit.operators.ranking import rank_probabilities, top_k


def sweep_of(spark, rows):
    return spark.createDataFrame([(t, 1, 0.5, p) for t, p in rows], "threshold double, accepted int, coverage double, precision double")


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(0.60, 0.94948), (0.61, 0.95053), (0.62, 0.95336)], 0.61),
        ([(0.1, 0.5), (0.2, 0.95)], None),
        ([(0.3, 0.96), (0.4, 0.94), (0.5, 0.97)], 0.3),
    ],
)
def test_threshold_choice(spark, rows, want):
    assert th.choose_threshold(sweep_of(spark, rows)).first().threshold == want


def test_review_boundary(spark):
    df = spark.createDataFrame([(0.6099,), (0.61,), (0.6101,), (0.60996,)], "c double")
    got = df.select(th.is_low_confidence(F.col("c")), F.round("c", 4)).collect()
    assert [r[0] for r in got] == [True, False, False, True]


def test_steps_equal_direct_comparison(spark):
    values = [i * 0.01 for i in range(100)] + [float(x) for x in np.random.default_rng(1).random(500)] + [1.0, 0.35, 0.29]
    got = spark.createDataFrame([(v,) for v in values], "c double").select("c", th.highest_passed(F.col("c"))).collect()
    for c, idx in got:
        assert idx == max(i for i in range(100) if i * 0.01 <= c)


def test_sweep_against_numpy(spark):
    rng = np.random.default_rng(2)
    conf = rng.random(400)
    hit = rng.random(400) < conf
    df = spark.createDataFrame([("a", "a" if h else "b", float(c)) for c, h in zip(conf, hit)], "category string, predicted_label string, confidence double")
    rows = th.threshold_sweep(df).collect()
    assert len(rows) == 100
    for r in rows:
        ok = conf >= r.idx * 0.01
        assert r.accepted == ok.sum() and r.coverage == pytest.approx(ok.mean())
        assert r.precision is None if not ok.any() else r.precision == pytest.approx(hit[ok].mean())
    assert [r.threshold for r in th.display_rows(th.threshold_sweep(df)).collect()] == [i / 10 for i in range(10)]


@pytest.mark.parametrize(
    "nb, lr, want",
    [((0.8129, 0.0134), (0.8423, 0.0079), "lr"), ((0.5, 0.25), (0.75, 0.1), "naive_bayes"), ((0.8, 0.01), (0.7, 0.01), "naive_bayes")],
)
def test_model_choice(spark, nb, lr, want):
    df = spark.createDataFrame([("naive_bayes", *nb), ("lr", *lr)], "model string, mean double, std double")
    assert ev.select_model(df, "lr").first().chosen == want


def test_fold_deviation_is_of_the_population(spark):
    df = spark.createDataFrame([(x,) for x in (0.833, 0.562, 0.5, 0.396, 0.708)], "macro_f1 double")
    r = ev.cv_summary(df).first()
    assert r["mean"] == pytest.approx(0.5998) and r["std"] == pytest.approx(np.std([0.833, 0.562, 0.5, 0.396, 0.708]))


def test_confused_pairs_tie_order(spark):
    rows = [("b", "a", 13), ("B", "a", 13), ("a", "b", 13), ("a", "a", 99), ("c", "a", 12)]
    df = spark.createDataFrame(rows, "true_label string, predicted_label string, count long")
    got = [(r.true_label, r.predicted_label) for r in ev.confused_pairs(df).collect()]
    assert got == [("B", "a"), ("a", "b"), ("b", "a"), ("c", "a")]


def test_macro_f1_counts_classes_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "a"), ("c", "d")], "category string, predicted_label string")
    assert ev.macro_f1(df).first().macro_f1 == pytest.approx((0.8 + 0 + 0 + 0) / 4)


def test_wide_confusion_keeps_empty_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "category string, predicted_label string")
    assert [tuple(r) for r in ev.confusion_wide(df, ["a", "b", "c"]).collect()] == [("a", 1, 0, 0), ("b", 1, 0, 0), ("c", 0, 0, 0)]


def test_ranking_breaks_ties_by_label(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4],)], "p array<double>").select(rank_probabilities(["x", "z", "y"], F.col("p")).alias("ranked"))
    assert [c.category for c in df.select(top_k().alias("t")).first().t] == ["y", "z", "x"]


def test_holdout_size_of_13083_rows(spark):
    counts = spark.createDataFrame([(f"c{i:02d}", 13083 // 77 + (1 if i < 13083 % 77 else 0)) for i in range(77)], "category string, count long")
    q = split.class_quotas(counts).agg(F.sum("dev"), F.sum("count")).first()
    assert (q[0], q[1]) == (11120, 13083)


def numbered(spark, n):
    label = F.when(F.col("id") % 3 == 0, "rare").otherwise("hot")
    return spark.range(n).select(F.col("id").alias("doc_id"), label.alias("category"))


def test_split_sizes_and_balance(spark):
    df = split.stratified_split(numbered(spark, 1000)).cache()
    assert df.where("split = 'holdout'").count() == 150 and df.where("split='holdout' and fold is not null").count() == 0
    sizes = [r["count"] for r in df.where("split = 'dev'").groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    per = [r["count"] for r in df.where("split='dev' and category='rare'").groupBy("fold").count().collect()]
    assert max(per) - min(per) <= 1


@pytest.mark.parametrize("digits", [0, 1, 3])
def test_splits_equal_a_plain_ranking(spark, monkeypatch, digits):
    """Whatever the ranges; repeated ids share a place, and the source is read twice for the cuts."""
    monkeypatch.setattr(split, "RANGE_DIGITS", digits)
    rows = [(i % 2500 if i % 3 else 7, None if i % 97 == 0 else "abc"[i % 7 % 3]) for i in range(3000)]
    read = spark.sparkContext.accumulator(0)

    def count(label):
        read.add(1)
        return label

    df = spark.createDataFrame(rows, "doc_id long, category string")
    seen = df.withColumn("category", F.udf(count, "string").asNondeterministic()("category"))
    cuts = {r.category: r.cuts for r in split.split_cuts(seen).collect()}
    assert read.value == 2 * len(rows)
    counts = profile.class_counts(df)
    ends = {r.category: r.fold_ends for r in split.class_quotas(counts).collect()}
    for label, of_fold in cuts.items():
        order = sorted(hashlib.md5(f"{split.SEED}:{i}".encode()).hexdigest() for i, c in rows if c == label)
        assert of_fold == [order[end - 1] for end in ends[label]]


@pytest.mark.parametrize("limit", [1_000_000, 10])
def test_median_of_any_size(spark, conf, limit):
    conf("spark.triagekit.medianRows", limit)
    rng = np.random.default_rng(3)
    groups = {"even": rng.normal(size=400), "odd": rng.lognormal(sigma=6, size=401), "same": np.full(300, 2.5), "two": np.array([1.0, 9.0])}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs], "g string, x double")
    got = {r.g: r.median for r in profile.exact_median(df, "g", "x").collect()}
    assert got == pytest.approx({g: float(np.median(x)) for g, x in groups.items()})


def test_duplicates_count_null_as_one_text(spark):
    r = profile.duplicate_rate(spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "ticket_text string")).first()
    assert (r.row_count, r.distinct_count, r.duplicate_rate) == (5, 3, pytest.approx(0.4))
