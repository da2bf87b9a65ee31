"""Rows that are easily lost: repeated and null ids, null groups and labels, extreme values."""

import math

import pytest
from pyspark.sql import functions as F

from triagekit.functions.text import percent
from triagekit.operators import profile, routing, split, thresholds
from triagekit.operators.bayes import save_bayes
from triagekit.operators.clean import check_requests
from triagekit.plans import compare
from triagekit.plans.study import Study
from triagekit.sources.labelled import parse_requests
from triagekit.sources.store import load_or_build


def test_every_request_is_answered_on_its_own(spark, small):
    study = Study(small)
    rows = [(1, "card lost stolen"), (1, "loan rate interest"), (2, "login password"), (None, "pin blocked"), (None, "monthly term"), (3, None)]
    one_by_one = [(i, t) for i, (_, t) in enumerate(rows)]
    ask = lambda r: routing.classify(spark.createDataFrame(r, "doc_id long, text string"), study.scorer()).collect()
    got, expected = ask(rows), {r.doc_id: r for r in ask(one_by_one)}
    key = lambda r: (r.category, r.confidence, r.route)
    assert sorted(map(repr, ((r.doc_id, *key(r)) for r in got))) == sorted(repr((rows[i][0], *key(r))) for i, r in expected.items())


@pytest.mark.parametrize("rows", [3, 1_000_000])
def test_median_ends_on_extreme_values(spark, conf, rows):
    conf("spark.triagekit.medianRows", rows)
    values = {
        "a": [float(x) for x in range(40)] + [math.inf, -math.inf],
        "b": [-1e308, 1e308] + [x * 1e-300 for x in range(30)],
        "c": [0.0] * 5 + [1e308] * 5,
        None: [1.0, 2.0, 3.0, 4.0, 5.0, 100.0],
        "d": [math.inf, math.inf, 1.0],
    }
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double")
    got = {r.g: r["median"] for r in profile.exact_median(df, "g", "v").collect()}
    for g, vs in values.items():
        ranked = sorted(vs)
        assert got[g] == ranked[(len(vs) - 1) // 2] / 2 + ranked[len(vs) // 2] / 2, g


def test_rows_without_label_are_in_no_part(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "ab"[i % 2]) for i in range(100)], "doc_id long, category string")
    rows = split.stratified_split(df).collect()
    assert all((r.split is None) == (r.category is None) for r in rows)


def test_fine_thresholds_keep_their_digits(spark):
    df = spark.createDataFrame([("a", "a", 0.614), ("a", "b", 0.613)], "category string, predicted_label string, confidence double")
    chosen = thresholds.choose_threshold(thresholds.threshold_sweep(df, points=1000)).first()
    assert chosen.threshold == 0.614


def test_half_percents_are_even(spark):
    rows = spark.createDataFrame([(0.625,), (0.635,), (0.375,), (0.6149,)], "p double").select(percent(F.col("p")).alias("p")).collect()
    assert [r.p for r in rows] == [int(f"{p:.0%}"[:-1]) for p in (0.625, 0.635, 0.375, 0.6149)]


def test_request_reasons(spark):
    bodies = ['{"text": "ok"}', '{"text": 123}', '{"text": {"a": 1}}', "{broken", "[1]", '{"other": 1}', '{"text": null}', None, '{"text": " "}']
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    got = [r.reject_reason for r in check_requests(parse_requests(df)).orderBy("i").collect()]
    assert got == [None, "not_text", "not_text", "malformed", "malformed", "empty", "empty", "empty", "empty"]


def test_a_broken_cache_is_not_overwritten(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "notes.txt").write_text("keep me")
    with pytest.raises(Exception):
        load_or_build(spark, str(tmp_path / "t"), lambda: spark.range(3)).count()
    assert (tmp_path / "t" / "notes.txt").read_text() == "keep me"
    assert load_or_build(spark, str(tmp_path / "new"), lambda: spark.range(3)).count() == 3


def test_study_keeps_rows_with_repeated_and_null_ids(small):
    """The same texts under ids that repeat or are missing: every row has its own prediction."""
    ids = F.when(F.col("doc_id") % 5 != 0, F.floor(F.col("doc_id") / 3)).cast("long")
    study = Study(small.withColumn("doc_id", ids))
    want = study.docs.groupBy("doc_id", "category").count().collect()
    both = study.oof.select("doc_id", "category").unionByName(study.holdout_predictions.select("doc_id", "category"))
    assert sorted(map(repr, both.groupBy("doc_id", "category").count().collect())) == sorted(map(repr, want))
    # A row's vector is its own: its prediction does not hang on who shares its id.
    assert study.features.groupBy("row_key").count().where("count > 1").count() == 0


def test_worst_errors_of_repeated_ids(spark, small):
    """All rows share one id or have none: each error is one row with its own text, for each candidate."""
    study = Study(small.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).cast("long")))
    for oof in (study.oof, study.logistic_oof):
        wrong = oof.where("category <> predicted_label").join(study.counted.select("row_key", "ticket_text"), "row_key").collect()
        assert wrong and len(wrong) < 30 and oof.count() == oof.select("row_key").distinct().count()
        key = lambda r: (r.doc_id, r.ticket_text, r.predicted_label, r.confidence)
        got = study.worst_errors(oof).collect()
        assert sorted(map(repr, map(key, got))) == sorted(map(repr, map(key, wrong)))
        assert [r.confidence for r in got] == sorted((r.confidence for r in got), reverse=True)


def test_requests_keep_their_numbers(spark, small):
    """The numbers of rows are read from a written table, so no second run of the input can change them."""
    asked = small.select(F.lit(1).cast("long").alias("doc_id"), F.col("ticket_text").alias("text")).repartition(5)
    plan = routing.classify(asked, Study(small).scorer())._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" not in plan and "requests-" in "".join(routing.classify(asked, Study(small).scorer()).inputFiles())


def test_measures_of_a_model(spark, small, tmp_path):
    study = Study(small)
    save_bayes(study.final_model, str(tmp_path / "nb"))
    scored = study.scorer()(small.withColumn("reject_reason", F.lit(None).cast("string")))
    base = compare.measures("nb", spark, str(tmp_path / "nb"), scored)
    got = {r.metric: r.value for r in base.collect()}
    files = [p for p in (tmp_path / "nb").rglob("*") if p.is_file() and not p.name.startswith((".", "_"))]
    assert got["nb_size_mb"] == pytest.approx(sum(p.stat().st_size for p in files) / 2**20) and got["nb_rows_per_second"] > 0
    assert compare.rows_per_second(scored.where("false")) is None
    both = compare.compare(base, compare.measured(spark, {"lr_size_mb": 2 * got["nb_size_mb"], "lr_rows_per_second": None}))
    gains = {r.metric: r.value for r in compare.gains(both, "lr", "nb", ("size_mb", "rows_per_second")).collect()}
    assert gains["lr_size_mb_ratio"] == pytest.approx(2.0) and gains["lr_rows_per_second_ratio"] is None


def test_chosen_model_drives_what_follows(small):
    study = Study(small)
    assert {r.model for r in study.candidate_summary.collect()} == {"baseline_most_frequent", "naive_bayes", "logistic_regression"}
    for name, oof in (("naive_bayes", study.oof), ("logistic_regression", study.logistic_oof)):
        study.__dict__["chosen"] = name
        study.__dict__.pop("chosen_holdout", None)
        assert study.chosen_oof is oof
        held = study.chosen_holdout
        assert held.count() == study.texts("holdout").count() and set(held.columns) == {"doc_id", "category", "predicted_label", "confidence", "ranked"}
        answers = routing.classify(small.select("doc_id", F.col("ticket_text").alias("text")), study.chosen_scorer())
        assert answers.count() == small.count()
