import numpy as np
import pytest
from pyspark.sql import functions as F

from triagekit import errors
from triagekit.constants import STOP_WORDS
from triagekit.operators import bayes, embed, evaluate, logistic, routing, softmax, softmax_local
from triagekit.plans.study import Study, grid_specs, with_top
from triagekit.streaming import classify as streaming


def brute_force(train, test, ngram, min_df, alpha):
    """Naive Bayes on TF-IDF with dense arrays; rows are (id, text, label)."""

    def terms(text):
        t = [w for w in text.lower().split() if w not in STOP_WORDS]
        return t + ([f"{a} {b}" for a, b in zip(t, t[1:])] if ngram > 1 else [])

    docs = [terms(t) for _, t, _ in train]
    df = {}
    for d in docs:
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    vocab = {w: i for i, w in enumerate(sorted(w for w, n in df.items() if n >= min_df))}
    idf = np.array([np.log((1 + len(train)) / (1 + df[w])) + 1 for w in sorted(vocab)])

    def vector(words):
        x = np.zeros(len(vocab))
        for w in words:
            if w in vocab:
                x[vocab[w]] += 1
        x *= idf
        return x / (np.linalg.norm(x) or 1.0)

    X = np.array([vector(d) for d in docs])
    y = np.array([label for _, _, label in train])
    classes = sorted(set(y))
    S = np.array([X[y == c].sum(axis=0) for c in classes]) + alpha
    loglik = np.log(S) - np.log(S.sum(axis=1, keepdims=True))
    prior = np.log([np.mean(y == c) for c in classes])
    out = {}
    for i, text, _ in test:
        s = prior + loglik @ vector(terms(text))
        p = np.exp(s - s.max())
        out[i] = dict(zip(classes, p / p.sum()))
    return out


def probabilities(df):
    return {r.doc_id: {x.category: x.probability for x in r.ranked} for r in df.collect()}


@pytest.mark.parametrize("ngram, min_df, alpha", [(2, 1, 0.1), (1, 3, 1.0)])
def test_out_of_fold_scores_equal_brute_force(spark, small, ngram, min_df, alpha):
    st = Study(small, bayes.BayesSpec(ngram, min_df, alpha))
    rows = [tuple(r) for r in st.split(st.docs).where("split = 'dev'").select("doc_id", "ticket_text", "category", "fold").collect()]
    got = probabilities(st.oof)
    assert len(got) == len(rows) == 76
    for k in range(5):
        want = brute_force([r[:3] for r in rows if r[3] != k], [r[:3] for r in rows if r[3] == k], ngram, min_df, alpha)
        for i, p in want.items():
            assert got[i] == pytest.approx(p, abs=1e-9)


@pytest.mark.parametrize("at_once", [400, 10])
def test_many_classes_in_blocks_and_one_shuffle(spark, monkeypatch, at_once):
    """77 classes as columns of one aggregation, or in blocks of two, against dense arrays."""
    monkeypatch.setattr(bayes, "SUMS_AT_ONCE", at_once)
    rows = [(i, " ".join(f"w{(i * 7 + j * j * (i % 5 + 1)) % 53}" for j in range(6)), f"class{i % 77:02d}") for i in range(308)]
    rows += [(1000, "unseenword", "class03"), (1001, "", "class04")]
    st = Study(spark.createDataFrame(rows, "doc_id long, ticket_text string, category string"), holdout=(0, 100))
    dev = [tuple(r) for r in st.texts("dev").select("doc_id", "ticket_text", "category", "fold").collect()]
    features = st.cv_rows(st.features, "doc_id")
    model = bayes.fit_bayes(features, parts=5)
    assert model.header.blocks == (1 if at_once == 400 else 39)
    scored = bayes.score_bayes(model, features)
    shuffles = scored._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles == (1 if at_once == 400 else 2)
    got = probabilities(scored)
    for k in range(5):
        for i, p in brute_force([r[:3] for r in dev if r[3] != k], [r[:3] for r in dev if r[3] == k], 2, 1, 0.1).items():
            assert got[i] == pytest.approx(p, abs=1e-9)


def test_hot_terms_are_bounded(spark, small, conf):
    """However many terms exceed a salt's rows, the list that is copied to all tasks keeps its bound."""
    conf("spark.triagekit.rowsPerSalt", 1)
    table = bayes.doc_frequency(Study(small).cv_rows(Study(small).features), 5).table
    every = table.hot_terms().count()
    conf("spark.triagekit.maxHotTerms", 60)
    hot = table.hot_terms().collect()
    assert every > 60 >= len(hot) > 0
    totals = {r.term: r.total for r in table.df.collect()}
    assert all(r.n_salts >= 2 and totals[r.term] / r.n_salts <= table.rows_behind / 60 + 1 for r in hot)


def test_shuffled_joins_give_the_same_scores(spark, small, conf):
    plain = probabilities(Study(small).oof)
    conf("spark.triagekit.broadcastBytes", 1)
    conf("spark.triagekit.rowsPerSalt", 5)  # most terms are hot now
    salted = probabilities(Study(small).oof)
    assert plain.keys() == salted.keys()
    for i in plain:
        assert plain[i] == pytest.approx(salted[i], abs=1e-11)


def test_holdout_is_scored_by_the_model_of_all_development_rows(spark, small):
    st = Study(small)
    rows = [tuple(r) for r in st.split(st.docs).select("doc_id", "ticket_text", "category", "split").collect()]
    want = brute_force([r[:3] for r in rows if r[3] == "dev"], [r[:3] for r in rows if r[3] == "holdout"], 2, 1, 0.1)
    got = probabilities(st.holdout_predictions)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_class_missing_from_a_fold_gets_no_probability(spark):
    rows = [(i, f"word{i % 4} common", "ab"[i % 2]) for i in range(20)] + [(99, "odd text", "single")]
    st = Study(spark.createDataFrame(rows, "doc_id long, ticket_text string, category string"), holdout=(0, 100))
    got = probabilities(st.oof)
    assert got[99]["single"] == 0.0 and all(sum(p.values()) == pytest.approx(1) for p in got.values())


def test_grid_ranks_and_matches_single_fits(spark, small):
    specs = [s for s in grid_specs() if s.alpha != 0.5]
    st = Study(small)
    grid = {r.spec: r for r in st.grid(specs).collect()}
    assert sorted(r["rank"] for r in grid.values()) == list(range(1, len(specs) + 1))
    for i in (1, 4):
        one = Study(small, specs[i])
        s = evaluate.cv_summary(evaluate.macro_f1(one.oof, "fold")).first()
        assert grid[i]["mean"] == pytest.approx(s["mean"]) and grid[i]["std"] == pytest.approx(s["std"])


def requests(spark):
    rows = [(1, "lost my card"), (2, "  "), (3, None), (4, "x" * 6000), (5, "hello something"), (6, " reset password ")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_answers(spark, small, tmp_path):
    st = Study(small)
    got = {r.doc_id: r for r in routing.classify(requests(spark), st.scorer()).collect()}
    assert len(got) == 6
    assert [got[i].reject_reason for i in range(1, 7)] == [None, "empty", "empty", "too_long", None, None]
    for r in got.values():
        if r.reject_reason:
            assert r.route == "rejected" and r.category is None and r.top_k is None
            continue
        p = [x.probability for x in r.top_k]
        assert len(p) == 3 and p == sorted(p, reverse=True) and sum(p) <= 1 + 1e-3
        assert r.needs_review == (r.category == "needs_review") and (r.route == "needs_review") == r.needs_review
    assert got[5].needs_review and got[5].confidence < 0.61
    bayes.save_bayes(st.final_model, str(tmp_path / "m"))
    again = routing.classify(requests(spark), st.scorer(bayes.load_bayes(spark, str(tmp_path / "m"))))
    assert {r.doc_id: r for r in again.collect()} == got
    with pytest.raises(errors.ModelNotFound):
        bayes.load_bayes(spark, str(tmp_path / "none"))
    routing.write_routes(again, str(tmp_path / "routes"))
    assert spark.read.parquet(str(tmp_path / "routes")).where("route = 'rejected'").count() == 3


def test_logistic_minimises_the_stated_objective(spark, small):
    """At the fitted weights, C * sum(loss) + |w|^2 / 2 has (nearly) no slope."""
    C, labels = 10.0, ["card", "loan", "login"]
    tfidf = logistic.SmoothedTfidf().fit(small)
    rows = logistic.index_labels(tfidf.transform(small), labels).select("label", "features").cache()
    model = logistic.fit_head(rows, 90, C)
    data = rows.collect()
    X = np.array([r.features.toArray() for r in data])
    Y = np.eye(3)[[int(r.label) for r in data]]
    W, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    Z = X @ W.T + b
    P = np.exp(Z - Z.max(axis=1, keepdims=True))
    P /= P.sum(axis=1, keepdims=True)
    slope = (C * (P - Y).T @ X + W) / (C * 90)
    assert np.abs(slope).max() < 2e-3 and np.abs((P - Y).sum(axis=0) / 90).max() < 2e-3


def test_stored_pipeline_scores_the_same_in_batch_and_stream(spark, small, tmp_path):
    model = logistic.fit_logistic(small, ngram_max=2)
    logistic.save_pipeline(model, str(tmp_path / "p"))
    again = logistic.load_pipeline(spark, str(tmp_path / "p"))
    batch = {r.doc_id: r for r in routing.classify(requests(spark), logistic.logistic_scorer(model)).collect()}
    requests(spark).write.parquet(str(tmp_path / "in"))
    source = streaming.request_stream(spark, str(tmp_path / "in"), requests(spark).schema)
    streaming.classify_stream_pipeline(source, again, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()} == batch
    with pytest.raises(errors.ModelNotFound):
        logistic.load_pipeline(spark, str(tmp_path / "none"))


def test_logistic_cross_validation_has_no_leak_and_grid_agrees(spark, small):
    st = Study(small)
    dev = st.split(st.docs).where("split = 'dev'")
    preds = logistic.logistic_oof(dev, 5, C=1.0, min_df=2)
    assert preds.count() == preds.select("doc_id").distinct().count() == 76
    want = evaluate.macro_f1(with_top(preds), "fold").orderBy("fold").collect()
    got = logistic.logistic_grid(dev, 5, [1], [1, 2], [1.0]).where("min_df = 2").orderBy("fold").collect()
    assert [r.macro_f1 for r in got] == pytest.approx([r.macro_f1 for r in want])
    # Fold 0 refitted from its own texts alone, with its own vocabulary.
    train, test = dev.where("fold <> 0"), dev.where("fold = 0")
    alone = probabilities(logistic.score_logistic(logistic.fit_logistic(train, C=1.0, min_df=2), test, "doc_id"))
    shared = probabilities(preds.where("fold = 0"))
    assert all(alone[i] == pytest.approx(shared[i], abs=5e-3) for i in shared)


def test_vocabulary_limit_refuses_instead_of_cutting(spark, small, conf):
    conf("spark.triagekit.driverVocabulary", 3)
    with pytest.raises(errors.LimitExceeded):
        logistic.SmoothedTfidf().fit(small)


def test_embedding_head(spark, small):
    def make():
        def encode(texts):
            return np.array([[t.count(w) for w in ("card", "loan", "login", "pin", "rate", "reset")] for t in texts], dtype="float32")

        return encode

    rows = embed.encode_texts(Study(small).split(small), make, batch_size=7)
    assert rows.select(F.size("embedding")).distinct().collect()[0][0] == 6
    preds = with_top(embed.embedding_oof(rows.where("split = 'dev'"), 5))
    assert evaluate.macro_f1(preds).first().macro_f1 > 0.55


@pytest.mark.slow
def test_table_of_weights_has_the_same_optimum(spark, small, monkeypatch):
    """Against Spark ML run to its own end, on the same folds; the proof holds, and fails away from the optimum."""
    monkeypatch.setattr(logistic, "LR_TOLERANCE", 1e-13)
    st = Study(small)
    rows = st.cv_rows(st.features)
    model = softmax.fit_softmax(rows, [softmax.SoftmaxSpec(C=1.0, min_df=2)], 5, tolerance=1e-6)
    assert max(model.max_slope) <= 1e-6 and model.passes < 100
    proof = softmax.slopes(model, rows).collect()
    assert sorted(r.part for r in proof) == list(range(5)) and all(r.max_slope < 1e-5 for r in proof)
    got = {r.source_id: {x.category: x.probability for x in r.ranked} for r in softmax.score_softmax(model, rows, "source_id").collect()}
    want = probabilities(logistic.logistic_oof(st.texts("dev"), 5, C=1.0, min_df=2))
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-4) for i in want)
    moved = softmax.SoftmaxModel(model.weights, model.plain, model.bias + np.array([0.1, 0, 0]), model.fits, model.freq, [], 0)
    assert all(r.max_slope > 1e-3 for r in softmax.slopes(moved, rows).collect())


@pytest.mark.slow
def test_grid_of_weight_tables_agrees_with_the_driver_form(spark, small, conf, monkeypatch):
    """All settings and folds in shared passes, against one fit after another."""
    monkeypatch.setattr(logistic, "LR_TOLERANCE", 1e-10)
    st = Study(small, folds=3)
    asked = dict(Cs=[0.1, 10.0], min_dfs=[1, 4], ngrams=[1, 2])
    key = lambda df: {(r.C, r.min_df, r.ngram_max, r.fold): r.macro_f1 for r in df.collect()}
    want = key(st.logistic_grid(**asked))
    conf("spark.triagekit.driverVocabulary", 10)
    got = key(st.logistic_grid(**asked))
    assert len(got) == 24 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


@pytest.mark.slow
def test_wide_vocabulary_needs_no_driver(spark, small, conf, tmp_path):
    conf("spark.triagekit.driverVocabulary", 10)
    st = Study(small)
    assert st.wide_vocabulary
    assert {r.model for r in st.candidate_summary.collect()} == {"baseline_most_frequent", "naive_bayes", "logistic_regression"}
    st.__dict__["chosen"] = "logistic_regression"
    assert st.chosen_holdout.count() == st.texts("holdout").count()
    answers = routing.classify(requests(spark), st.chosen_scorer()).collect()
    assert len(answers) == 6 and sum(r.reject_reason is not None for r in answers) == 3
    requests(spark).write.parquet(str(tmp_path / "in"))
    source = streaming.request_stream(spark, str(tmp_path / "in"), requests(spark).schema)
    st.logistic_stream(source, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    streamed = {r.doc_id: r for r in streaming.read_answers(spark, str(tmp_path / "out")).collect()}
    assert {i: r.category for i, r in streamed.items()} == {r.doc_id: r.category for r in answers}


def test_direction_is_the_two_loop_recursion():
    rng = np.random.default_rng(5)
    m, n = softmax.HISTORY, 30
    basis = rng.normal(size=(2 * m + 1, n))
    hessian = np.diag(rng.uniform(0.5, 3, n))
    basis[m : 2 * m] = basis[:m] @ hessian
    basis[:2] = basis[m : m + 2] = 0  # pairs that are not there yet
    s, y, g = basis[:m], basis[m : 2 * m], basis[-1]
    q, alpha = g.copy(), {}
    for i in reversed(range(2, m)):
        alpha[i] = s[i] @ q / (s[i] @ y[i])
        q -= alpha[i] * y[i]
    q *= s[-1] @ y[-1] / (y[-1] @ y[-1])
    for i in range(2, m):
        q += s[i] * (alpha[i] - y[i] @ q / (s[i] @ y[i]))
    assert softmax.direction(basis @ basis.T) @ basis == pytest.approx(-q)


def test_terms_in_buckets(spark, small, conf):
    """Counts, lengths, sums and scores read term rows as they lie: the same results, and no shuffle by term."""
    from triagekit.operators import vectorize
    from triagekit.plans.study import grid_specs

    def found():
        study = Study(small)
        rows = study.cv_rows(study.features)
        plain = vectorize.tfidf_weights(rows, vectorize.doc_frequency(rows, 5, study.cv_facts), facts=study.cv_facts)
        ranked = study.oof.select("doc_id", "predicted_label", "ranked").orderBy("doc_id").collect()
        held = study.holdout_predictions.select("doc_id", "ranked").orderBy("doc_id").collect()
        grid = study.grid(grid_specs()[:4]).orderBy("spec").collect()
        return study, rows, ranked, held, grid, {(r.doc_id, r.term): round(r.weight, 9) for r in plain.collect()}

    first = found()
    assert first[0].cv_facts is None
    conf("spark.triagekit.bucketedRows", 0)
    conf("spark.triagekit.broadcastBytes", 1)
    second = found()
    study, rows, facts = second[0], second[1], second[0].cv_facts
    assert first[2:] == second[2:]
    conf("spark.triagekit.normBytes", 0)
    assert first[2:] == found()[2:]
    conf("spark.sql.autoBroadcastJoinThreshold", -1)
    scored = bayes.score_bayes(bayes.fit_bayes(rows, parts=5, facts=facts), rows, "category", facts=facts)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(term" not in plan


def test_fits_beside_each_other_fit_the_driver(spark, conf):
    conf("spark.triagekit.driverFitBytes", 100 * 24 * 8)
    assert [logistic.fits_at_once(spark, n) for n in (1, 20, 50, 100, 10_000)] == [8, 5, 2, 1, 1]


def test_grid_counts_only_terms_that_a_setting_uses(spark, small, monkeypatch):
    widths = []
    whole = logistic.count_vectors
    monkeypatch.setattr(logistic, "count_vectors", lambda words, m: widths.append((m, logistic.vector_length(out := whole(words, m), "term_counts"))) or out)
    rare = small.unionByName(small.limit(3).select((F.col("doc_id") + 900).alias("doc_id"), F.concat("ticket_text", F.lit(" once"), "doc_id").alias("ticket_text"), "category"))
    dev = Study(rare).texts("dev")
    scores = logistic.logistic_grid(dev, 5, [1], [1, 3], [1.0])
    assert [m for m, _ in widths] == [1, 3] and widths[0][1] > widths[1][1]
    assert scores.groupBy("min_df").count().orderBy("min_df").collect() == [(1, 5), (3, 5)]


def test_a_pass_moves_weights_and_slopes_only(spark, small, conf, monkeypatch):
    """Blocks and buckets are read as they lie, also where there are many; the fit is the same."""
    rows = Study(small).cv_rows(Study(small).features)
    whole, plans = softmax._updated, []

    def kept(*args):
        out = whole(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(softmax, "_updated", kept)
    fit = lambda: softmax.fit_softmax(rows, [softmax.SoftmaxSpec(C=1.0)], 5)
    one = fit()
    assert all(p.count("Exchange hashpartitioning(b") == p.count("Exchange ") == 2 for p in plans)
    conf("spark.triagekit.blockValues", 1500)
    conf("spark.triagekit.bucketValues", 60)
    many = fit()
    weights = lambda m: {r.term: r.w for r in m.weights.collect()}
    a, b = weights(one), weights(many)
    assert a.keys() == b.keys() and all(a[t] == pytest.approx(b[t], abs=1e-3) for t in a)


def test_inputs_of_unlike_size_converge_in_few_passes(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(120, 4)) * [0.01, 0.3, 3.0, 30.0]
    y = (x / [0.01, 0.3, 3.0, 30.0]).sum(axis=1) + rnd.normal(size=120)
    data = [(i, "ab"[int(y[i] > 0)], i % 2, x[i].tolist()) for i in range(120)]
    rows = spark.createDataFrame(data, "doc_id long, category string, part int, embedding array<double>")
    rows = rows.withColumn("terms", softmax.vector_terms()).drop("embedding")
    model = softmax.fit_softmax(rows, [softmax.SoftmaxSpec(C=1.0, raw=True)], 2)
    assert model.passes <= 15 and all(r.max_slope < 2e-5 for r in softmax.slopes(model, rows).collect())


def test_weights_are_a_table_before_the_driver_is_sent_much(spark, small, conf, monkeypatch):
    assert not Study(small).wide_vocabulary
    conf("spark.triagekit.driverTerms", 10)
    assert Study(small).wide_vocabulary and not Study._is_wide(Study(small).counted, 2)
    monkeypatch.setattr(logistic, "fit_logistic", None)
    st = Study(small)
    answers = routing.classify(requests(spark), st.softmax_scorer())
    assert answers.count() == 6


def plain_objective(rows, C, part):
    """Weights of one fit at the optimum, by Newton steps on dense arrays; rows are (id, part, label, {term: n})."""
    train = [r for r in rows if r[1] != part]
    names, labels = sorted({t for r in train for t in r[3]}), sorted({r[2] for r in rows})
    df = np.array([sum(t in r[3] for r in train) for t in names])
    idf = np.log((1 + len(train)) / (1 + df)) + 1

    def vectors(some):
        x = np.array([[r[3].get(t, 0) for t in names] for r in some]) * idf
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return np.hstack([np.divide(x, length, out=np.zeros_like(x), where=length > 0), np.ones((len(some), 1))])

    X, n, k = vectors(train), len(train), len(labels)
    Y = np.eye(k)[[labels.index(r[2]) for r in train]]
    ridge = np.append(np.full(len(names), 1 / (C * n)), 1e-9)
    w = np.zeros((k, X.shape[1]))
    for _ in range(30):
        P = np.exp(X @ w.T)
        P /= P.sum(1, keepdims=True)
        g = (P - Y).T @ X / n + ridge * w
        hessian = np.zeros((w.size, w.size))
        for a in range(k):
            for b in range(k):
                block = (X * (P[:, a] * ((a == b) - P[:, b]))[:, None]).T @ X / n
                hessian[a * X.shape[1] : (a + 1) * X.shape[1], b * X.shape[1] : (b + 1) * X.shape[1]] = block + np.diag(ridge) * (a == b)
        w -= np.linalg.solve(hessian, g.ravel()).reshape(w.shape)
    held = [r for r in rows if r[1] == part]
    P = np.exp(vectors(held) @ w.T)
    return {r[0]: dict(zip(labels, p / p.sum())) for r, p in zip(held, P)}


@pytest.mark.parametrize("local", [True, False])
def test_fits_in_tasks_equal_newton_steps(spark, conf, local):
    """Terms of a single row, repeated terms, empty texts, and rows without label or of no part included."""
    if not local:
        conf("spark.triagekit.fitBytes", 0)
    rnd = np.random.default_rng(11)
    data = []
    for i in range(40):
        words = [f"w{x}" for x in rnd.integers(0, 8, 5)] + [f"rare{i}"] * (i % 3) + [f"odd{i}"] * (i % 2)
        data.append((i, i % 2, "abc"[(i + (words[0] > "w4")) % 3], {w: words.count(w) for w in words if i != 7}))
    rows = [(*r[:3], [(t, n) for t, n in r[3].items()] if r[0] != 9 else None) for r in data]
    features = spark.createDataFrame(rows, "doc_id long, part int, category string, terms array<struct<term:string,tf:int>>")
    data = [r if r[0] != 9 else (*r[:3], {}) for r in data]
    want = plain_objective(data, 10.0, 0) | plain_objective(data, 10.0, 1)
    model = softmax_local.fit(features.repartition(3), parts=2, tolerance=1e-8)
    assert all(r.max_slope < 1e-7 for r in softmax.slopes(model, features).collect())
    docs = softmax_local.encode(features, [softmax.SoftmaxSpec()], 2)
    assert (docs is not None) == local
    found = [softmax.score_softmax(model, features)] + ([softmax_local.held_out(docs, tolerance=1e-8)] if local else [])
    for df in found:
        got = probabilities(df)
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-5) for i in want)


def test_wide_grid_and_reports_need_few_jobs(spark, small, conf, monkeypatch):
    """All fits of a fold in one task: no pass of the optimiser is a job, and no vocabulary is collected."""
    monkeypatch.setattr(logistic, "count_vectors", None)
    monkeypatch.setattr(softmax, "_updated", None)
    conf("spark.triagekit.driverTerms", 10)
    st = Study(small)
    grid = st.logistic_grid(Cs=[1.0, 10.0], min_dfs=[1, 2], ngrams=[1, 2])
    assert grid.count() == 2 * 2 * 2 * 5
    assert st.logistic_oof.count() == 76 and st.candidate_summary.count() == 3


@pytest.mark.slow
def test_grid_and_holdout_beyond_a_task(spark, small, conf):
    """Rows that no task may hold: tables of weights give the same scores."""
    conf("spark.triagekit.driverTerms", 10)
    key = lambda df: {(r.C, r.min_df, r.ngram_max, r.fold): r.macro_f1 for r in df.collect()}
    asked = dict(Cs=[1.0], min_dfs=[1, 2], ngrams=[1, 2])
    want, model = key(Study(small, folds=3).logistic_grid(**asked)), Study(small).final_softmax
    conf("spark.triagekit.fitBytes", 0)
    assert key(Study(small, folds=3).logistic_grid(**asked)) == pytest.approx(want, abs=1e-9)
    other = Study(small).final_softmax
    a, b = ({r.term: r.w for r in m.weights.collect()} for m in (model, other))
    assert a.keys() == b.keys() and all(a[t] == pytest.approx(b[t], abs=1e-2) for t in a)


def test_stored_table_of_weights_scores_the_same(spark, small, conf, tmp_path):
    conf("spark.triagekit.driverTerms", 10)
    st = Study(small)
    rows = st.holdout_rows(st.features).where("part = 0")
    softmax.save_softmax(st.final_softmax, str(tmp_path / "m"))
    again = softmax.load_softmax(spark, str(tmp_path / "m"))
    assert probabilities(softmax.score_softmax(again, rows)) == probabilities(softmax.score_softmax(st.final_softmax, rows))
    conf("spark.triagekit.broadcastBytes", 1)
    assert probabilities(softmax.score_softmax(again, rows)) == probabilities(softmax.score_softmax(st.final_softmax, rows))
    with pytest.raises(errors.ModelNotFound):
        softmax.load_softmax(spark, str(tmp_path / "none"))


def test_score_sums_many_classes_as_vectors(spark, small, monkeypatch):
    st = Study(small)
    rows = st.cv_rows(st.features)
    model = softmax_local.fit(rows, parts=5)
    few = probabilities(softmax.score_softmax(model, rows))
    monkeypatch.setattr(softmax, "SUM_COLUMNS", 1)
    many = probabilities(softmax.score_softmax(model, rows))
    assert few.keys() == many.keys() and all(few[i] == pytest.approx(many[i], abs=1e-9) for i in few)


def test_repeated_ids_are_scored_row_by_row(spark, small):
    st = Study(small)
    model = softmax_local.fit(st.cv_rows(st.features), parts=5)
    rows = st.cv_rows(st.features).limit(6)
    twice = softmax.score_softmax(model, rows.unionByName(rows), "category")
    once = probabilities(softmax.score_softmax(model, rows, "category"))
    assert twice.count() == 12 and probabilities(twice) == once
