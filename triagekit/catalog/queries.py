"""One query per operator over the given tables; each takes ``(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagekit.constants import (
    HEAD_C, N_FOLDS, N_MEASURED, PRECISION_TARGET,
)
from triagekit.functions.text import display_label, percent, term_list, tokens, without
from triagekit.operators import embed, evaluate, logistic, profile, routing, softmax, split, thresholds, vectorize
from triagekit.operators.bayes import BayesSpec, fit_bayes, load_bayes, log_likelihoods, save_bayes, score_bayes
from triagekit.operators.clean import check_requests, clean_labelled
from triagekit.operators.ranking import top_k
from triagekit.plans import compare
from triagekit.plans.study import Study, best_setting, rank_settings, with_top
from triagekit.sources import labelled, views
from triagekit.sources.store import load_or_build, materialize, new_path, write_csv, write_metrics
from triagekit.streaming import classify as streaming

Query = Callable[[SparkSession, str], DataFrame]

_studies: dict[tuple[str, str, str], Study] = {}


def study(spark: SparkSession, sf_dir: str, view: str) -> Study:
    """The study of a view; its written tables serve all queries of the same session."""
    key = (spark.sparkContext.applicationId, sf_dir, view)
    if key not in _studies:
        _studies[key] = Study(getattr(views, view)(spark, sf_dir))
    return _studies[key]


def forget_studies() -> None:
    _studies.clear()


def r6(column: str) -> F.Column:
    return F.round(column, 6).alias(column)


# --- sources, cleaning, profile ---------------------------------------------------------------


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at full stops and line ends: many have blanks around them, many are empty. Not
    every document has a label."""
    docs = views.table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    labels = views.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("category"))
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", F.explode(F.split("text", "[.\n]")).alias("ticket_text"), "category"
    )


def clean_filter(spark, sf_dir):
    return clean_labelled(sentences(spark, sf_dir)).select("doc_id", "ticket_text", "category")


def union_labeled(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("text", F.col("lang").alias("category"), "source")
    turns = views.table(spark, sf_dir, "conversations").select("text", F.col("role").alias("category"), "turn")
    both = labelled.append_by_name(docs, turns).withColumnRenamed("text", "ticket_text")
    return both.select(F.md5("ticket_text").alias("text_md5"), "category", "source", "turn")


def tag_and_append(spark, sf_dir):
    read = lambda name, column: views.table(spark, sf_dir, name).select(F.col(column).alias("ticket_text"))
    tables = {
        "document": read("documents", "text"),
        "turn": read("conversations", "text"),
        "item": read("benchmark", "text"),
        "page": read("pages", "html"),
    }
    return labelled.tag_and_append(tables).select(F.md5("ticket_text").alias("text_md5"), "category")


def rename_and_select(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").withColumn("category", F.col("lang"))
    return labelled.as_ticket_text(docs).select(F.md5("ticket_text").alias("text_md5"), "category")


def class_histogram(spark, sf_dir):
    return profile.class_histogram(views.t_lang(spark, sf_dir))


def class_extremes(spark, sf_dir):
    return profile.class_extremes(views.t_lang(spark, sf_dir))


def sorted_labels(spark, sf_dir):
    return profile.sorted_labels(views.t_role(spark, sf_dir))


def duplicate_rate(spark, sf_dir):
    return profile.duplicate_rate(views.t_lang(spark, sf_dir)).withColumn("duplicate_rate", r6("duplicate_rate"))


def median_by_group(spark, sf_dir):
    out = profile.exact_median(views.table(spark, sf_dir, "events"), "event_type", "value")
    return out.withColumn("median", r6("median"))


def display_labels(spark, sf_dir):
    parts = views.table(spark, sf_dir, "part").select(F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("label"))
    names = views.table(spark, sf_dir, "pages").select(F.col("url").alias("label"))
    return parts.unionByName(names).groupBy("label").agg(F.count("*").alias("count")).select(
        "label", display_label(F.col("label")).alias("shown"), "count"
    )


def measuring_sample(spark, sf_dir):
    return views.t_lang(spark, sf_dir).select("doc_id", F.length("ticket_text").alias("n_chars")).orderBy("doc_id").limit(N_MEASURED)


# --- requests ---------------------------------------------------------------------------------


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON bodies: turns of conversations, and event properties, which have no text field."""
    turns = views.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("request_id"), F.to_json(F.struct("text")).alias("body")
    )
    events = views.table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), "event_id").alias("request_id"), F.col("props").alias("body")
    )
    return turns.unionByName(events)


def request_parse(spark, sf_dir):
    parsed = check_requests(labelled.parse_requests(request_bodies(spark, sf_dir)))
    return parsed.select("request_id", "reject_reason", F.md5("clean_text").alias("text_md5"))


def request_validation(spark, sf_dir):
    """Whole documents (some are too long) and their sentences (some are blank)."""
    docs = views.table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text", F.lit("document").alias("kind"))
    cut = sentences(spark, sf_dir).select("doc_id", F.col("ticket_text").alias("text"), F.lit("sentence").alias("kind"))
    checked = check_requests(docs.unionByName(cut))
    return checked.select(
        "doc_id", "kind", "reject_reason", F.length("clean_text").alias("clean_chars"), F.md5("clean_text").alias("text_md5")
    )


# --- splits -----------------------------------------------------------------------------------


def holdout_split(spark, sf_dir):
    rows = clean_labelled(views.t_lang(spark, sf_dir)).select("doc_id", "category")
    return split.stratified_split(rows).select("doc_id", "category", "split")


def fold_assign(spark, sf_dir):
    rows = clean_labelled(views.t_role(spark, sf_dir)).select("doc_id", "category")
    return split.stratified_split(rows, holdout=(0, 100)).select("doc_id", "category", "fold")


def dev_folds(spark, sf_dir):
    st = study(spark, sf_dir, "t_quality")
    return st.split(st.docs.select("doc_id", "category")).groupBy("category", "split", "fold").agg(F.count("*").alias("count"))


# --- text features ----------------------------------------------------------------------------


def token_lists(spark, sf_dir):
    df = views.t_lang(spark, sf_dir).select("doc_id", tokens(F.col("ticket_text")).alias("t"))
    df = df.withColumn("kept", without(F.col("t"), vectorize.STOP_WORDS))
    return df.select(
        "doc_id", F.size("t").alias("n_all"), F.size("kept").alias("n_kept"), F.array_join("kept", " ").alias("tokens")
    )


def ngrams(spark, sf_dir):
    df = term_list(views.t_role(spark, sf_dir), "ticket_text", "terms", 2, vectorize.STOP_WORDS)
    return df.select("doc_id", F.size("terms").alias("n_terms"), F.array_join("terms", "|").alias("terms"))


def plain_features(spark: SparkSession, sf_dir: str, ngram_max: int = 1) -> DataFrame:
    df = views.t_lang(spark, sf_dir).withColumn("part", F.lit(-1))
    return materialize(vectorize.add_terms(df, ngram_max=ngram_max), "plain-features")


def term_counts(spark, sf_dir):
    df = vectorize.add_terms(views.t_lang(spark, sf_dir))
    return vectorize.term_rows(df, "doc_id")


def doc_freq(spark, sf_dir):
    freq = vectorize.doc_frequency(plain_features(spark, sf_dir, 2))
    return (
        freq.table.df.where("total >= 2")
        .withColumn("idf", F.round(vectorize.train_idf(0, freq.n_train), 6))
        .select("term", F.col("total").alias("df"), "idf")
    )


def tfidf(spark, sf_dir):
    rows = plain_features(spark, sf_dir)
    facts = vectorize.term_facts(rows)
    weights = vectorize.tfidf_weights(rows, vectorize.doc_frequency(rows, facts=facts), facts=facts)
    return weights.select("doc_id", "term", "tf", r6("weight"))


def tfidf_holdout(spark, sf_dir):
    """Statistics of development rows, applied to holdout rows: unseen terms have no weight."""
    st = study(spark, sf_dir, "t_lang")
    rows = st.holdout_rows(st.features, "doc_id")
    freq = vectorize.doc_frequency(rows)
    rule = vectorize.TermRule(ngram_max=2, min_df=3)
    return vectorize.tfidf_weights(rows.where("part = 0"), freq, rule).select("doc_id", "term", "tf", r6("weight"))


# --- models and their reports -------------------------------------------------------------------


def nb_model(spark, sf_dir):
    st = study(spark, sf_dir, "t_role")
    return log_likelihoods(st.final_model).select("term", "category", r6("weight_sum"), r6("log_likelihood"))


def flat_top(df: DataFrame, k: int = 3) -> list:
    """The first ``k`` candidates as plain columns."""
    first = top_k(k=k, places=6)
    out = []
    for i in range(k):
        item = F.get(first, F.lit(i))
        out += [item["category"].alias(f"category_{i + 1}"), item["probability"].alias(f"probability_{i + 1}")]
    return out


def nb_oof_topk(spark, sf_dir):
    df = study(spark, sf_dir, "t_lang").oof
    return df.select("doc_id", "category", "fold", "predicted_label", r6("confidence"), *flat_top(df))


def majority_oof(spark, sf_dir):
    return study(spark, sf_dir, "t_quality").baseline_oof.select("doc_id", "category", "fold", "predicted_label")


def macro_f1_by_fold(spark, sf_dir):
    return study(spark, sf_dir, "t_quality").fold_scores.select("model", "fold", r6("macro_f1"))


def cv_summary(spark, sf_dir):
    return study(spark, sf_dir, "t_role").summary.select("model", r6("mean"), r6("std"), "folds")


def class_f1(spark, sf_dir):
    scores = evaluate.class_scores(evaluate.confusion_long(study(spark, sf_dir, "t_role").oof))
    return scores.select("label", "tp", "fp", "fn", r6("f1"))


def confusion_long(spark, sf_dir):
    return evaluate.confusion_long(study(spark, sf_dir, "t_role").oof)


def confusion_wide(spark, sf_dir):
    st = study(spark, sf_dir, "t_role")
    return evaluate.confusion_wide(st.oof, profile.label_list(st.oof), prefix="as_")


def confused_pairs(spark, sf_dir):
    return evaluate.confused_pairs(evaluate.confusion_long(study(spark, sf_dir, "t_role").oof))


def worst_errors(spark, sf_dir):
    st = study(spark, sf_dir, "t_role")
    return st.worst_errors(st.oof).withColumn("confidence", r6("confidence"))


def threshold_sweep(spark, sf_dir):
    sweep = thresholds.threshold_sweep(study(spark, sf_dir, "t_role").oof)
    return sweep.select("idx", "threshold", "accepted", r6("coverage"), r6("precision"))


def threshold_choice(spark, sf_dir):
    """The usual target and a lower one, on two views."""
    out = []
    for view in ("t_role", "t_quality"):
        sweep = thresholds.threshold_sweep(study(spark, sf_dir, view).oof)
        for target in (0.6, PRECISION_TARGET):
            chosen = thresholds.choose_threshold(sweep, target)
            out.append(
                chosen.select(
                    F.lit(view).alias("view"), F.lit(target).alias("target"), "threshold", "accepted", r6("coverage"),
                    r6("precision"),
                )
            )
    return labelled.append_by_name(*out)


def sweep_display(spark, sf_dir):
    sweep = thresholds.threshold_sweep(study(spark, sf_dir, "t_quality").oof)
    return thresholds.display_rows(sweep).select("threshold", "accepted", r6("coverage"), r6("precision"))


def review_flags(spark, sf_dir):
    df = study(spark, sf_dir, "t_role").oof
    conf = F.col("confidence")
    return df.select(
        "doc_id",
        thresholds.is_low_confidence(conf).alias("needs_review"),
        thresholds.is_accepted(conf).alias("accepted"),
        (F.col("category") == F.col("predicted_label")).alias("correct"),
        percent(conf).alias("percent"),
    )


def model_select(spark, sf_dir):
    """The default naive Bayes against a smoother, unigram one."""
    st = study(spark, sf_dir, "t_role")
    summary = st.summary.where("model = 'naive_bayes'").unionByName(
        _challenger(st).select(F.lit("naive_bayes_smooth").alias("model"), "mean", "std", "folds")
    )
    return evaluate.select_model(summary, "naive_bayes_smooth").select(r6("gap"), r6("bar"), "distinct", "chosen")


def _challenger(st: Study) -> DataFrame:
    rows = st.cv_rows(st.features)
    model = fit_bayes(rows, [BayesSpec(1, 2, 1.0)], st.folds, st.cv_facts)
    preds = with_top(score_bayes(model, rows, "category", facts=st.cv_facts))
    return evaluate.cv_summary(evaluate.macro_f1(preds, "part"))


def holdout_eval(spark, sf_dir):
    preds = study(spark, sf_dir, "t_role").holdout_predictions
    score = evaluate.macro_f1(preds)
    counts = preds.agg(F.count("*").alias("rows"), F.count_if(F.col("category") == F.col("predicted_label")).alias("correct"))
    # One row on either side; both carry the same constant.
    return score.withColumn("one", F.lit(1)).unionByName(counts.withColumn("one", F.lit(1)), allowMissingColumns=True).groupBy(
        "one"
    ).agg(F.max("macro_f1").alias("macro_f1"), F.max("rows").alias("rows"), F.max("correct").alias("correct")).select(
        r6("macro_f1"), "rows", "correct"
    )


def quality_gate(spark, sf_dir):
    return evaluate.quality_gate(study(spark, sf_dir, "t_lang").summary).withColumn("value", r6("value"))


def nb_grid(spark, sf_dir):
    """All 18 settings over all folds."""
    out = study(spark, sf_dir, "t_role").grid()
    return out.select("spec", "alpha", "min_df", "ngram_max", r6("mean"), r6("std"), "rank")


def tuning_report(spark, sf_dir):
    """The best setting of naive Bayes."""
    grid = study(spark, sf_dir, "t_role").grid()
    return best_setting(grid, "naive_bayes", "alpha", "min_df", "ngram_max").select("model", "best_params", r6("mean"), r6("std"))


def tuning_report_both(spark, sf_dir):
    """The best setting of naive Bayes and of logistic regression."""
    best = best_setting(lr_grid(spark, sf_dir), "logistic_regression", "C", "min_df", "ngram_max")
    return tuning_report(spark, sf_dir).unionByName(best.select("model", "best_params", r6("mean"), r6("std")))


def candidate_cv(spark, sf_dir):
    """Baseline, naive Bayes and logistic regression on the same folds."""
    return study(spark, sf_dir, "t_role").candidate_summary.select("model", r6("mean"), r6("std"), "folds")


def chosen_model(spark, sf_dir):
    """The candidate that the rule selects: its threshold and its score on the holdout, after a fit on all
    development rows."""
    st = study(spark, sf_dir, "t_role")
    threshold = thresholds.choose_threshold(thresholds.threshold_sweep(st.chosen_oof), 0.6).select("threshold", F.lit(1).alias("one"))
    held = st.chosen_holdout
    counts = held.agg(F.count("*").alias("holdout_rows"), F.lit(1).alias("one"))
    score = evaluate.macro_f1(held).select(F.col("macro_f1").alias("holdout_f1"), F.lit(1).alias("one"))
    # One row each.
    both = counts.join(F.broadcast(score), "one").join(F.broadcast(threshold), "one", "left")
    return both.select(F.lit(st.chosen).alias("chosen"), "threshold", "holdout_rows", r6("holdout_f1"))


def chosen_confusion(spark, sf_dir):
    """Counts of every pair of labels that the selected candidate gives out of fold."""
    return evaluate.confusion_long(study(spark, sf_dir, "t_role").chosen_oof)


def chosen_worst_errors(spark, sf_dir):
    """The most confident errors of the selected candidate, with their texts."""
    st = study(spark, sf_dir, "t_role")
    return st.worst_errors(st.chosen_oof).withColumn("confidence", r6("confidence"))


def chosen_sweep_display(spark, sf_dir):
    """Every tenth threshold of the selected candidate."""
    sweep = thresholds.threshold_sweep(study(spark, sf_dir, "t_role").chosen_oof)
    return thresholds.display_rows(sweep).select("threshold", "accepted", r6("coverage"), r6("precision"))


def quality_gate_all(spark, sf_dir):
    """The floor that every candidate has to pass, logistic regression included."""
    return evaluate.quality_gate(study(spark, sf_dir, "t_role").candidate_summary).withColumn("value", r6("value"))


def errors_by_conversation(spark, sf_dir):
    """Ids that repeat: the worst errors are single turns, each with its own text."""
    turns = views.table(spark, sf_dir, "conversations", "conv_id").select(
        F.col("conv_id").alias("doc_id"), F.col("text").alias("ticket_text"), F.col("role").alias("category")
    )
    st = Study(turns)
    return st.worst_errors(st.oof).select("doc_id", F.md5("ticket_text").alias("text_md5"), "true_label", "predicted_label", r6("confidence"))


def oof_by_conversation(spark, sf_dir):
    """Ids that repeat: all turns of a conversation have one, and the first conversations have none."""
    turns = views.table(spark, sf_dir, "conversations", "conv_id").select(
        F.when(F.col("conv_id") % 7 != 0, F.col("conv_id")).alias("doc_id"), F.col("text").alias("ticket_text"),
        F.col("role").alias("category"),
    )
    st = Study(turns)
    rows = labelled.append_by_name(
        st.oof.select("doc_id", "category", F.lit("dev").alias("split")),
        st.holdout_predictions.select("doc_id", "category", F.lit("holdout").alias("split")),
    )
    return rows.groupBy("doc_id", "category").agg(F.count("*").alias("rows"))


# --- tables written and read back ---------------------------------------------------------------


def csv_round_trip(spark, sf_dir):
    """Labelled texts written as CSV and loaded again."""
    path = new_path(spark, "labelled-csv")
    labelled.write_labelled(clean_labelled(views.t_lang(spark, sf_dir)), path)
    return labelled.load_labelled(spark, path).select(F.md5("ticket_text").alias("text_md5"), "category")


def report_csv(spark, sf_dir):
    path = new_path(spark, "report-csv")
    write_csv(class_histogram(spark, sf_dir), path)
    return labelled.read_csv(spark, path).select("category", F.col("count").cast("long").alias("count"))


def metric_report(spark, sf_dir):
    """Mean text length per language, as lines with four decimal places."""
    path = new_path(spark, "metrics")
    docs = views.table(spark, sf_dir, "documents")
    means = docs.groupBy(F.col("lang").alias("metric")).agg(F.avg(F.length("text")).alias("value"))
    write_metrics(means, path, places=4)
    return spark.read.text(path).select(F.col("value").alias("line"))


def cache_reuse(spark, sf_dir):
    """A cache is built once: the second call would build an empty table."""
    path, counts = new_path(spark, "cache"), class_histogram(spark, sf_dir)
    load_or_build(spark, path, lambda: counts)
    return load_or_build(spark, path, lambda: counts.where("false"))


def saved_model(spark, sf_dir):
    """Weights of a model that was saved and loaded."""
    path = new_path(spark, "saved-model")
    save_bayes(study(spark, sf_dir, "t_role").final_model, path)
    return log_likelihoods(load_bayes(spark, path)).select("term", "category", r6("weight_sum"), r6("log_likelihood"))


# --- scoring and routing --------------------------------------------------------------------------


def document_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, answered by the model of conversation roles."""
    return routing.classify(document_requests(spark, sf_dir), study(spark, sf_dir, "t_role").scorer())


def flat_answers(df: DataFrame) -> DataFrame:
    top = [
        c
        for i in range(3)
        for c in (
            F.get("top_k", F.lit(i))["category"].alias(f"category_{i + 1}"),
            F.get("top_k", F.lit(i))["probability"].alias(f"probability_{i + 1}"),
        )
    ]
    return df.select("doc_id", "category", "confidence", "needs_review", "reject_reason", "route", *top)


def classify_batch(spark, sf_dir):
    return flat_answers(answers(spark, sf_dir))


def route_counts(spark, sf_dir):
    return routing.route_counts(answers(spark, sf_dir))


def summary_lines(spark, sf_dir):
    return routing.with_summary(answers(spark, sf_dir)).where("reject_reason IS NULL").select("doc_id", "summary")


def response_json(spark, sf_dir):
    done = answers(spark, sf_dir).where("reject_reason IS NULL")
    text = routing.response_json(done)
    back = F.from_json("response", "category string, confidence double, needs_review boolean, top_k array<struct<category:string,probability:double>>")
    return text.select("doc_id", back.alias("r")).select(
        "doc_id", "r.category", "r.confidence", "r.needs_review",
        F.array_join(F.transform("r.top_k", lambda x: F.concat(x["category"], F.lit("="), F.round(x["probability"] * 10_000).cast("int"))), "|").alias("top"),
    )


def stream_classify(spark, sf_dir):
    """The same answers from a stream over the same file."""
    schema = document_requests(spark, sf_dir).schema
    requests = streaming.request_stream(spark, f"{sf_dir}/documents.parque*", schema)
    out, mark = new_path(spark, "stream-answers"), new_path(spark, "stream-checkpoint")
    streaming.classify_stream(requests, study(spark, sf_dir, "t_role").scorer(), out, mark).awaitTermination()
    return flat_answers(streaming.read_answers(spark, out))


# --- logistic regression, embeddings, comparison ----------------------------------------------------


def role_oof(st: Study) -> DataFrame:
    """Out-of-fold predictions of logistic regression, on a wide vocabulary without one on the driver."""
    return st.logistic_oof if st.wide_vocabulary else with_top(logistic.logistic_oof(st.texts("dev"), N_FOLDS))


def lr_oof(spark, sf_dir):
    preds = role_oof(study(spark, sf_dir, "t_role"))
    return preds.select("doc_id", "category", "fold", "predicted_label", r6("confidence"))


#: No slope of an optimum may exceed this.
OPTIMAL_SLOPE = 2e-5


def optimal_rows(model: softmax.SoftmaxModel, rows) -> DataFrame:
    """Each held-out row with its fold, and whether that fold's weights have no slope, by sums over the weight table."""
    proof = softmax.slopes(model, rows).select(F.col("part").alias("fold"), (F.col("max_slope") < OPTIMAL_SLOPE).alias("optimal"))
    scored = softmax.score_softmax(model, rows, "category", "source_id").withColumnRenamed("part", "fold")
    # One row per fold.
    return scored.join(F.broadcast(proof), "fold").select(
        F.col("source_id").alias("doc_id"), "category", "fold", F.size("ranked").alias("classes"), "optimal"
    )


def lr_certificate(spark, sf_dir):
    """Logistic regression with its weights as a table, out of fold, and the proof that each fit is at its optimum."""
    st = study(spark, sf_dir, "t_role")
    return optimal_rows(st.softmax_cv, st.cv_rows(st.features))


def embedding_certificate(spark, sf_dir):
    """The same for the head on embeddings."""
    rows = split.stratified_split(views.t_emb(spark, sf_dir)).where("split = 'dev'")
    features = materialize(
        rows.select("doc_id", F.col("doc_id").alias("source_id"), "category", F.col("fold").alias("part"), softmax.vector_terms().alias("terms")),
        "vector-terms",
    )
    model = softmax.fit_softmax(features, [softmax.SoftmaxSpec(C=HEAD_C, raw=True)], N_FOLDS)
    return optimal_rows(model, features)


def lr_grid(spark, sf_dir):
    scores = study(spark, sf_dir, "t_role").logistic_grid()
    return rank_settings(evaluate.cv_summary(scores, "C", "min_df", "ngram_max"), "C", "min_df", "ngram_max")


def lr_stream(spark, sf_dir):
    """A fitted pipeline on a stream of documents."""
    st = study(spark, sf_dir, "t_role")
    schema = document_requests(spark, sf_dir).schema
    requests = streaming.request_stream(spark, f"{sf_dir}/documents.parque*", schema)
    out, mark = new_path(spark, "lr-stream"), new_path(spark, "lr-stream-checkpoint")
    st.logistic_stream(requests, out, mark).awaitTermination()
    # A stream's own sink keeps a log of whole files, which only a plain read follows.
    return flat_answers(streaming.read_answers(spark, out) if st.wide_vocabulary else spark.read.parquet(out))


def embedding_head(spark, sf_dir):
    rows = split.stratified_split(views.t_emb(spark, sf_dir)).where("split = 'dev'")
    preds = with_top(embed.embedding_oof(rows, N_FOLDS))
    return preds.select("doc_id", "category", "fold", "predicted_label", r6("confidence"))


def letter_encoder():
    """A stand-in for a sentence encoder: shares of four letters in a text.

    Built inside a function so that it travels to the workers by value.
    """

    def make():
        import numpy as np

        def encode(texts):
            return np.array([[t.count(x) / max(len(t), 1) for x in "aeio"] for t in texts], dtype="float32")

        return encode

    return make


def encode_batch(spark, sf_dir):
    df = embed.encode_texts(views.t_lang(spark, sf_dir), letter_encoder())
    return df.select(
        "doc_id", *[F.round(F.get("embedding", F.lit(i)).cast("double"), 4).alias(f"v{i}") for i in range(4)]
    )


def approach_compare(spark, sf_dir):
    """Naive Bayes, logistic regression and encoder + head on the same split and folds: scores, sizes of the
    stored models, rows per second, and how logistic regression and the head compare with naive Bayes."""
    st = study(spark, sf_dir, "t_role")
    nb = compare.approach_metrics(
        "naive_bayes", st.summary.where("model = 'naive_bayes'"), evaluate.macro_f1(st.holdout_predictions)
    )
    texts = st.split(st.counted).select("doc_id", "ticket_text", "category", "split", "fold")
    dev, held = texts.where("split = 'dev'"), texts.where("split = 'holdout'")
    held_rows, wide = st.holdout_rows(st.features).where("part = 0"), st.wide_vocabulary
    vectors = materialize(embed.encode_texts(texts, letter_encoder()).drop("ticket_text"), "vectors")
    dev_v, held_v = vectors.where("split = 'dev'"), vectors.where("split = 'holdout'")
    # Few large tasks and many small jobs: side by side they leave no slot idle.
    model, lr_preds, (head, labels), emb_preds = logistic.in_parallel(
        spark,
        [
            lambda: st.final_softmax if wide else logistic.fit_logistic(dev), lambda: role_oof(st),
            lambda: embed.fit_embedding_head(dev_v), lambda: embed.embedding_oof(dev_v, N_FOLDS),
        ],
    )
    lr = compare.approach_metrics(
        "logistic_regression",
        evaluate.cv_summary(evaluate.macro_f1(lr_preds, "fold")),
        evaluate.macro_f1(with_top(softmax.score_softmax(model, held_rows, "category") if wide else logistic.score_logistic(model, held, "category"))),
    )
    emb = compare.approach_metrics(
        "embedding",
        evaluate.cv_summary(evaluate.macro_f1(with_top(emb_preds), "fold")),
        evaluate.macro_f1(with_top(embed.score_embeddings(head, labels, held_v, "category"))),
    )
    paths = {name: new_path(spark, f"{name}-model") for name in ("naive_bayes", "logistic_regression", "embedding")}
    save_bayes(st.final_model, paths["naive_bayes"])
    (softmax.save_softmax if wide else logistic.save_pipeline)(model, paths["logistic_regression"])
    head.write().overwrite().save(paths["embedding"])
    vectors_again = embed.encode_texts(held, letter_encoder())
    by_terms = lambda path: softmax.score_softmax(softmax.load_softmax(spark, path), held_rows)
    by_texts = lambda path: logistic.score_logistic(logistic.load_pipeline(spark, path), held)
    scored = {
        "naive_bayes": score_bayes(load_bayes(spark, paths["naive_bayes"]), held_rows),
        "logistic_regression": (by_terms if wide else by_texts)(paths["logistic_regression"]),
        "embedding": embed.score_embeddings(head, labels, vectors_again),
    }
    found = [compare.measures(name, spark, paths[name], df) for name, df in scored.items()]
    metrics = materialize(compare.compare(nb, lr, emb, *found), "approach-metrics")
    suffixes = ("cv_f1_mean", "holdout_f1", "size_mb", "rows_per_second")
    return compare.compare(metrics, *[compare.gains(metrics, name, "naive_bayes", suffixes) for name in ("logistic_regression", "embedding")])


QUERIES: dict[str, Query] = {
    "clean_filter": clean_filter,
    "union_labeled": union_labeled,
    "tag_and_append": tag_and_append,
    "rename_and_select": rename_and_select,
    "class_histogram": class_histogram,
    "class_extremes": class_extremes,
    "sorted_labels": sorted_labels,
    "duplicate_rate": duplicate_rate,
    "median_by_group": median_by_group,
    "display_labels": display_labels,
    "measuring_sample": measuring_sample,
    "request_parse": request_parse,
    "request_validation": request_validation,
    "holdout_split": holdout_split,
    "fold_assign": fold_assign,
    "dev_folds": dev_folds,
    "tokens": token_lists,
    "ngrams": ngrams,
    "term_counts": term_counts,
    "doc_freq": doc_freq,
    "tfidf": tfidf,
    "tfidf_holdout": tfidf_holdout,
    "nb_model": nb_model,
    "nb_oof_topk": nb_oof_topk,
    "majority_oof": majority_oof,
    "macro_f1_by_fold": macro_f1_by_fold,
    "cv_summary": cv_summary,
    "class_f1": class_f1,
    "confusion_long": confusion_long,
    "confusion_wide": confusion_wide,
    "confused_pairs": confused_pairs,
    "worst_errors": worst_errors,
    "threshold_sweep": threshold_sweep,
    "threshold_choice": threshold_choice,
    "sweep_display": sweep_display,
    "review_flags": review_flags,
    "model_select": model_select,
    "holdout_eval": holdout_eval,
    "quality_gate": quality_gate,
    "nb_grid": nb_grid,
    "tuning_report": tuning_report,
    "tuning_report_both": tuning_report_both,
    "candidate_cv": candidate_cv,
    "chosen_model": chosen_model,
    "chosen_confusion": chosen_confusion,
    "chosen_worst_errors": chosen_worst_errors,
    "chosen_sweep_display": chosen_sweep_display,
    "quality_gate_all": quality_gate_all,
    "errors_by_conversation": errors_by_conversation,
    "oof_by_conversation": oof_by_conversation,
    "csv_round_trip": csv_round_trip,
    "report_csv": report_csv,
    "metric_report": metric_report,
    "cache_reuse": cache_reuse,
    "saved_model": saved_model,
    "classify_batch": classify_batch,
    "route_counts": route_counts,
    "summary_lines": summary_lines,
    "response_json": response_json,
    "stream_classify": stream_classify,
    "lr_oof": lr_oof,
    "lr_certificate": lr_certificate,
    "lr_grid": lr_grid,
    "lr_stream": lr_stream,
    "embedding_head": embedding_head,
    "embedding_certificate": embedding_certificate,
    "encode_batch": encode_batch,
    "approach_compare": approach_compare,
}
