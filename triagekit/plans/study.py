"""A study of one labelled table: features, split, out-of-fold predictions and their reports.

Each step that several reports need is computed once, written to the shared folder and read from
there: the features, the split points, the out-of-fold predictions, the holdout predictions.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from triagekit.constants import (
    CHALLENGER_MODEL, DEFAULT_MODEL, GRID_ALPHA, GRID_C, GRID_MIN_DF, GRID_NGRAM, HOLDOUT_SHARE, LR_NGRAM,
    MAX_VOCABULARY_ON_DRIVER, N_FOLDS, SEED, STOP_WORDS,
)
from triagekit.operators import logistic, softmax, softmax_local
from triagekit.operators.baseline import predict_majority
from triagekit.operators.bayes import BayesModel, BayesSpec, fit_bayes, score_bayes
from triagekit.operators.clean import clean_labelled
from triagekit.operators.evaluate import cv_summary, macro_f1, select_model, worst_errors
from triagekit.operators.profile import label_list
from triagekit.operators.ranking import confidence, top_label
from triagekit.operators.split import assign_split, split_cuts
from triagekit.operators.vectorize import Facts, add_terms, term_facts, term_rows
from triagekit.session import setting
from triagekit.sources.store import materialize
from triagekit.streaming.classify import classify_stream, classify_stream_pipeline

#: Weights (fits x classes) of a term that a grid's fits hold at once; the optimiser keeps twenty arrays of them.
GRID_WEIGHTS = 256
#: Terms up to which the five fits of a cross-validation, a hundred passes each, send the driver under 1 GB of slopes.
DRIVER_TERMS = 80_000


def grid_specs() -> list[BayesSpec]:
    """All naive Bayes settings, in the order that decides ties."""
    return [BayesSpec(n, m, a) for a in GRID_ALPHA for m in GRID_MIN_DF for n in GRID_NGRAM]


def with_top(preds: DataFrame) -> DataFrame:
    """Add the predicted label and its confidence to ranked rows."""
    return preds.withColumn("predicted_label", top_label()).withColumn("confidence", confidence())


class Study:
    """``docs`` is ``(doc_id, ticket_text, category)``.

    Ids may repeat or be null: features carry a ``row_key`` of their own, and results the caller's id.
    Rows with the same id share a fold; a row without id is split by the digest of its text.
    """

    def __init__(
        self,
        docs: DataFrame,
        spec: BayesSpec = BayesSpec(),
        folds: int = N_FOLDS,
        holdout: tuple[int, int] = HOLDOUT_SHARE,
        seed: int = SEED,
        stop_words=STOP_WORDS,
    ):
        by_text = F.concat(F.lit("text:"), F.md5("ticket_text"))
        self.docs = clean_labelled(docs).withColumn("split_key", F.coalesce(F.col("doc_id").cast("string"), by_text))
        self.spec, self.folds, self.holdout, self.seed = spec, folds, holdout, seed
        self.stop_words = tuple(stop_words)

    def terms(self, df: DataFrame, ngram_max: int | None = None) -> DataFrame:
        return add_terms(df, ngram_max=ngram_max or self.spec.ngram_max, stop_words=self.stop_words)

    @cached_property
    def counted(self) -> DataFrame:
        """``doc_id, category, split_key, row_key, ticket_text, terms`` of all rows: the only step that reads the
        source. Readers take the columns that they need; the texts lie beside the keys that name them."""
        keyed = self.docs.withColumn("row_key", F.monotonically_increasing_id()).withColumn("_text", F.col("ticket_text"))
        return materialize(self.terms(keyed).withColumnRenamed("_text", "ticket_text"), "features")

    @cached_property
    def cuts(self) -> DataFrame:
        """Split points; reads ids and labels of the written features."""
        ids = self.counted.select("split_key", "category")
        return split_cuts(ids, "split_key", holdout=self.holdout, k=self.folds, seed=self.seed)

    def split(self, df: DataFrame) -> DataFrame:
        """Add ``split`` and ``fold`` to rows with ``split_key`` (else ``doc_id``) and ``category``; map-side only."""
        return assign_split(df, self.cuts, "split_key" if "split_key" in df.columns else "doc_id", seed=self.seed)

    @property
    def features(self) -> DataFrame:
        return self.split(self.counted)

    @property
    def grid_features(self) -> DataFrame:
        if self.spec.ngram_max >= max(GRID_NGRAM):
            return self.features
        return self.split(materialize(self.terms(self.counted.drop("terms"), max(GRID_NGRAM)), "grid-features"))

    def cv_rows(self, features: DataFrame, key: str = "row_key") -> DataFrame:
        """Development rows; each is held out from its own fold. ``key`` is what models know a row by."""
        return self._rows(features.where("split = 'dev'"), F.col("fold"), key)

    def holdout_rows(self, features: DataFrame, key: str = "row_key") -> DataFrame:
        """All rows; the holdout is held out from the only part, development rows from none."""
        return self._rows(features, F.when(F.col("split") == "dev", -1).otherwise(0), key)

    @staticmethod
    def _rows(features: DataFrame, part: Column, key: str) -> DataFrame:
        return features.select(
            F.col(key).alias("doc_id"), F.col("doc_id").alias("source_id"), "category", part.alias("part"), "terms"
        )

    def _named(self, preds: DataFrame) -> DataFrame:
        """Out-of-fold predictions by row key, with the caller's ids beside it."""
        return preds.select(
            F.col("source_id").alias("doc_id"), "category", F.col("part").alias("fold"), "predicted_label", "confidence",
            "ranked", F.col("doc_id").alias("row_key"),
        )

    @cached_property
    def cv_facts(self) -> Facts | None:
        """Term rows of the development rows, which every fit and score over the folds reads as they lie."""
        return term_facts(self.cv_rows(self.features), self.folds)

    @cached_property
    def oof(self) -> DataFrame:
        """Every development row scored once, by the model of the other folds."""
        rows, facts = self.cv_rows(self.features), self.cv_facts
        model = fit_bayes(rows, [self.spec], self.folds, facts)
        return materialize(self._named(with_top(score_bayes(model, rows, "category", "source_id", facts=facts))), "oof")

    @cached_property
    def baseline_oof(self) -> DataFrame:
        rows = self.features.where("split = 'dev'").select("doc_id", "category", F.col("fold").alias("part"))
        return predict_majority(rows, self.folds).withColumnRenamed("part", "fold")

    @property
    def fold_scores(self) -> DataFrame:
        """``model, fold, macro_f1`` of the baseline and naive Bayes."""
        return scores_of({"baseline_most_frequent": self.baseline_oof, DEFAULT_MODEL: self.oof})

    @property
    def summary(self) -> DataFrame:
        return cv_summary(self.fold_scores, "model")

    @cached_property
    def final_model(self) -> BayesModel:
        """Fitted on all development rows."""
        return fit_bayes(self.holdout_rows(self.features), [self.spec])

    @cached_property
    def holdout_predictions(self) -> DataFrame:
        rows = self.holdout_rows(self.features).where("part = 0")
        preds = with_top(score_bayes(self.final_model, rows, "category", "source_id"))
        named = preds.withColumn("doc_id", F.col("source_id"))
        return materialize(named.select("doc_id", "category", "predicted_label", "confidence", "ranked"), "holdout")

    def texts(self, split: str) -> DataFrame:
        """Texts of the development rows (``dev``) or of the holdout."""
        rows = self.split(self.counted).where(F.col("split") == split)
        return rows.select("doc_id", "ticket_text", "category", "fold", "row_key")

    def worst_errors(self, oof: DataFrame) -> DataFrame:
        """The most confident wrong out-of-fold predictions of a model, one row each, with their texts."""
        return worst_errors(oof, self.counted, key="row_key")

    @cached_property
    def wide_vocabulary(self) -> bool:
        """Whether the fits of logistic regression have more terms than a driver should be sent in every pass; their
        weights are then a table."""
        return self._is_wide(self.counted, LR_NGRAM, setting(self.docs.sparkSession, "driverTerms", DRIVER_TERMS))

    @staticmethod
    def _is_wide(rows: DataFrame, ngram_max: int, limit: int = MAX_VOCABULARY_ON_DRIVER) -> bool:
        terms = term_rows(rows).where(F.lit(ngram_max > 1) | (F.instr("term", " ") == 0)).select("term").distinct()
        return terms.count() > min(limit, setting(rows.sparkSession, "driverVocabulary", MAX_VOCABULARY_ON_DRIVER))

    @cached_property
    def softmax_cv(self) -> softmax.SoftmaxModel:
        """Logistic regression of every fold, with its weights as a table."""
        return softmax_local.fit(self.cv_rows(self.features), parts=self.folds)

    @cached_property
    def logistic_oof(self) -> DataFrame:
        """The same as ``oof``, by logistic regression."""
        if self.wide_vocabulary:
            rows = self.cv_rows(self.features)
            preds = with_top(softmax_local.out_of_fold(rows, self.folds, "category", "source_id"))
            return materialize(self._named(preds), "logistic-study-oof")
        # The fits only carry the id along, so it may be a pair.
        both = self.texts("dev").withColumn("doc_id", F.struct("row_key", F.col("doc_id").alias("source_id")))
        preds = with_top(logistic.logistic_oof(both, self.folds, stop_words=self.stop_words)).withColumnRenamed("fold", "part")
        named = preds.withColumn("source_id", F.col("doc_id.source_id")).withColumn("doc_id", F.col("doc_id.row_key"))
        return materialize(self._named(named), "logistic-study-oof")

    def logistic_grid(self, Cs=GRID_C, min_dfs=GRID_MIN_DF, ngrams=GRID_NGRAM) -> DataFrame:
        """``C, min_df, ngram_max, fold, macro_f1`` of all settings of logistic regression.

        Where the vocabulary is too wide for a driver, the fits of a fold share a task that holds its rows; beyond
        that weights are tables, and as many settings as ``spark.triagekit.gridWeights`` allows share every pass,
        with all their folds.
        """
        features, spark = self.grid_features, self.docs.sparkSession
        if not self._is_wide(features, max(ngrams), setting(spark, "driverTerms", DRIVER_TERMS)):
            return logistic.logistic_grid(self.texts("dev"), self.folds, ngrams, min_dfs, Cs, self.stop_words)
        rows = self.cv_rows(features)
        specs = [softmax.SoftmaxSpec(n, m, float(C)) for n in ngrams for m in min_dfs for C in Cs]
        docs = softmax_local.encode(rows, specs, self.folds, "category")
        if docs:
            return self._grid_scores(softmax_local.held_out(docs, "category"), specs)
        weights = setting(spark, "gridWeights", GRID_WEIGHTS)
        at_once = max(1, weights // (self.folds * len(label_list(rows, least=2))))
        return reduce(
            DataFrame.unionByName, [self._grid_part(rows, specs[low : low + at_once]) for low in range(0, len(specs), at_once)]
        )

    def _grid_part(self, rows: DataFrame, specs: list[softmax.SoftmaxSpec]) -> DataFrame:
        model = softmax.fit_softmax(rows, specs, self.folds)
        return self._grid_scores(softmax.score_softmax(model, rows, "category"), specs)

    @staticmethod
    def _grid_scores(ranked: DataFrame, specs: list[softmax.SoftmaxSpec]) -> DataFrame:
        preds = with_top(ranked)
        scores = macro_f1(preds.select("spec", "part", "category", "predicted_label"), "spec", "part")
        names = ["C", "min_df", "ngram_max"]
        params = [F.get(F.lit([getattr(s, name) for s in specs]), F.col("spec")).alias(name) for name in names]
        return materialize(scores.select(*params, F.col("part").alias("fold"), "macro_f1"), "logistic-grid")

    @property
    def candidate_summary(self) -> DataFrame:
        """Mean and deviation of the baseline and of both candidates on the same folds."""
        scores = scores_of({"baseline_most_frequent": self.baseline_oof, DEFAULT_MODEL: self.oof, CHALLENGER_MODEL: self.logistic_oof})
        return cv_summary(scores, "model")

    @cached_property
    def chosen(self) -> str:
        """The candidate that the rule selects; ``chosen_oof`` serves its reports and threshold."""
        return select_model(self.candidate_summary, CHALLENGER_MODEL).first()["chosen"]

    @property
    def chosen_oof(self) -> DataFrame:
        return self.logistic_oof if self.chosen == CHALLENGER_MODEL else self.oof

    @cached_property
    def final_logistic(self) -> PipelineModel:
        return logistic.fit_logistic(self.texts("dev"), stop_words=self.stop_words)

    @cached_property
    def final_softmax(self) -> softmax.SoftmaxModel:
        return softmax_local.fit(self.holdout_rows(self.features))

    @cached_property
    def chosen_holdout(self) -> DataFrame:
        """The holdout by the chosen model, fitted on all development rows."""
        if self.chosen != CHALLENGER_MODEL:
            return self.holdout_predictions
        if self.wide_vocabulary:
            rows = self.holdout_rows(self.features).where("part = 0")
            preds = with_top(softmax.score_softmax(self.final_softmax, rows, "category", "source_id")).withColumn("doc_id", F.col("source_id"))
            return materialize(preds.select("doc_id", "category", "predicted_label", "confidence", "ranked"), "logistic-holdout")
        preds = with_top(logistic.score_logistic(self.final_logistic, self.texts("holdout"), "doc_id", "category"))
        return materialize(preds.select("doc_id", "category", "predicted_label", "confidence", "ranked"), "logistic-holdout")

    def chosen_scorer(self):
        if self.chosen == CHALLENGER_MODEL and self.wide_vocabulary:
            return self.softmax_scorer()
        return logistic.logistic_scorer(self.final_logistic) if self.chosen == CHALLENGER_MODEL else self.scorer()

    def logistic_stream(self, requests: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
        """Answer a stream ``(doc_id, text)`` by logistic regression: row by row inside the stream's own plan, or
        per micro-batch by the table of weights where the vocabulary is too wide for a driver."""
        if self.wide_vocabulary:
            return classify_stream(requests, self.softmax_scorer(), out, checkpoint, **options)
        return classify_stream_pipeline(requests, self.final_logistic, out, checkpoint, **options)

    def softmax_scorer(self):
        """As ``scorer``, by logistic regression with its weights as a table."""

        def score(df: DataFrame, *keep: str) -> DataFrame:
            rows = self.terms(df.withColumn("part", F.lit(0)), self.final_softmax.fits.specs[0].ngram_max)
            return softmax.score_softmax(self.final_softmax, rows, "reject_reason", *keep)

        return score

    def scorer(self, model: BayesModel | None = None):
        """A function that adds ``ranked`` to ``(doc_id, ticket_text, reject_reason)``."""
        model = model or self.final_model

        def score(df: DataFrame, *keep: str) -> DataFrame:
            rows = self.terms(df.withColumn("part", F.lit(0)), model.header.rules[0].ngram_max)
            return score_bayes(model, rows, "reject_reason", *keep)

        return score

    def grid(self, specs: list[BayesSpec] | None = None) -> DataFrame:
        """Mean and deviation of every setting, with its rank; earlier settings win ties.

        All settings and folds share the passes over the data.
        """
        specs = specs or grid_specs()
        rows = self.cv_rows(self.grid_features)
        facts = self.cv_facts if self.spec.ngram_max >= max(GRID_NGRAM) else term_facts(rows, self.folds)
        preds = with_top(score_bayes(fit_bayes(rows, specs, self.folds, facts), rows, "category", facts=facts))
        scores = macro_f1(preds.select("spec", "part", "category", "predicted_label"), "spec", "part")
        return rank_grid(cv_summary(scores, "spec"), specs)


def scores_of(predictions: dict[str, DataFrame]) -> DataFrame:
    """``model, fold, macro_f1`` of several models' predictions."""
    one = lambda name, df: macro_f1(df.select("fold", "category", "predicted_label"), "fold").select(
        F.lit(name).alias("model"), "fold", "macro_f1"
    )
    return reduce(DataFrame.unionByName, [one(*item) for item in predictions.items()])


def rank_settings(summary: DataFrame, *params: str) -> DataFrame:
    """Add the rank of each setting; of equal means the first in the order of ``params`` wins."""
    order = Window.orderBy(F.desc(F.round("mean", 12)), *params)  # one row per setting
    return summary.withColumn("rank", F.row_number().over(order))


def best_setting(ranked: DataFrame, model: str, *params: str) -> DataFrame:
    """One report row: the model, its best parameters as text in the order of their names, mean and deviation."""
    text = F.concat_ws(", ", *[F.concat(F.lit(f"{p}="), F.col(p).cast("string")) for p in sorted(params)])
    return ranked.where("rank = 1").select(F.lit(model).alias("model"), text.alias("best_params"), "mean", "std")


def rank_grid(summary: DataFrame, specs: list[BayesSpec]) -> DataFrame:
    params = summary.sparkSession.createDataFrame(
        [(i, s.alpha, s.min_df, s.ngram_max) for i, s in enumerate(specs)],
        "spec int, alpha double, min_df int, ngram_max int",
    )
    named = summary.join(F.broadcast(params), "spec").select("spec", "alpha", "min_df", "ngram_max", "mean", "std")
    return rank_settings(named, "spec")
