"""Logistic regression on TF-IDF or on given vectors, with Spark ML.

The model keeps one weight per class and term on the driver, so the vocabulary is counted, as a
distributed job, before it is collected; beyond the limit the fit is refused. Naive Bayes, which
holds its terms in tables, has no such limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import (
    IDF, CountVectorizer, CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer,
    SQLTransformer, StopWordsRemover, StringIndexerModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagekit.constants import (
    LR_C, LR_MAX_ITER, LR_MIN_DF, LR_NGRAM, LR_TOLERANCE, MAX_VOCABULARY_ON_DRIVER, STOP_WORDS,
    TOKEN_PATTERN,
)
from triagekit.errors import LimitExceeded, ModelNotFound
from triagekit.operators.evaluate import class_scores, confusion_long, macro_f1
from triagekit.operators.profile import label_list
from triagekit.operators.ranking import rank_probabilities
from triagekit.session import setting
from triagekit.sources.store import materialize, new_path


def token_stages(text: str, out: str, ngram_max: int, stop_words: Iterable[str]) -> list[Transformer]:
    """The same words and pairs as ``functions.text``, as stages that can be stored."""
    words = "words" if ngram_max > 1 else out
    stages: list[Transformer] = [
        RegexTokenizer(inputCol=text, outputCol="all_words", pattern=TOKEN_PATTERN, gaps=False, minTokenLength=2),
        StopWordsRemover(inputCol="all_words", outputCol=words, stopWords=list(stop_words), caseSensitive=True),
    ]
    if ngram_max > 1:
        stages.append(NGram(n=2, inputCol="words", outputCol="pairs"))
        stages.append(SQLTransformer(statement=f"SELECT *, concat(words, pairs) AS {out} FROM __THIS__"))
    return stages


def fit_vocabulary(df: DataFrame, terms: str, out: str, min_df: int) -> CountVectorizerModel:
    """All terms in at least ``min_df`` rows; their number is checked before they are collected."""
    limit = setting(df.sparkSession, "driverVocabulary", MAX_VOCABULARY_ON_DRIVER)
    per_term = df.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    size = per_term.where(F.col("n") >= min_df).count()
    if size > limit:
        raise LimitExceeded(f"{size} terms are more than {limit}; raise min_df or use naive Bayes")
    return CountVectorizer(inputCol=terms, outputCol=out, minDF=float(min_df), vocabSize=max(size, 1)).fit(df)


def tfidf_stages(train: DataFrame, counts: str, out: str, min_df: int) -> list[Transformer]:
    """Scale term counts by the smoothed idf of ``train`` and normalise.

    Terms with fewer than ``min_df`` training rows get the factor 0, so a vocabulary that is wider
    than the training rows gives the same vectors as their own vocabulary would.
    """
    idf = IDF(inputCol=counts, outputCol="_idf").fit(train.select(counts))
    seen = zip(idf.idf.toArray(), idf.docFreq)
    factor = Vectors.dense([w + 1.0 if d >= max(min_df, 1) else 0.0 for w, d in seen])
    return [
        ElementwiseProduct(scalingVec=factor, inputCol=counts, outputCol="_scaled"),
        Normalizer(p=2.0, inputCol="_scaled", outputCol=out),
    ]


class SmoothedTfidf(Estimator):
    """Text to unit-length TF-IDF vectors; fits to a ``PipelineModel`` of stages that run, save and
    stream inside the JVM."""

    def __init__(self, text="ticket_text", out="features", ngram_max=LR_NGRAM, min_df=LR_MIN_DF, stop_words=STOP_WORDS):
        super().__init__()
        self.text, self.out, self.ngram_max, self.min_df = text, out, ngram_max, min_df
        self.stop_words = tuple(stop_words)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        words = PipelineModel(token_stages(self.text, "terms", self.ngram_max, self.stop_words))
        listed = words.transform(dataset)
        counter = fit_vocabulary(listed, "terms", "term_counts", self.min_df)
        scale = tfidf_stages(counter.transform(listed), "term_counts", self.out, self.min_df)
        return PipelineModel([*words.stages, counter, *scale])


class MacroF1Evaluator(Evaluator):
    """Plain mean of class F1; Spark's own ``f1`` weights classes by size."""

    def __init__(self, labelCol="label", predictionCol="prediction"):
        super().__init__()
        self.label_col, self.prediction_col = labelCol, predictionCol

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(macro_f1(dataset, true=self.label_col, pred=self.prediction_col).first()["macro_f1"])

    def isLargerBetter(self) -> bool:
        return True


def index_labels(df: DataFrame, labels: list[str], label: str = "category") -> DataFrame:
    return df.withColumn("label", (F.array_position(F.lit(labels), F.col(label)) - 1).cast("double"))


def fit_head(train: DataFrame, n_train: int, C: float = LR_C, features: str = "features") -> LogisticRegressionModel:
    """L2 logistic regression with the sum-of-losses weight ``C``; the intercept is not penalised.

    Spark divides the loss by the number of rows, hence ``regParam = 1 / (C n)``.
    """
    # An iteration is a job over all partitions; few rows in many partitions would be all overhead.
    tasks = max(1, -(-n_train // setting(train.sparkSession, "rowsPerFitTask", 20_000)))
    if tasks < train.sparkSession.sparkContext.defaultParallelism:
        train = train.coalesce(tasks)
    return LogisticRegression(
        featuresCol=features,
        labelCol="label",
        maxIter=LR_MAX_ITER,
        tol=LR_TOLERANCE,
        regParam=1.0 / (C * n_train),
        elasticNetParam=0.0,
        standardization=False,
    ).fit(train)


def ranked_by_head(model: Transformer, df: DataFrame, labels: list[str], *keep: str) -> DataFrame:
    scored = model.transform(df)
    return scored.select(*keep, rank_probabilities(labels, vector_to_array("probability")).alias("ranked"))


def in_parallel(spark: SparkSession, jobs: list[Callable], width: int | None = None) -> list:
    """Run driver calls that each start Spark jobs side by side, so small fits share the slots."""
    width = width or setting(spark, "parallelFits", 8)
    with ThreadPool(max(1, min(width, len(jobs)))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs, chunksize=1)


#: Vectors as long as the weights that the optimiser of one fit keeps on the driver, and the part of its heap for them.
FIT_VECTORS, FIT_SHARE = 24, 3


def fits_at_once(spark: SparkSession, weights: int, limit: int | None = None) -> int:
    """How many fits of so many weights (terms x classes) the driver may run side by side; one always."""
    heap = setting(spark, "driverFitBytes", spark._jvm.java.lang.Runtime.getRuntime().maxMemory() // FIT_SHARE)
    limit = limit or setting(spark, "parallelFits", 8)
    return max(1, min(limit, heap // (FIT_VECTORS * 8 * max(1, weights))))


def vector_length(df: DataFrame, column: str) -> int:
    row = df.select(column).first()
    return row[0].size if row else 0


def word_lists(docs: DataFrame, ngram_max: int, stop_words=STOP_WORDS, keep=("doc_id", "category", "fold")) -> DataFrame:
    listed = PipelineModel(token_stages("ticket_text", "terms", ngram_max, stop_words)).transform(docs)
    return materialize(listed.select(*keep, "terms"), "word-lists")


def count_vectors(words: DataFrame, min_df: int) -> DataFrame:
    counted = fit_vocabulary(words, "terms", "term_counts", min_df).transform(words)
    return materialize(counted.drop("terms"), "term-counts")


def term_counts(docs: DataFrame, ngram_max: int, min_df: int, stop_words=STOP_WORDS, keep=("doc_id", "category", "fold")) -> DataFrame:
    """``(*keep, term_counts)``: count vectors over one vocabulary, written once for all folds."""
    return count_vectors(word_lists(docs, ngram_max, stop_words, keep), min_df)


def _fold_vectors(counts: DataFrame, fold: int, min_df: int) -> tuple[DataFrame, DataFrame]:
    train, test = counts.where(F.col("fold") != fold), counts.where(F.col("fold") == fold)
    stages = PipelineModel(tfidf_stages(train, "term_counts", "features", min_df))
    return stages.transform(train).select("label", "features"), stages.transform(test)


def logistic_oof(
    dev: DataFrame, folds: int, C: float = LR_C, ngram_max: int = LR_NGRAM, min_df: int = LR_MIN_DF,
    stop_words=STOP_WORDS,
) -> DataFrame:
    """Out-of-fold ranked probabilities for ``(doc_id, ticket_text, category, fold)``."""
    labels = label_list(dev, least=2)
    counts = index_labels(term_counts(dev, ngram_max, min_df, stop_words), labels)
    return _oof(counts, labels, folds, C, lambda fold: _fold_vectors(counts, fold, min_df))


def head_oof(dev: DataFrame, folds: int, C: float, features: str = "features") -> DataFrame:
    """The same for rows that already carry a vector column."""
    labels = label_list(dev, least=2)
    rows = index_labels(dev, labels).withColumnRenamed(features, "features")

    def vectors(fold: int):
        return rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)

    return _oof(rows, labels, folds, C, vectors)


def _fold_sizes(rows: DataFrame) -> dict[int, int]:
    return {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}


def _oof(rows: DataFrame, labels: list[str], folds: int, C: float, vectors: Callable) -> DataFrame:
    sizes = _fold_sizes(rows)
    out = new_path(rows.sparkSession, "logistic-oof")

    def one(fold: int):
        train, test = vectors(fold)
        model = fit_head(train, sum(sizes.values()) - sizes.get(fold, 0), C)
        ranked = ranked_by_head(model, test, labels, "doc_id", "category", "fold")
        ranked.write.mode("overwrite").parquet(f"{out}/part_{fold}")

    column = "term_counts" if "term_counts" in rows.columns else "features"
    width = fits_at_once(rows.sparkSession, vector_length(rows, column) * len(labels))
    in_parallel(rows.sparkSession, [lambda f=f: one(f) for f in range(folds)], width)
    return rows.sparkSession.read.parquet(*[f"{out}/part_{f}" for f in range(folds)])


def logistic_grid(
    dev: DataFrame, folds: int, ngrams: Iterable[int], min_dfs: Iterable[int], Cs: Iterable[float],
    stop_words=STOP_WORDS,
) -> DataFrame:
    """``(C, min_df, ngram_max, fold, macro_f1)`` of all settings.

    Word counts are made once per n-gram range and ``min_df``, so that no fit carries weights of terms that its
    setting never uses; vectors once per (range, min_df, fold), which the values of C share. What a fit leaves
    behind is its confusion counts.
    """
    spark = dev.sparkSession
    labels = label_list(dev, least=2)
    out = new_path(spark, "logistic-grid")
    min_dfs, Cs, paths = list(min_dfs), list(Cs), []
    sizes = _fold_sizes(dev)

    def one(counts: DataFrame, ngram: int, min_df: int, fold: int, path: str):
        train, test = _fold_vectors(counts, fold, min_df)
        train, test = train.persist(), test.persist()
        n = sum(sizes.values()) - sizes.get(fold, 0)
        for i, C in enumerate(Cs):
            preds = fit_head(train, n, C).transform(test)
            name = F.get(F.lit(labels), F.col("prediction").cast("int"))
            pairs = confusion_long(preds.withColumn("predicted_label", name))
            pairs.select(
                F.lit(float(C)).alias("C"), F.lit(min_df).alias("min_df"), F.lit(ngram).alias("ngram_max"),
                F.lit(fold).alias("fold"), "*",
            ).coalesce(1).write.mode("overwrite").parquet(f"{path}/c_{i}")
        train.unpersist()
        test.unpersist()

    for ngram in ngrams:
        words = word_lists(dev, ngram, stop_words)
        for min_df in min_dfs:
            counts = index_labels(count_vectors(words, min_df), labels)
            jobs = []
            for fold in range(folds):
                path = f"{out}/n{ngram}_m{min_df}_f{fold}"
                paths += [f"{path}/c_{i}" for i in range(len(Cs))]
                jobs.append(lambda a=(counts, ngram, min_df, fold, path): one(*a))
            in_parallel(spark, jobs, fits_at_once(spark, vector_length(counts, "term_counts") * len(labels)))
    by = ["C", "min_df", "ngram_max", "fold"]
    pairs = spark.read.parquet(*paths)
    return class_scores(pairs, *by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def fit_logistic(
    train: DataFrame, C: float = LR_C, ngram_max: int = LR_NGRAM, min_df: int = LR_MIN_DF, stop_words=STOP_WORDS
) -> PipelineModel:
    """Text to probabilities as one stored pipeline; its first stage holds the class list."""
    labels = label_list(train, least=2)
    indexer = StringIndexerModel.from_labels(labels, inputCol="category", outputCol="label")
    tfidf = SmoothedTfidf(ngram_max=ngram_max, min_df=min_df, stop_words=stop_words).fit(train)
    vectors = tfidf.transform(indexer.transform(train)).select("label", "features").persist()
    head = fit_head(vectors, vectors.count(), C)
    vectors.unpersist()
    return PipelineModel([indexer, *tfidf.stages, head])


def score_logistic(model: PipelineModel, df: DataFrame, *keep: str) -> DataFrame:
    """Ranked probabilities for rows with ``ticket_text``; works on a stream as well."""
    labels = model.stages[0].labels
    # A rejected request has no text; the tokenizer needs one.
    ready = df.withColumn("ticket_text", F.coalesce("ticket_text", F.lit("")))
    return ranked_by_head(PipelineModel(model.stages[1:]), ready, labels, *keep)


def logistic_scorer(model: PipelineModel) -> Callable[[DataFrame], DataFrame]:
    return lambda df, *keep: score_logistic(model, df, "doc_id", "reject_reason", *keep)


def save_pipeline(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(spark: SparkSession, path: str) -> PipelineModel:
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/metadata")
    except AnalysisException as exc:
        raise ModelNotFound(path) from exc
    return PipelineModel.load(path)
