"""Multinomial naive Bayes on TF-IDF weights, as joins and sums.

With ``S`` the summed weights of a term in a class, ``D`` the class total, ``V`` the vocabulary size
and ``a`` the smoothing, a document with weights ``w`` scores

    ln prior + sum(w) * (ln a - ln(D + a V)) + sum over terms with S > 0 of w * ln(1 + S / a)

so classes without a hit still get their score. The table has one row per term with its classes side
by side, a block of them if they are many (and only blocks that occur); a document's sums over them are
columns of one aggregation, partly added up before its single shuffle.
Several settings (``specs``) and several parts (see ``vectorize``) share every pass over the data:
one to count documents per term, one for vector lengths, one for ``S``, one to score.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagekit.constants import NB_ALPHA, NB_MIN_DF, NB_NGRAM
from triagekit.errors import LimitExceeded, ModelNotFound
from triagekit.operators.lookup import TermTable, join_terms
from triagekit.operators.profile import label_list
from triagekit.operators.ranking import let, rank_classes
from triagekit.operators.vectorize import (
    DocFrequency, Facts, TermRule, doc_frequency, doc_norms, slots, term_facts, term_rows, train_df, train_idf,
    with_norms, write_terms,
)
from triagekit.sources.store import materialize

MAX_HEADER_VALUES = 4_000_000
#: Sums (classes x settings or parts) that one aggregation takes side by side.
SUMS_AT_ONCE = 400


@dataclass(frozen=True)
class BayesSpec:
    ngram_max: int = NB_NGRAM
    min_df: int = NB_MIN_DF
    alpha: float = NB_ALPHA

    @property
    def rule(self) -> TermRule:
        return TermRule(self.ngram_max, self.min_df)


@dataclass(frozen=True)
class BayesHeader:
    """The small part of a model: everything per class, nothing per term."""

    labels: list[str]
    specs: list[BayesSpec]
    n_train: list[int]
    log_prior: list[list[float | None]]  # [part][class]; null where the part has no such class
    class_sum: list[list[float]]  # [part * rules + rule][class]
    vocabulary: list[int]  # [part * rules + rule]
    width: int  # classes of a block

    @property
    def blocks(self) -> int:
        return -(-len(self.labels) // self.width)

    @property
    def rules(self) -> list[TermRule]:
        return list(dict.fromkeys(s.rule for s in self.specs))


@dataclass(frozen=True)
class BayesModel:
    """``terms``: one row per term and block of classes that occur together.

    ``s_i`` holds the summed weights of the block's classes in slot ``i`` (zero where the slot does not know
    the term); ``total`` and ``own_p`` count documents of the term, and ``lead`` marks one row per term, on
    which sums that all classes share are taken.
    """

    terms: TermTable
    header: BayesHeader


def fit_bayes(
    features: DataFrame, specs: list[BayesSpec] | None = None, parts: int = 1, facts: Facts | None = None
) -> BayesModel:
    """Fit on ``(doc_id, category, part, terms)``, once per part; ids are unique. ``facts``: their ``term_facts``,
    where the caller has them."""
    specs = specs or [BayesSpec()]
    rules = list(dict.fromkeys(s.rule for s in specs))
    labels = label_list(features.where(F.col("part") < 0) if parts == 1 else features, least=2)
    if len(labels) * parts * len(specs) > MAX_HEADER_VALUES:
        raise LimitExceeded("classes x parts x settings is too large for one model")

    facts = facts or term_facts(features, parts)
    freq = doc_frequency(features, parts, facts)
    norms = doc_norms(features, freq, rules, facts=facts)
    # Several vectorisers fill a term's row already; with all classes beside them, rare terms would carry mostly zeros.
    width = max(1, min(len(labels), SUMS_AT_ONCE // max(len(specs), parts))) if len(rules) == 1 else 1
    terms = write_terms(_class_sums(features, norms, labels, freq, rules, width, facts), "bayes-terms", facts)
    header = _header(features, terms, labels, specs, freq, rules, width)
    buckets = facts.buckets if facts else 0
    return BayesModel(TermTable.measure(terms, 16 + 8 * parts * (1 + width * len(rules)), buckets), header)


def _class_sums(
    features: DataFrame, norms: DataFrame, labels: list[str], freq: DocFrequency, rules: list[TermRule], width: int,
    facts: Facts | None,
) -> DataFrame:
    """Sum ``tf / length`` per term and class, then bring in the factor that all rows of a term
    share, its idf. Document counts come along in the same pass: classes of a block are columns."""
    parts, pairs = freq.parts, slots(freq.parts, rules)
    class_idx = F.coalesce(F.array_position(F.lit(labels), F.col("category")) - 1, F.lit(-1)).cast("int")
    names = [f"norm_{i}" for i in range(len(pairs))]
    block = F.floor(F.greatest("class_idx", F.lit(0)) / width).cast("int")
    met = None
    if facts:  # then a term's rows are in one bucket, and nothing moves
        norms = materialize(norms, "norms")
        met = with_norms(facts, norms)
    if met is None:
        met = term_rows(features.join(norms, "doc_id"), "category", "part", *names)
        met = met.repartition(facts.buckets, "term") if facts else met
    met = met.withColumn("class_idx", class_idx).withColumn("block", block)
    sums = []
    for i, (p, _) in enumerate(pairs):
        share = F.col("tf") / F.nullif(F.col(names[i]), F.lit(0.0))
        for c in range(width):
            of_class = (F.col("part") != p) & (F.col("class_idx") % width == c)
            sums.append(F.sum(F.when(of_class, share)).alias(f"s_{i}_{c}"))
    counted = ["total", *[f"own_{p}" for p in range(parts)]]
    counts = [F.count("*").alias("total"), *[F.count_if(F.col("part") == p).alias(f"own_{p}") for p in range(parts)]]
    rows = met.groupBy("term", "block").agg(*counts, *sums)
    lead = F.lit(True)
    if width < len(labels):  # at most one row per block for any term, so the window holds a bounded number of rows
        of_term = Window.partitionBy("term")
        lead = F.min("block").over(of_term) == F.col("block")
        rows = rows.select("*", lead.alias("lead"), *[F.sum(c).over(of_term).alias(f"all_{c}") for c in counted])
        rows = rows.drop(*counted).withColumnsRenamed({f"all_{c}": c for c in counted})
        lead = F.col("lead")

    def scaled(i: int, p: int, rule: TermRule) -> Column:
        idf = F.when(rule.allows(train_df(p)), train_idf(p, freq.n_train))
        return F.array(*[F.coalesce(F.col(f"s_{i}_{c}") * idf, F.lit(0.0)) for c in range(width)]).alias(f"s_{i}")

    return rows.select("term", "block", lead.alias("lead"), *counted, *[scaled(i, *pair) for i, pair in enumerate(pairs)])


def _header(features, terms: DataFrame, labels, specs, freq: DocFrequency, rules, width: int) -> BayesHeader:
    parts, n, pairs = freq.parts, len(labels), slots(freq.parts, rules)
    rows = features.groupBy("part", "category").agg(F.count("*").alias("n")).collect()  # parts x classes
    log_prior = []
    for p in range(parts):
        count = {label: 0 for label in labels}
        for r in rows:
            if r["part"] != p:
                count[r["category"]] += r["n"]
        total = sum(count.values())
        log_prior.append([math.log(count[label] / total) if count[label] else None for label in labels])

    known = [
        F.count_if(F.col("lead") & rule.allows(train_df(p))).alias(f"v{i}") for i, (p, rule) in enumerate(pairs)
    ]
    places = [(i, c) for i in range(len(pairs)) for c in range(width)]
    sums = [F.sum(F.get(f"s_{i}", F.lit(c))).alias(f"d{i}_{c}") for i, c in places]
    vocabulary = [0] * len(pairs)
    class_sum = [[0.0] * n for _ in pairs]
    for r in terms.groupBy("block").agg(*known, *sums).collect():  # one row per block of classes
        for i in range(len(pairs)):
            vocabulary[i] += int(r[f"v{i}"])
        for i, c in places:
            if r["block"] * width + c < n:
                class_sum[i][r["block"] * width + c] = r[f"d{i}_{c}"]
    return BayesHeader(labels, specs, freq.n_train, log_prior, class_sum, vocabulary, width)


def score_bayes(model: BayesModel, features: DataFrame, *keep: str, facts: Facts | None = None) -> DataFrame:
    """Class probabilities of ``(doc_id, part, terms)`` by the model of each row's own part; ids are unique.
    ``facts``: ``term_facts`` that hold all rows of ``features``, where the caller has them.

    Returns ``doc_id, part, *keep, spec, ranked``: classes in order of falling probability as
    ``array<struct<category, probability>>``. Texts without a known term get the priors.
    """
    h = model.header
    rules, parts = h.rules, len(h.n_train)
    keys = ["doc_id", "part", *keep]
    # Everything that depends on the term alone is computed on the table's side of the join.
    idf = [
        F.array(*[F.when(rule.allows(train_df(p)), train_idf(p, h.n_train)) for p in range(parts)]).alias(f"idf_{j}")
        for j, rule in enumerate(rules)
    ]
    sums = [
        F.array(*[F.col(f"s_{p * len(rules) + j}") for p in range(parts)]).alias(f"sum_{j}") for j in range(len(rules))
    ]
    columns, by = ["block", "lead", *idf, *sums], keys
    if model.terms.buckets:  # rows of terms carry a number only; everything else waits beside it
        by = ["doc_id", "part"]
        rows = facts.df.select(*by, "term", "tf") if facts else term_rows(features, *by)
        met = join_terms(rows, model.terms, columns, "doc_id", "inner")
    else:
        met = join_terms(term_rows(features, *keys, outer=True), model.terms, columns, "doc_id")
    part = F.col("part")
    met = met.select(
        *by,
        "block",
        "lead",
        *[(F.col("tf") * F.get(f"idf_{j}", part)).alias(f"u_{j}") for j in range(len(rules))],
        *[F.get(f"sum_{j}", part).alias(f"s_{j}") for j in range(len(rules))],
    )
    aggs = []
    for j in range(len(rules)):
        u = F.when(F.col("lead"), F.col(f"u_{j}"))
        aggs += [F.sum(u).alias(f"w_{j}"), F.sum(u * u).alias(f"q_{j}")]
    of_rule = [rules.index(s.rule) for s in h.specs]
    hits = []
    for spec, j in zip(h.specs, of_rule):
        for c in range(h.width):
            hits.append(f"r_{len(hits)}")
            aggs.append(F.sum(F.col(f"u_{j}") * F.log1p(F.get(f"s_{j}", F.lit(c)) / spec.alpha)).alias(hits[-1]))
    if h.blocks == 1:
        docs = met.groupBy(*by).agg(*aggs).withColumn("hits", F.create_map(F.lit(0), F.array(*hits)))
    else:  # then the blocks of a document (at most all of them) side by side, and shared sums added up
        of_block = F.when(F.col("block").isNotNull(), F.struct("block", F.array(*hits).alias("r")))
        shared = [F.sum(f"{x}_{j}").alias(f"{x}_{j}") for j in range(len(rules)) for x in "wq"]
        docs = met.groupBy(*by, "block").agg(*aggs).groupBy(*by).agg(
            F.map_from_entries(F.collect_list(of_block)).alias("hits"), *shared
        )
    if by != keys:  # texts without a known term come in here
        docs = features.select(*keys).join(docs.drop("part"), "doc_id", "left")
    scores = F.array(
        *[
            F.struct(F.lit(i).alias("spec"), _scores(h, i, j, part).alias("scores"))
            for i, j in enumerate(of_rule)
        ]
    )
    scored = docs.select(*keys, F.explode(scores).alias("x")).select(*keys, "x.spec", "x.scores")
    return rank_classes(scored, "scores")


def _scores(h: BayesHeader, i: int, j: int, part: Column) -> Column:
    """``array<struct<category, score>>`` of setting ``i``, which uses rule ``j``."""
    alpha, parts, n_rules = h.specs[i].alpha, len(h.n_train), len(h.rules)
    slope = []
    for p in range(parts):
        slot = p * n_rules + j
        v = max(h.vocabulary[slot], 1)
        slope.append([math.log(alpha) - math.log(d + alpha * v) for d in h.class_sum[slot]])
    priors = F.array(*[F.array(*[F.lit(x).cast("double") for x in row]) for row in h.log_prior])
    length = F.sqrt(F.nullif(F.col(f"q_{j}"), F.lit(0.0)))
    total = F.coalesce(F.col(f"w_{j}") / length, F.lit(0.0))
    constants = F.struct(
        F.get(priors, part).alias("prior"), F.get(F.lit(slope), part).alias("slope"), total.alias("total"),
        length.alias("length"),
    )
    return let(
        constants,
        lambda k: F.transform(
            F.lit(list(range(len(h.labels)))),
            lambda c: F.struct(
                F.get(F.lit(h.labels), c).alias("category"),
                (
                    F.get(k["prior"], c)
                    + k["total"] * F.get(k["slope"], c)
                    + F.coalesce(F.get(F.col("hits")[F.floor(c / h.width).cast("int")], i * h.width + c % h.width) / k["length"], F.lit(0.0))
                ).alias("score"),
            ),
        ),
    )


def log_likelihoods(model: BayesModel, part: int = 0, spec: int = 0) -> DataFrame:
    """The fitted table in its usual form: ``(term, category, weight_sum, log_likelihood)``.

    One row per class-term pair that occurs; a pair that does not occur has weight sum 0.
    """
    h = model.header
    s = h.specs[spec]
    slot = part * len(h.rules) + h.rules.index(s.rule)
    denominators = [math.log(d + s.alpha * h.vocabulary[slot]) for d in h.class_sum[slot]]
    each = model.terms.df.select("term", "block", F.posexplode(f"s_{slot}").alias("at", "value")).where("value > 0")
    class_idx = F.col("block") * h.width + F.col("at")
    return each.select(
        "term",
        F.get(F.lit(h.labels), class_idx).alias("category"),
        F.col("value").alias("weight_sum"),
        (F.ln(F.col("value") + s.alpha) - F.get(F.lit(denominators), class_idx)).alias("log_likelihood"),
    )


def save_bayes(model: BayesModel, path: str) -> None:
    """Store a fitted model as two tables; ``load_bayes`` gives the same scores."""
    spark = model.terms.df.sparkSession
    model.terms.df.write.mode("overwrite").parquet(f"{path}/terms")
    body = asdict(model.header) | {"rows": model.terms.rows, "bytes": model.terms.bytes, "rows_behind": model.terms.rows_behind}
    spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def load_bayes(spark: SparkSession, path: str) -> BayesModel:
    try:
        body = json.loads(spark.read.text(f"{path}/header", wholetext=True).first()[0])
        terms = spark.read.parquet(f"{path}/terms")
    except AnalysisException as exc:
        raise ModelNotFound(path) from exc
    table = TermTable(terms, body.pop("rows"), body.pop("bytes"), body.pop("rows_behind"))
    body["specs"] = [BayesSpec(**s) for s in body["specs"]]
    return BayesModel(table, BayesHeader(**body))
