"""Logistic regression whose vocabulary and weights never leave Spark.

Weights are arrays over (fit, class) per term; a fit is a part (see ``vectorize``) with a setting, and all fits share
every pass. Documents lie in blocks and terms in buckets, both of bounded size and written once: a block as a sparse
matrix over the terms that it has, a bucket with the places of the terms that each block needs of it. A pass sends
each block its weights, one array per (bucket, block); the block turns scores into residuals and sends back slopes of
the same form; the bucket adds them up. So what moves is one weight per fit, class and distinct term of a block, in
two shuffles, and no row is looked up by name. The optimiser is L-BFGS: past steps and slopes are arrays in the
bucket's row, and the two-loop recursion runs on their dot products, which one aggregation yields for all fits (Chen,
Wang and Zhou, "Large-scale L-BFGS using MapReduce", 2014). Only those products, the losses and the intercepts reach
the driver: their number depends on classes and fits, not on terms. The optimiser sees weights in units of one over
the root of their curvature at the start, so that frequent and rare terms converge alike. Each pass is written to the
shared folder; a lost executor costs the tasks it ran.

The objective of a fit is ``mean(loss) + |w|^2 / (2 C n)``; intercepts are not penalised. It is strictly convex in
the weights, so a vanishing slope is proof of the optimum; ``slopes`` computes it from the returned tables alone.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagekit.constants import LR_C, LR_MAX_ITER, LR_MIN_DF, LR_NGRAM
from triagekit.errors import ModelNotFound
from triagekit.operators.lookup import TermTable, join_terms
from triagekit.operators.profile import label_list
from triagekit.operators.ranking import rank_classes
from triagekit.operators.vectorize import DocFrequency, TermRule, doc_frequency, doc_norms, slots, term_rows, train_df, train_idf
from triagekit.session import setting
from triagekit.sources.store import materialize, materialize_buckets, overwrite_buckets

#: Steps that the optimiser remembers, and where its arrays lie: weights, slope, the same at the trial point.
HISTORY = 8
W, G, TRIAL_W, TRIAL_G = 0, 1, 2, 3
SLOPE_TOLERANCE = 1e-5
LEAST_GAIN = 1e-4
#: Values (weights of all fits and classes) of a bucket of terms, and of a block of documents if no term came twice.
BUCKET_VALUES, BLOCK_VALUES = 250_000, 16_000_000
#: The bucket that losses and slopes of the intercepts go to.
NO_TERMS = -1
VALUES_AT_ONCE = 4_000_000
#: Up to so many sums a group has a column for each.
SUM_COLUMNS = 64


@dataclass(frozen=True)
class SoftmaxSpec:
    """``raw``: features are used as they are, without idf and length."""

    ngram_max: int = LR_NGRAM
    min_df: int = LR_MIN_DF
    C: float = LR_C
    raw: bool = False

    @property
    def rule(self) -> TermRule:
        return TermRule(self.ngram_max, self.min_df)


@dataclass(frozen=True)
class Fits:
    """What each fit trains on: fit number = part * settings + setting."""

    labels: list[str]
    specs: list[SoftmaxSpec]
    n_train: list[int]

    @property
    def rules(self) -> list[TermRule]:
        return list(dict.fromkeys(s.rule for s in self.specs))

    @property
    def parts(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_train)), len(self.specs))

    @property
    def slots(self) -> np.ndarray:
        """The (part, rule) slot of each fit."""
        rules = self.rules
        return np.array([p * len(rules) + rules.index(s.rule) for p in range(len(self.n_train)) for s in self.specs])

    @property
    def rows(self) -> np.ndarray:
        return np.maximum(np.array(self.n_train, float)[self.parts], 1.0)

    @property
    def penalty(self) -> np.ndarray:
        return 1.0 / (np.tile([s.C for s in self.specs], len(self.n_train)) * self.rows)

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.n_train) * len(self.specs), len(self.labels)


@dataclass(frozen=True)
class SoftmaxModel:
    """``weights``: ``term, total, idf, w``, with documents of the term, its idf by slot, and weights with the idf in
    them, one list over (fit, class); ``plain``: ``term, w, factor``, weights without the idf, and that. ``plain`` and
    ``freq`` serve the proof only, and a loaded model has neither."""

    weights: DataFrame
    plain: DataFrame | None
    bias: np.ndarray
    fits: Fits
    freq: DocFrequency | None
    max_slope: list[float]
    passes: int


def vector_terms(embedding: str = "embedding") -> Column:
    """A dense vector as terms: place and value, for settings with ``raw``."""
    return F.transform(F.col(embedding), lambda x, i: F.struct(i.cast("string").alias("term"), x.cast("double").alias("tf")))


def _used_terms(features: DataFrame, specs: list[SoftmaxSpec]) -> DataFrame:
    """Without the pairs of words, where no setting has any."""
    if max(s.ngram_max for s in specs) > 1:
        return features
    return features.withColumn("terms", F.filter("terms", lambda t: F.instr(t["term"], " ") == 0))


def _documents(features: DataFrame, fits: Fits, freq: DocFrequency, *keep: str, row: bool = False) -> DataFrame:
    """Rows with class number, vector lengths by slot, and terms, on request numbered; written once."""
    number = [F.monotonically_increasing_id().alias("row")] if row else []
    features = _used_terms(features, fits.specs)
    y = (F.coalesce(F.array_position(F.lit(fits.labels), F.col("category")), F.lit(0)) - 1).cast("int").alias("y")
    if fits.specs[0].raw:
        n = len(freq.n_train) * len(fits.rules)
        return materialize(features.select("doc_id", "part", *keep, y, F.array_repeat(F.lit(1.0), n).alias("norms"), "terms", *number), "softmax-rows")
    norms = doc_norms(features, freq, fits.rules, own_part=True)
    n = len(norms.columns) - 1
    lengths = F.array(*[F.coalesce(F.col(f"norm_{i}"), F.lit(0.0)) for i in range(n)]).alias("norms")
    return materialize(features.join(norms, "doc_id", "left").select("doc_id", "part", *keep, y, lengths, "terms", *number), "softmax-rows")


def _vocabulary(freq: DocFrequency, fits: Fits, buckets: int) -> TermTable:
    """``term, total, idf, bucket, place``: one factor per slot, zero where the slot does not use the term."""
    raw = fits.specs[0].raw
    pairs = slots(freq.parts, fits.rules)
    factor = [F.when(rule.allows(train_df(p)), F.lit(1.0) if raw else train_idf(p, freq.n_train)) for p, rule in pairs]
    terms = freq.table.df.select("term", "total", F.array(*[F.coalesce(f, F.lit(0.0)) for f in factor]).alias("idf"))
    terms = terms.where(F.exists("idf", lambda x: x > 0)).withColumn("bucket", F.pmod(F.xxhash64("term"), buckets).cast("int"))
    # A bucket is a bounded number of terms.
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("term")) - 1
    return TermTable.measure(materialize(terms.withColumn("place", place), "softmax-terms"), 8 + 8 * len(pairs))


class _Optimiser:
    """What is done with the arrays ``[array, term, fit, class]`` of a bucket; runs in tasks and on the driver alike.

    ``now``: weights, slope, and both at the trial point; ``past``: remembered steps, then changes of the slope, in
    single precision, as they only shape the next step. All are in units of ``scale`` (by term and fit).
    """

    def __init__(self, fits: Fits, accept: np.ndarray, mix: np.ndarray, step: np.ndarray):
        self.shape, self.slots, self.rows, self.penalty = fits.shape, fits.slots, fits.rows, fits.penalty
        self.accept, self.mix, self.step = accept, mix, step

    def arrays(self, now: bytes | None, past: bytes | None, terms: int) -> tuple[np.ndarray, np.ndarray]:
        """Arrays of a row; nothing stands for zeros."""
        shape = (terms, *self.shape)
        return (
            np.frombuffer(now).reshape(4, *shape) if now else np.zeros((4, *shape)),
            np.frombuffer(past, np.float32).reshape(2, HISTORY, *shape) if past else np.zeros((2, HISTORY, *shape), np.float32),
        )

    def advance(self, now: np.ndarray, past: np.ndarray, accept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Move to the trial point where it is accepted, and remember the step."""
        new = (now[TRIAL_W:] - now[:TRIAL_W]).astype(np.float32)[:, None]
        past = np.where(accept[:, None], np.concatenate([past[:, 1:], new], 1), past)
        return np.concatenate([np.where(accept[:, None], now[TRIAL_W:], now[:TRIAL_W]), now[TRIAL_W:]]), past

    def next_trial(self, now: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        now, past = self.advance(now, past, self.accept)
        for f in np.flatnonzero(self.step):
            mixed = np.tensordot(self.mix[f, :-1], past[:, :, :, f].reshape(2 * HISTORY, -1), 1)
            way = mixed.reshape(now.shape[1], -1) + self.mix[f, -1] * now[G, :, f]
            now[TRIAL_W, :, f] = now[W, :, f] + self.step[f] * way
        still = self.step == 0
        now[TRIAL_W][:, still] = now[W][:, still]
        return now, past

    def products(self, now: np.ndarray, past: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By fit, as if every trial were accepted: products of steps, changes of the slope and slope; the weights'
        square and the largest slope, these in plain units."""
        now, past = self.advance(now, past, np.ones(self.shape[0], bool))
        gram = []
        for f in range(self.shape[0]):
            b = np.concatenate([past[:, :, :, f].reshape(2 * HISTORY, -1), now[G, :, f].reshape(1, -1)]).astype(float)
            gram.append(b @ b.T)
        scale = scale[:, :, None]
        return np.stack(gram), ((now[W] * scale) ** 2).sum((0, 2)), np.abs(now[G] / scale).max(0, initial=0.0).max(1)

    def unit(self, curvature: np.ndarray) -> np.ndarray:
        """The scale of weights whose squared inputs add up to ``curvature``, while all classes are equally likely."""
        classes = self.shape[1]
        return 1.0 / np.sqrt(curvature * (classes - 1) / classes**2 + self.penalty)

    def scale(self, scale: bytes | None, terms: int) -> np.ndarray:
        return np.frombuffer(scale).reshape(terms, -1) if scale else np.ones((terms, self.shape[0]))

    def factors(self, idf: bytes, terms: int) -> np.ndarray:
        """The idf of each term and fit."""
        return np.frombuffer(idf).reshape(terms, -1)[:, self.slots]


def _lists(values: np.ndarray) -> pa.Array:
    flat = values.reshape(len(values), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


def _scores(docs: DataFrame, weights: DataFrame, width: int) -> DataFrame:
    """``docs`` with ``z``: per (fit, class) the sum of term count times weight; null without a known term."""
    facts = docs.select("doc_id", F.explode_outer("terms").alias("t")).select("doc_id", "t.term", "t.tf").where("term IS NOT NULL")
    met = facts.join(weights, "term").select("doc_id", F.transform("w", lambda x: x * F.col("tf")).alias("x"))
    return docs.join(_summed(met, ["doc_id"], "x", width).withColumnRenamed("x", "z"), "doc_id", "left")


def _summed(rows: DataFrame, keys: list[str], column: str, width: int) -> DataFrame:
    """Sums of arrays of one length, place by place; null places count as zero."""
    if width > SUM_COLUMNS:
        total = rows.groupBy(*keys).agg(Summarizer.sum(array_to_vector(column)).alias(column))
        return total.select(*keys, vector_to_array(column).alias(column))
    sums = [F.coalesce(F.sum(F.get(column, F.lit(i))), F.lit(0.0)) for i in range(width)]
    return rows.groupBy(*keys).agg(*[x.alias(f"sum_{i}") for i, x in enumerate(sums)]).select(
        *keys, F.array(*[f"sum_{i}" for i in range(width)]).alias(column)
    )


def _softmax(z: np.ndarray, norms: np.ndarray, fits: Fits, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities ``[row, fit, class]`` of sums over terms, and one over the vector length by fit."""
    norms = norms[:, fits.slots]
    shrink = np.divide(1.0, norms, out=np.zeros_like(norms), where=norms > 0)
    z = z.reshape(len(z), *bias.shape) * shrink[:, :, None] + bias
    z -= z.max(2, keepdims=True)
    p = np.exp(z)
    return p / p.sum(2, keepdims=True), shrink


#: A block's arrays: class, part, vector lengths; its facts by row and by term; places of its terms in their buckets.
BLOCK = "block int, y binary, part binary, norms binary, row binary, at binary, tf binary, by_term binary, bucket binary, sizes binary, places binary"
NEEDS = "bucket int, block int, places binary"
CHUNK = "block int, bucket int, x binary"
STATE = "bucket int, terms int, idf binary, blocks binary, sizes binary, places binary, scale binary, now binary, past binary, gram array<double>, slope array<double>, extra binary"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    types = {"int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}
    names = [c.split(" ") for c in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.table([pa.array(list(c), types[t]) for (_, t), c in zip(names, columns)], names=[n for n, _ in names])


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False)


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _bytes(column: pa.ChunkedArray, i: int = 0) -> memoryview:
    return memoryview(column[i].as_buffer())


def _blocks(docs: DataFrame, vocabulary: TermTable, blocks: int) -> DataFrame:
    """Documents as sparse matrices, a bounded number of facts each: one row per block, in buckets of blocks."""
    spot = F.pmod(F.xxhash64("row"), blocks).cast("int").alias("block")
    listed = docs.select("row", spot, F.explode_outer("terms").alias("t")).select("row", "block", "t.term", F.col("t.tf").cast("double").alias("tf"))
    facts = join_terms(listed.where("term IS NOT NULL AND tf IS NOT NULL"), vocabulary, ["bucket", "place"], "row", "inner")
    heads = docs.select(spot, F.col("row").alias("row"), "y", F.col("part").cast("int").alias("part"), "norms")

    def build(heads: pa.Table, facts: pa.Table) -> pa.Table:
        if not len(heads):
            return _table(BLOCK, [])
        rows = _numbers(heads.column("row"))
        order = np.argsort(rows)
        y, part = (_numbers(heads.column(c))[order].astype(np.int32) for c in ("y", "part"))
        norms = _flat(heads.column("norms")).reshape(len(rows), -1)[order]
        row = np.searchsorted(rows[order], _numbers(facts.column("row"))).astype(np.int32)
        name = _numbers(facts.column("bucket")).astype(np.int64) << 32 | _numbers(facts.column("place"))
        names, at = np.unique(name, return_inverse=True)
        by_row = np.lexsort((at, row))
        row, at, tf = row[by_row], at[by_row].astype(np.int32), _numbers(facts.column("tf"))[by_row]
        bucket, sizes = np.unique((names >> 32).astype(np.int32), return_counts=True)
        arrays = [y, part, norms, row, at, tf, np.argsort(at, kind="stable").astype(np.int32), bucket, sizes.astype(np.int32), (names & 0xFFFFFFFF).astype(np.int32)]
        return _table(BLOCK, [(heads.column("block")[0].as_py(), *[x.tobytes() for x in arrays])])

    built = heads.groupBy("block").cogroup(facts.select("block", "row", "bucket", "place", "tf").groupBy("block")).applyInArrow(build, BLOCK)
    return materialize_buckets(built, "softmax-blocks", "block", blocks)


def _first_state(vocabulary: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row per bucket: the idf of its terms by place, and which of them each block needs."""

    def needs(batches):
        for batch in batches:
            for i in range(len(batch)):
                number, bucket, sizes = batch.column("block")[i].as_py(), *(np.frombuffer(batch.column(c)[i].as_buffer(), np.int32) for c in ("bucket", "sizes"))
                places = np.split(np.frombuffer(batch.column("places")[i].as_buffer(), np.int32), np.cumsum(sizes)[:-1])
                yield from _table(NEEDS, [(int(b), number, p.tobytes()) for b, p in zip(bucket, places)]).to_batches()

    def gather(terms: pa.Table, needed: pa.Table) -> pa.Table:
        if not len(terms):
            return _table(STATE, [])
        order = np.argsort(_numbers(terms.column("place")))
        idf = _flat(terms.column("idf")).reshape(len(terms), -1)[order]
        numbers = _numbers(needed.column("block")).astype(np.int32)
        places = [_bytes(needed.column("places"), i) for i in range(len(needed))]
        sizes = np.array([len(p) // 4 for p in places], np.int32)
        given = (terms.column("bucket")[0].as_py(), len(terms), idf.tobytes(), numbers.tobytes(), sizes.tobytes(), b"".join(places))
        return _table(STATE, [(*given, b"", b"", b"", None, None, None)])

    need = blocks.select("block", "bucket", "sizes", "places").mapInArrow(needs, NEEDS)
    return vocabulary.select("bucket", "place", "idf").groupBy("bucket").cogroup(need.groupBy("bucket")).applyInArrow(gather, STATE)


def _weights_for_blocks(state: DataFrame, opt: _Optimiser) -> DataFrame:
    """Weights at the trial point times the idf, one array for each block that needs terms of a bucket."""
    width = opt.shape[0] * opt.shape[1]
    names = ["bucket", "terms", "idf", "blocks", "sizes", "places", "scale", "now", "past"]

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                terms = batch.column("terms")[i].as_py()
                idf, blocks, sizes, places, scale, now, past = (batch.column(c)[i].as_buffer() for c in names[2:])
                now = opt.next_trial(*opt.arrays(now, past, terms))[0]
                w = (now[TRIAL_W] * (opt.factors(idf, terms) * opt.scale(scale, terms))[:, :, None]).reshape(terms, width)
                low = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int32))])
                places, bucket = np.frombuffer(places, np.int32), batch.column("bucket")[i].as_py()
                for j, block in enumerate(np.frombuffer(blocks, np.int32)):
                    yield from _table(CHUNK, [(int(block), bucket, w[places[low[j] : low[j + 1]]].tobytes())]).to_batches()

    terms = state.where(F.col("bucket") != NO_TERMS)
    return terms.select(*names).mapInArrow(run, CHUNK)


def _added(values: np.ndarray, take: np.ndarray, tf: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """``[n, width]``: values of ``take`` times ``tf``, added up by the ascending ``to``; in stretches of bounded size."""
    out = np.zeros((n, values.shape[1]))
    if len(to) == n * len(values):  # every row has every term
        return tf.reshape(n, -1) @ values if len(to) else out
    step = max(1, VALUES_AT_ONCE // values.shape[1])
    for low in range(0, len(to), step):
        part = to[low : low + step]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        out[part[first]] += np.add.reduceat(values[take[low : low + step]] * tf[low : low + step, None], first)
    return out


def _slopes_of_blocks(weights: DataFrame, blocks: DataFrame, fits: Fits, bias: np.ndarray, first: bool) -> DataFrame:
    """Summed residual times count over training rows, in the form that the weights came in, in the first pass with
    summed squares of the inputs; losses and slopes of the intercepts go to a bucket of their own."""
    width = bias.size

    def run(given: pa.Table, chunks: pa.Table) -> pa.Table:
        if not len(given):
            return _table(CHUNK, [])
        read = lambda name, kind: np.frombuffer(_bytes(given.column(name)), kind)
        y, part, row, at, tf = read("y", np.int32), read("part", np.int32), read("row", np.int32), read("at", np.int32), read("tf", float)
        bucket, sizes, by_term = read("bucket", np.int32), read("sizes", np.int32), read("by_term", np.int32)
        n, terms = len(y), int(sizes.sum())
        w = np.zeros((terms, width))
        if not first:
            spot = {int(b): i for i, b in enumerate(bucket)}
            low = np.concatenate([[0], np.cumsum(sizes)])
            for i, b in enumerate(chunks.column("bucket").to_pylist()):
                w[low[spot[b]] : low[spot[b] + 1]] = np.frombuffer(_bytes(chunks.column("x"), i)).reshape(-1, width)
        p, shrink = _softmax(_added(w, at, tf, row, n), read("norms", float).reshape(n, -1), fits, bias)
        trains = (part[:, None] != fits.parts[None, :]) & (y >= 0)[:, None]
        own = np.take_along_axis(p, np.maximum(y, 0)[:, None, None].astype(np.int64), 2)[:, :, 0]
        loss = np.where(trains, -np.log(np.maximum(own, 1e-300)), 0.0).sum(0)
        residual = (p - (y[:, None, None] == np.arange(bias.shape[1]))) * trains[:, :, None]
        scaled = (residual * shrink[:, :, None]).reshape(n, width)
        g = _added(scaled, row[by_term], tf[by_term], at[by_term], terms)
        if first:
            g = np.concatenate([g, _added(trains * shrink**2, row[by_term], tf[by_term] ** 2, at[by_term], terms)], 1)
        g = np.split(g, np.cumsum(sizes)[:-1])
        number, extra = given.column("block")[0].as_py(), np.concatenate([loss, residual.sum(0).ravel()])
        return _table(CHUNK, [(number, NO_TERMS, extra.tobytes()), *[(number, int(b), x.tobytes()) for b, x in zip(bucket, g)]])

    return blocks.groupBy("block").cogroup(weights.groupBy("block")).applyInArrow(run, CHUNK)


def _updated(state: DataFrame, chunks: DataFrame, opt: _Optimiser, first: bool) -> DataFrame:
    """The rows with their trial point and its slope, and the products that the driver needs."""
    slopes = opt.shape[0] * opt.shape[1]
    width = slopes + opt.shape[0] * first

    def run(given: pa.Table, chunks: pa.Table) -> pa.Table:
        if len(chunks) and chunks.column("bucket")[0].as_py() == NO_TERMS:
            total = sum(np.frombuffer(_bytes(chunks.column("x"), i)) for i in range(len(chunks)))
            return _table(STATE, [(NO_TERMS, 0, b"", b"", b"", b"", b"", b"", b"", None, None, total.tobytes())])
        if not len(given) or given.column("bucket")[0].as_py() == NO_TERMS:
            return _table(STATE, [])
        terms = given.column("terms")[0].as_py()
        idf, blocks, sizes, places, scale, now, past = (_bytes(given.column(c)) for c in ("idf", "blocks", "sizes", "places", "scale", "now", "past"))
        low = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int32))])
        spot = {int(b): i for i, b in enumerate(np.frombuffer(blocks, np.int32))}
        where, summed = np.frombuffer(places, np.int32), np.zeros((terms, width))
        for i, b in enumerate(chunks.column("block").to_pylist()):
            j = spot[b]
            summed[where[low[j] : low[j + 1]]] += np.frombuffer(_bytes(chunks.column("x"), i)).reshape(-1, width)
        now, past = opt.next_trial(*opt.arrays(now, past, terms))
        factors = opt.factors(idf, terms)
        scale = opt.unit(summed[:, slopes:] / opt.rows * factors**2) if first else opt.scale(scale, terms)
        slope = summed[:, :slopes].reshape(terms, *opt.shape) / opt.rows[:, None] * (factors * scale)[:, :, None]
        now[TRIAL_G] = slope + (opt.penalty * scale**2)[:, :, None] * now[TRIAL_W]
        gram, square, largest = opt.products(now, past, scale)
        same = [x.tobytes() for x in (idf, blocks, sizes, places)]
        sums = np.concatenate([gram.ravel(), square]).tolist()
        return _table(STATE, [(given.column("bucket")[0].as_py(), terms, *same, scale.tobytes(), now.tobytes(), past.tobytes(), sums, largest.tolist(), None)])

    return state.groupBy("bucket").cogroup(chunks.groupBy("bucket")).applyInArrow(run, STATE)


def _report(state: DataFrame, fits: Fits) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Products, squares and largest slopes over all buckets; losses and slopes of the intercepts."""
    terms = state.where(F.col("bucket") != NO_TERMS)
    sums, most = Summarizer.sum(array_to_vector("gram")).alias("sum"), Summarizer.max(array_to_vector("slope")).alias("max")
    extra = F.max(F.when(F.col("bucket") == NO_TERMS, F.col("extra"))).alias("extra")
    found = terms.agg(sums, most).crossJoin(state.agg(extra)).first()  # one row each
    n, size = fits.shape[0], 2 * HISTORY + 1
    gram, square = np.split(found["sum"].toArray(), [n * size * size]) if found["sum"] is not None else (np.zeros(n * size * size), np.zeros(n))
    most = found["max"].toArray() if found["max"] is not None else np.zeros(n)
    return gram.reshape(n, size, size), square, most, np.frombuffer(found["extra"])


def direction(gram: np.ndarray) -> np.ndarray:
    """How the L-BFGS step is mixed from steps, changes of slope and slope, given all their products."""
    size = len(gram)
    m, g = (size - 1) // 2, size - 1
    mix = np.zeros(size)
    mix[g] = -1.0
    usable = [i for i in range(m) if gram[i, m + i] > 1e-14 * np.sqrt(gram[i, i] * gram[m + i, m + i]) and gram[i, m + i] > 0]
    alpha = {}
    for i in reversed(usable):
        alpha[i] = mix @ gram[:, i] / gram[i, m + i]
        mix[m + i] -= alpha[i]
    if usable:
        last = usable[-1]
        mix *= gram[last, m + last] / gram[m + last, m + last]
    for i in usable:
        mix[i] += alpha[i] - mix @ gram[:, m + i] / gram[i, m + i]
    return mix


def fits_of(features: DataFrame, specs: list[SoftmaxSpec], parts: int) -> Fits:
    """Labels and training rows of ``(category, part)``."""
    labels = label_list(features.where(F.col("part") < 0) if parts == 1 else features, least=2)
    known = F.array_contains(F.lit(labels), F.col("category"))
    row = features.agg(*[F.count_if(known & (F.col("part") != p)) for p in range(parts)]).first()
    return Fits(labels, specs, [int(x) for x in row])


def fit_softmax(
    features: DataFrame, specs: list[SoftmaxSpec] | None = None, parts: int = 1, tolerance: float = SLOPE_TOLERANCE,
    max_passes: int = LR_MAX_ITER,
) -> SoftmaxModel:
    """Fit on ``(doc_id, category, part, terms)``, once per part and setting; ids are unique.

    Rows without a known class train no fit. A fit is done when no slope exceeds ``tolerance``. Either all settings
    are ``raw`` or none.
    """
    specs = specs or [SoftmaxSpec()]
    freq = doc_frequency(_used_terms(features, specs), parts)
    fits = fits_of(features, specs, parts)
    docs = _documents(features, fits, freq, row=True)
    width, spark = fits.shape[0] * fits.shape[1], features.sparkSession
    facts = docs.agg(F.sum(F.greatest(F.size("terms"), F.lit(0)))).first()[0] or 0
    slots_here = spark.sparkContext.defaultParallelism
    n_blocks = max(min(slots_here, 1 + facts // 100_000), -(-facts * width // setting(spark, "blockValues", BLOCK_VALUES)))
    n_buckets = max(min(slots_here, 1 + freq.table.rows // 1_000), -(-freq.table.rows * width // setting(spark, "bucketValues", BUCKET_VALUES)))
    vocabulary = _vocabulary(freq, fits, n_buckets)
    blocks = _blocks(docs, vocabulary, n_blocks)
    name = f"softmax-state-{uuid.uuid4().hex[:12]}"
    state = overwrite_buckets(_first_state(vocabulary.df, blocks), f"{name}-0", "bucket", n_buckets)

    n, size = fits.shape[0], 2 * HISTORY + 1
    accept, mix, step = np.zeros(n, bool), np.zeros((n, size)), np.zeros(n)
    gram, value, slope = np.zeros((n, size, size)), np.full(n, np.inf), np.full(n, np.inf)
    along, done = np.zeros(n), np.zeros(n, bool)
    bias, bias_past = np.zeros((4, 1, *fits.shape)), np.zeros((2, HISTORY, 1, *fits.shape), np.float32)
    bias_unit = _Optimiser(fits, accept, mix, step).unit(np.ones((1, n)))
    for passes in range(1, max_passes + 1):
        opt = _Optimiser(fits, accept, mix, step)
        bias, bias_past = opt.next_trial(bias, bias_past)
        tried = bias[TRIAL_W, 0] * bias_unit[0][:, None]
        chunks = _slopes_of_blocks(_weights_for_blocks(state, opt), blocks, fits, tried, passes == 1)
        state = overwrite_buckets(_updated(state, chunks, opt, passes == 1), f"{name}-{passes % 2}", "bucket", n_buckets)
        found, square, most, extra = _report(state, fits)
        bias[TRIAL_G, 0] = extra[n:].reshape(fits.shape) / fits.rows[:, None] * bias_unit[0][:, None]
        bias_gram, _, bias_most = opt.products(bias, bias_past, bias_unit)
        found, most = found + bias_gram, np.maximum(most, bias_most)
        trial = extra[:n] / fits.rows + 0.5 * fits.penalty * square
        better = ~done & ((passes == 1) | (trial <= value + LEAST_GAIN * step * along + 1e-14 * np.abs(value)))
        better |= ~done & (passes > 1) & (most <= tolerance)
        gram[better], value[better], slope[better] = found[better], trial[better], most[better]
        accept = better
        step = np.where(better, 1.0, step / 2)
        stalled = ~better & (step < 1e-12)
        done = done | (slope <= tolerance) | stalled
        if done.all():
            break
        for f in np.flatnonzero(better):
            mix[f] = direction(gram[f])
            along[f] = mix[f] @ gram[f][:, -1]
            if passes == 1:  # the first step goes down the slope, one unit long at most
                step[f] = min(1.0, 1.0 / max(np.sqrt(gram[f][-1, -1]), 1e-300))
        step[done] = 0.0
    last = _Optimiser(fits, accept, mix, np.zeros(n))
    plain = materialize(_plain(state, vocabulary.df, last), "softmax-plain")
    scaled = F.zip_with("w", "factor", lambda w, f: w * f)
    weights = plain.join(vocabulary.df.select("term", "total", "idf"), "term").select("term", "total", "idf", scaled.alias("w"))
    weights = materialize(weights, "softmax-weights")
    found = last.advance(bias, bias_past, accept)[0][W, 0] * bias_unit[0][:, None]
    return SoftmaxModel(weights, plain, found, fits, freq, slope.tolist(), passes)


def _plain(state: DataFrame, vocabulary: DataFrame, opt: _Optimiser) -> DataFrame:
    """``term, w, factor``: accepted weights and their idf, one list over (fit, class) each."""
    classes = opt.shape[1]

    def run(terms: pa.Table, given: pa.Table) -> pa.Table:
        n = len(terms)
        if not n:
            return pa.table([pa.array([], pa.string()), *[pa.array([], pa.list_(pa.float64()))] * 2], names=["term", "w", "factor"])
        order = pa.array(np.argsort(_numbers(terms.column("place"))))
        now = opt.advance(*opt.arrays(_bytes(given.column("now")), _bytes(given.column("past")), n), opt.accept)[0]
        factors = np.repeat(opt.factors(_bytes(given.column("idf")), n)[:, :, None], classes, 2)
        scale = opt.scale(_bytes(given.column("scale")), n)[:, :, None]
        names = terms.column("term").combine_chunks().cast(pa.string()).take(order)
        return pa.table([names, _lists(now[W] * scale), _lists(factors)], names=["term", "w", "factor"])

    terms = vocabulary.select("bucket", "place", "term").groupBy("bucket")
    rows = state.where(F.col("bucket") != NO_TERMS).select("bucket", "idf", "scale", "now", "past").groupBy("bucket")
    return terms.cogroup(rows).applyInArrow(run, "term string, w array<double>, factor array<double>")


def score_softmax(model: SoftmaxModel, features: DataFrame, *keep: str) -> DataFrame:
    """``doc_id, part, *keep, spec, ranked`` of ``(doc_id, part, terms)`` by the model of each row's own part.

    Rows of no part (-1) are scored by part 0. Texts without a known term get the intercepts.
    """
    fits, classes = model.fits, len(model.fits.labels)
    keys, rules, own = ["doc_id", "part", *keep], fits.rules, F.greatest(F.col("part"), F.lit(0))
    n, m = len(fits.specs) * classes, len(rules)
    # Sums for scores, and those of squares for vector lengths, from one look at each term.
    table = TermTable.measure(model.weights, 16 + 8 * (model.bias.size + len(fits.n_train) * m))
    # Ids may repeat: each row has a sum of its own. The id stays in the key, so rows never mix.
    by = [*keys, "_row"]
    rows = _used_terms(features, fits.specs).withColumn("_row", F.monotonically_increasing_id())
    met = join_terms(term_rows(rows, *by, outer=True), table, ["w", "idf"], "doc_id")
    tf = F.col("tf")
    share = F.transform(F.slice("w", own * n + 1, F.lit(n)), lambda x: x * tf)
    square = F.transform(F.slice("idf", own * m + 1, F.lit(m)), lambda x: x * x * tf * tf)
    both = F.coalesce(F.concat(share, square), F.array_repeat(F.lit(0.0), n + m))
    summed = _summed(met.select(*by, both.alias("z")), by, "z", n + m)
    length = lambda i: F.lit(1.0) if fits.specs[0].raw else F.sqrt(F.get("z", F.lit(n + rules.index(fits.specs[i].rule))))
    bias = F.lit(model.bias.ravel().tolist())

    def score(i: int) -> Column:
        fit = lambda c: (own * len(fits.specs) + i) * classes + c
        z = lambda c: F.coalesce(F.get("z", i * classes + c) / F.nullif(length(i), F.lit(0.0)), F.lit(0.0))
        name = lambda c: F.get(F.lit(fits.labels), c).alias("category")
        scores = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.struct(name(c), (z(c) + F.get(bias, fit(c))).alias("score")))
        return F.struct(F.lit(i).alias("spec"), scores.alias("scores"))

    scored = summed.select(*keys, F.explode(F.array(*[score(i) for i in range(len(fits.specs))])).alias("x"))
    return rank_classes(scored.select(*keys, "x.spec", "x.scores"), "scores")


def save_softmax(model: SoftmaxModel, path: str) -> None:
    """Store what scoring needs, as two tables; ``load_softmax`` gives the same scores."""
    spark = model.weights.sparkSession
    model.weights.write.mode("overwrite").parquet(f"{path}/terms")
    body = asdict(model.fits) | {"bias": model.bias.tolist(), "max_slope": model.max_slope, "passes": model.passes}
    spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def load_softmax(spark: SparkSession, path: str) -> SoftmaxModel:
    try:
        body = json.loads(spark.read.text(f"{path}/header", wholetext=True).first()[0])
        weights = spark.read.parquet(f"{path}/terms")
    except AnalysisException as exc:
        raise ModelNotFound(path) from exc
    fits = Fits(body["labels"], [SoftmaxSpec(**s) for s in body["specs"]], body["n_train"])
    return SoftmaxModel(weights, None, np.array(body["bias"]), fits, None, body["max_slope"], body["passes"])


def slopes(model: SoftmaxModel, features: DataFrame) -> DataFrame:
    """``part, spec, max_slope``: the largest slope of each fit at its weights, by joins and sums of plain rows.

    It shares nothing with the optimiser but the tables it returned: one row per (document, term) with an array over
    (fit, class) for scores and again for slopes.
    """
    fits = model.fits
    n_fits, classes = fits.shape
    width, specs = n_fits * classes, len(fits.specs)
    docs = _documents(features, fits, model.freq)
    scaled = model.plain.select("term", F.zip_with("w", "factor", lambda w, f: w * f).alias("w"))
    z = _scores(docs, scaled, width)
    place = F.lit(fits.slots.tolist())
    bias = F.lit(model.bias.ravel().tolist())
    each = F.sequence(F.lit(0), F.lit(n_fits - 1))
    of_class = F.sequence(F.lit(0), F.lit(classes - 1))
    norm = lambda f: F.nullif(F.get("norms", F.get(place, f)), F.lit(0.0))
    score = lambda f, c: F.coalesce(F.get("z", f * classes + c) / norm(f), F.lit(0.0)) + F.get(bias, f * classes + c)
    z = z.withColumn("s", F.transform(each, lambda f: F.transform(of_class, lambda c: score(f, c))))
    z = z.withColumn("e", F.transform("s", lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s)))))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    trains = lambda f: (F.col("y") >= 0) & (F.col("part") != F.floor(f / specs))
    left = lambda e, f, t: F.transform(e, lambda x, c: F.when(trains(f), x / t - (c == F.col("y")).cast("double")).otherwise(0.0))
    z = z.withColumn("t", F.transform("e", total))
    z = z.withColumn("r", F.transform("e", lambda e, f: left(e, f, F.get("t", f))))
    z = z.withColumn("q", F.flatten(F.transform("r", lambda r, f: F.transform(r, lambda x: F.coalesce(x / norm(f), F.lit(0.0))))))
    z = materialize(z.select("terms", F.flatten("r").alias("r"), "q"), "softmax-residuals")
    rows, penalty = F.lit(fits.rows.tolist()), F.lit(fits.penalty.tolist())
    of_fit = lambda i: F.floor(i / classes).cast("int")
    one = _summed(z.select(F.lit(0).alias("one"), "r"), ["one"], "r", width)
    intercepts = one.select(F.transform("r", lambda g, i: g / F.get(rows, of_fit(i))).alias("slope"))
    met = z.select("q", F.explode_outer("terms").alias("t")).where("t.term IS NOT NULL").select(
        F.col("t.term").alias("term"), F.transform("q", lambda x: x * F.col("t.tf")).alias("g")
    )
    both = model.plain.join(_summed(met, ["term"], "g", width), "term", "left")
    at = lambda i: F.coalesce(F.get("g", i), F.lit(0.0)) * F.get("factor", i) / F.get(rows, of_fit(i))
    weighted = both.select(F.transform("w", lambda w, i: at(i) + F.get(penalty, of_fit(i)) * w).alias("slope"))
    most = [F.max(F.abs(F.get("slope", F.lit(i)))).alias(f"m_{i}") for i in range(width)]
    found = weighted.unionByName(intercepts).agg(*most)
    by_fit = F.array(*[F.greatest(*[f"m_{f * classes + c}" for c in range(classes)]) for f in range(n_fits)])
    return found.select(F.posexplode(by_fit).alias("fit", "max_slope")).select(
        F.floor(F.col("fit") / specs).cast("int").alias("part"), (F.col("fit") % specs).cast("int").alias("spec"), "max_slope"
    )
