"""Logistic regression of rows that fit into one task: the fits of a part in a task of their own, all parts side by side.

The same objective, start and step as in ``softmax``, and the same tables come back; but a pass is a few sums over arrays
in a task's memory, where ``softmax`` needs two shuffles. ``encode`` numbers the terms once: each batch of rows becomes a
block of counts with a list of its distinct terms, and only those lists are shuffled by term. A task then gets every
block, as lists of numbers, and makes document counts, idf and vector lengths of its own part itself. Beyond
``spark.triagekit.fitBytes`` there is no such form and ``softmax`` does the fit, whatever the size.

A term in a single training row has a weight in proportion to its value there, as its slope has no other part. So all
such terms of a row are one column, of the length of their values: the optimum is the same with far fewer weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagekit.constants import LR_MAX_ITER
from triagekit.operators.ranking import rank_probabilities
from triagekit.operators.softmax import (
    HISTORY, LEAST_GAIN, SLOPE_TOLERANCE, Fits, SoftmaxModel, SoftmaxSpec, _lists, _used_terms, fit_softmax, fits_of,
    score_softmax,
)
from triagekit.operators.vectorize import doc_frequency
from triagekit.session import setting
from triagekit.sources.store import materialize

#: Bytes that a task may need for a fit, and what it needs for each fact and for each weight (while it starts, and for
#: the optimiser's arrays).
FIT_BYTES = 800_000_000
FACT_BYTES, WEIGHT_BYTES = 25, 112
#: Facts that are added up at once.
STRETCH = 1 << 18
BLOCK = "block long, y binary, part binary, sizes binary, at binary, tf binary, terms array<struct<term:string,n:int>>"


@dataclass(frozen=True)
class Encoded:
    """``blocks``: counts of some rows each, with ``ids``: twice the number of each of their terms, plus one for a pair
    of words. ``names``: ``term, total, id`` of all terms, in the same numbers."""

    blocks: DataFrame
    names: DataFrame
    terms: int
    fits: Fits


def encode(features: DataFrame, specs: list[SoftmaxSpec], parts: int, *keep: str) -> Encoded | None:
    """Blocks of ``(doc_id, category, part, terms)`` with ``doc_id, part, *keep``; none where a task can't hold the rows."""
    spark = features.sparkSession
    limit = setting(spark, "fitBytes", FIT_BYTES)
    used = _used_terms(features, specs)
    facts = used.agg(F.sum(F.greatest(F.size("terms"), F.lit(0)))).first()[0] or 0
    if facts * FACT_BYTES > limit:
        return None
    fits = fits_of(features, specs, parts)
    y = (F.coalesce(F.array_position(F.lit(fits.labels), F.col("category")), F.lit(0)) - 1).cast("int").alias("y")
    keys = F.struct("doc_id", "part", *keep)
    rows = used.select(y, F.col("part").cast("int").alias("part"), "terms", keys.alias("key"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            number += 1
            yield _block(number, batch)

    kind = rows.schema["key"].dataType.simpleString()
    blocks = materialize(rows.mapInArrow(cut, f"{BLOCK}, keys array<{kind}>"), "softmax-local-blocks")
    listed = blocks.select("block", F.posexplode("terms").alias("pos", "t")).select("block", "pos", "t.term", "t.n")
    places = listed.groupBy("term").agg(F.sum("n").alias("total"), F.collect_list(F.struct("block", "pos")).alias("places"))
    names = materialize(places.withColumn("spot", F.monotonically_increasing_id()), "softmax-local-terms")
    stretch = F.shiftright("spot", 33).cast("int")
    held = names.groupBy(stretch.alias("stretch")).agg(F.count("*").alias("n"), F.count_if(F.col("total") > 1).alias("many")).collect()
    sizes = np.zeros(1 + max([r["stretch"] for r in held], default=0), int)
    for r in held:  # one row per task that wrote terms
        sizes[r["stretch"]] = r["n"]
    weights = sum(r["many"] for r in held) + max(fits.n_train, default=0)
    if facts * FACT_BYTES + weights * len(fits.labels) * WEIGHT_BYTES > limit:
        return None
    before = F.get(F.lit((np.cumsum(sizes) - sizes).tolist()), stretch)
    names = names.withColumn("id", (before + F.col("spot").bitwiseAND(F.lit((1 << 33) - 1))).cast("int"))
    code = F.col("id") * 2 + (F.instr("term", " ") > 0).cast("int")
    ids = names.select(code.alias("code"), F.explode("places").alias("p")).groupBy(F.col("p.block").alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p.pos", "code"))), lambda x: x["code"]).alias("ids")
    )
    return Encoded(blocks.drop("terms").join(ids, "block", "left"), names.select("term", "total", "id"), int(sizes.sum()), fits)


def _block(number: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    lists = batch.column("terms")
    flat, n = lists.flatten(), len(batch)
    row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    term, tf = pc.struct_field(flat, "term"), pc.struct_field(flat, "tf").cast(pa.float64())
    given = pc.and_(term.is_valid(), tf.is_valid())
    row, term, tf = row[given.to_numpy(zero_copy_only=False)], term.filter(given), tf.filter(given).to_numpy(zero_copy_only=False)
    coded = term.dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    terms = pa.StructArray.from_arrays([coded.dictionary.cast(pa.string()), pa.array(np.bincount(at, minlength=len(coded.dictionary)).astype(np.int32))], ["term", "n"])
    # The narrowest type that holds all counts.
    small = next(x for x in (tf.astype(t) for t in (np.uint8, np.float32, float)) if x.dtype == float or np.array_equal(x, tf))
    of = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int32)
    sizes = np.bincount(row, minlength=n).astype(np.int32)
    arrays = [pa.array([number], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (of("y"), of("part"), sizes, at, small)]]
    arrays += [pa.ListArray.from_arrays([0, len(x)], x) for x in (terms, batch.column("key"))]
    return pa.RecordBatch.from_arrays(arrays, names=["block", "y", "part", "sizes", "at", "tf", "terms", "keys"])


class _Sums:
    """Sums of ``values[take] * count`` by the ascending ``to``."""

    def __init__(self, to: np.ndarray, take: np.ndarray, count: np.ndarray, n: int):
        self.n, self.take, self.count = n, take, None if (count == 1).all() else count
        self.first = np.flatnonzero(np.diff(to, prepend=-1))
        self.to = to[self.first]
        at = np.unique(np.append(np.searchsorted(self.first, np.arange(0, len(to), STRETCH)), len(self.first)))
        ends = np.append(self.first, len(to))
        self.stretches = [(a, b, ends[a], ends[b]) for a, b in zip(at[:-1], at[1:])]

    def of(self, values: np.ndarray, power: int = 1) -> np.ndarray:
        """By place; of squares of counts where ``power`` is two."""
        out = np.zeros(self.n)
        for a, b, low, high in self.stretches:
            x = values.take(self.take[low:high], mode="clip")
            for _ in range(power if self.count is not None else 0):
                x *= self.count[low:high]
            out[self.to[a:b]] = np.add.reduceat(x, self.first[a:b] - low)
        return out


class _Rows:
    """All rows of a task, as counts."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        found, self.keys = [], []
        for batch in batches:
            for i in range(len(batch)):
                read = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)  # noqa: B023, E731
                at, ids = read("at", np.int32), batch.column("ids")[i]
                ids = ids.values.to_numpy().astype(np.int32) if ids.is_valid else np.zeros(0, np.int32)
                tf = read("tf", {1: np.uint8, 4: np.float32, 8: float}[len(batch.column("tf")[i].as_buffer()) // max(1, len(at)) or 1])
                found.append([read("y", np.int32).copy(), read("part", np.int32).copy(), read("sizes", np.int32).copy(), ids[at], tf.copy()])
                if "keys" in batch.schema.names:
                    self.keys.append(batch.column("keys")[i].values)
        self.y, self.part, sizes, code, self.tf = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int32)] * 5
        self.row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.at, self.pair = code >> 1, (code & 1).astype(bool)

    def factors(self, spec: SoftmaxSpec, part: int, terms: int) -> np.ndarray:
        """The idf of each term, zero where the setting does not use it."""
        in_part = self.part != part
        df, n = np.bincount(self.at[in_part[self.row]], minlength=terms), in_part.sum()
        used = df >= max(spec.min_df, 1)
        if spec.ngram_max == 1:
            pair = np.zeros(terms, bool)
            pair[self.at] = self.pair
            used &= ~pair
        return np.where(used, 1.0 if spec.raw else np.log((n + 1.0) / (df + 1.0)) + 1.0, 0.0)


class _Part:
    """Training rows of a part as one rule sees them, and fits on them."""

    def __init__(self, rows: _Rows, spec: SoftmaxSpec, part: int, terms: int, classes: int):
        self.factor = rows.factors(spec, part, terms)
        n = len(rows.y)
        length = np.sqrt(_Sums(rows.row, rows.at, rows.tf, n).of(self.factor**2, 2))
        self.shrink = np.ones(n) if spec.raw else np.divide(1.0, length, out=np.zeros(n), where=length > 0)
        trains = (rows.part != part) & (rows.y >= 0)
        self.train, self.y = np.flatnonzero(trains), rows.y[trains]
        seen = trains[rows.row] & (self.factor > 0)[rows.at]
        times = np.bincount(rows.at[seen], minlength=terms)
        # Terms of one training row only: one column for all that a row has.
        single = seen & (times == 1)[rows.at]
        self.single_at, self.single_row = rows.at[single], np.searchsorted(self.train, rows.row[single])
        self.single = rows.tf[single] * self.factor[self.single_at] * self.shrink[rows.row[single]]
        self.alone = np.sqrt(np.bincount(self.single_row, self.single**2, minlength=len(self.train)))
        self.many = np.flatnonzero(times > 1)
        seen &= ~single
        place = np.cumsum(times > 1) - 1
        at, row, tf = place[rows.at[seen]].astype(np.int32), np.searchsorted(self.train, rows.row[seen]).astype(np.int32), rows.tf[seen]
        del seen, single
        self.by_row = _Sums(row, at, tf, len(self.train))
        order = np.argsort(at, kind="stable")
        self.by_term = _Sums(at[order], row[order], tf[order], len(self.many))
        self.classes, self.terms = classes, terms

    def fit(self, C: float, tolerance: float, start: np.ndarray | None) -> tuple[np.ndarray, float, int]:
        """Weights ``[class, terms of many rows; rows' own columns; intercept]``, the largest slope, and the passes."""
        k, n, t = self.classes, max(1, len(self.y)), len(self.many)
        penalty, shrink, factor = 1.0 / (C * n), self.shrink[self.train], self.factor[self.many]
        penalties = np.append(np.full(t + len(self.y), penalty), 0.0)
        curvature = np.concatenate([self.by_term.of(shrink**2, 2) * factor**2, self.alone**2, [n]]) / n
        scale = 1.0 / np.sqrt(curvature * (k - 1) / k**2 + penalty)
        own = (self.y, np.arange(len(self.y)))

        def value(w: np.ndarray) -> tuple[float, np.ndarray]:
            """Loss and slope; weights and slopes of all classes add up to zero, so the last class needs no sums."""
            z = np.empty((k, len(self.y)))
            for c in range(k - 1):
                z[c] = self.by_row.of(factor * w[c, :t]) * shrink + self.alone * w[c, t:-1] + w[c, -1]
            z[-1] = -z[:-1].sum(0)
            z -= z.max(0)
            p = np.exp(z)
            total = p.sum(0)
            loss = (np.log(total) - z[own]).sum() / n + 0.5 * (penalties * w * w).sum()
            p /= total
            p[own] -= 1.0
            g = np.empty_like(w)
            for c in range(k - 1):
                g[c, :t], g[c, t:-1], g[c, -1] = self.by_term.of(p[c] * shrink) * factor, p[c] * self.alone, p[c].sum()
            g[-1] = -g[:-1].sum(0)
            return loss, g / n + penalties * w

        w = np.zeros((k, t + len(self.y) + 1)) if start is None else start
        loss, g = value(w)
        past, passes = [], 1
        while passes < LR_MAX_ITER and np.abs(g).max() > tolerance:
            way = _direction(g * scale, past) * scale
            along = (way * g).sum()
            if along >= 0:
                past, way = [], -g * scale**2
                along = (way * g).sum()
            step = 1.0 if past else min(1.0, 1.0 / max(np.sqrt(-along), 1e-300))
            while step >= 1e-12:
                trial = w + step * way
                trial[-1] = -trial[:-1].sum(0)
                passes += 1
                new_loss, new = value(trial)
                if new_loss <= loss + LEAST_GAIN * step * along + 1e-14 * abs(loss) or np.abs(new).max() <= tolerance:
                    break
                step /= 2
            else:
                break  # no step gains anything: as near as numbers allow
            past = _remembered(past, (trial - w) / scale, (new - g) * scale)
            w, loss, g = trial, new_loss, new
        return w, float(np.abs(g).max(initial=0.0)), passes

    def by_name(self, w: np.ndarray) -> np.ndarray:
        """Weights of all terms, ``[class, term]``; a row's own column goes to its terms by their values."""
        t = len(self.many)
        out = np.zeros((self.classes, self.terms))
        out[:, self.many] = w[:, :t]
        length = self.alone[self.single_row]
        share = np.divide(self.single, length, out=np.zeros_like(length), where=length > 0)
        out[:, self.single_at] = w[:, t + self.single_row] * share
        return out


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    return np.einsum("ij,ij->", a, b, dtype=float)


def _remembered(past: list[tuple], s: np.ndarray, y: np.ndarray) -> list[tuple]:
    """With a step and its change of slope, in single precision, and their products; without one that shows no curvature."""
    s, y = s.astype(np.float32), y.astype(np.float32)
    gain, square = _dot(s, y), _dot(y, y)
    if gain <= 0 or gain <= 1e-14 * np.sqrt(_dot(s, s) * square):
        return past
    return [*past[1 - HISTORY :], (s, y, gain, square)]


def _direction(g: np.ndarray, past: list[tuple]) -> np.ndarray:
    """The L-BFGS step by two loops over remembered steps and changes of slope."""
    way, shares = -g, []
    for s, y, gain, _ in reversed(past):
        shares.append(_dot(s, way) / gain)
        way -= shares[-1] * y
    if past:
        way *= past[-1][2] / past[-1][3]
    for (s, y, gain, _), a in zip(past, reversed(shares)):
        way += (a - _dot(y, way) / gain) * s
    return way


def _solved(docs: Encoded, tolerance: float, tell, schema: str, *columns: str) -> DataFrame:
    """What ``tell`` yields for each fit; fits of a part and of one range of terms share a task, wide ranges first."""
    fits, specs = docs.fits, docs.fits.specs
    ranges = sorted({s.ngram_max for s in specs}, reverse=True)
    tasks = [(p, n) for n in ranges for p in range(len(fits.n_train))]
    classes, terms = len(fits.labels), docs.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        if task >= len(tasks):
            return
        rows, (part, ngram) = _Rows(batches), tasks[task]
        for rule in [r for r in fits.rules if r.ngram_max == ngram]:
            chosen = sorted((s.C, i) for i, s in enumerate(specs) if s.rule == rule)
            of_rule, start = _Part(rows, specs[chosen[0][1]], part, terms, classes), None
            for C, i in chosen:  # from strong to weak penalty, each from the optimum before
                start, slope, passes = of_rule.fit(C, tolerance, start)
                yield from tell(rows, of_rule, part, i, start, slope, passes)

    given = docs.blocks.select("y", "part", "sizes", "at", "tf", "ids", *columns)
    each = given.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(len(tasks) - 1))))
    return each.repartitionById(len(tasks), F.col("task")).drop("task").mapInArrow(run, schema)


def fit(
    features: DataFrame, specs: list[SoftmaxSpec] | None = None, parts: int = 1, tolerance: float = SLOPE_TOLERANCE
) -> SoftmaxModel:
    """As ``fit_softmax``, in single tasks where these can hold the rows."""
    specs = specs or [SoftmaxSpec()]
    docs = encode(features, specs, parts)
    if docs is None:
        return fit_softmax(features, specs, parts, tolerance)
    fits = docs.fits

    def tell(rows, of_rule, part, i, w, slope, passes):
        number = part * len(specs) + i
        known = np.flatnonzero(of_rule.factor > 0)
        own = of_rule.by_name(w)[:, known].T
        head = np.concatenate([[w[:, -1]], np.full((1, w.shape[0]), float(passes))])
        ids, factor = np.concatenate([[-1, -2], known]), np.concatenate([[slope, 0.0], of_rule.factor[known]])
        for low in range(0, len(ids), 100_000):
            cut = slice(low, low + 100_000)
            arrays = [pa.array(np.full(len(ids[cut]), number, np.int32)), pa.array(ids[cut].astype(np.int32)), _lists(np.concatenate([head, own])[cut]), pa.array(factor[cut])]
            yield pa.RecordBatch.from_arrays(arrays, names=["fit", "id", "w", "factor"])

    found = materialize(_solved(docs, tolerance, tell, "fit int, id int, w array<double>, factor double"), "softmax-local-fits")
    bias, slope, passes = np.zeros(fits.shape), [0.0] * fits.shape[0], 0
    for r in found.where("id < 0").collect():  # two rows per fit
        if r["id"] == -1:
            bias[r["fit"]], slope[r["fit"]] = r["w"], r["factor"]
        else:
            passes = max(passes, int(r["w"][0]))
    zeros = F.struct(F.array_repeat(F.lit(0.0), fits.shape[1]).alias("w"), F.lit(0.0).alias("factor"))
    entry = F.struct("fit", F.struct("w", "factor").alias("x"))
    by_term = found.where("id >= 0").groupBy("id").agg(F.map_from_entries(F.collect_list(entry)).alias("fits"))
    each = F.transform(F.sequence(F.lit(0), F.lit(fits.shape[0] - 1)), lambda f: F.coalesce(F.col("fits")[f], zeros))
    listed = docs.names.join(by_term.select("id", each.alias("x")), "id")
    wide = lambda x: F.array_repeat(x, fits.shape[1])
    of_slot = [int(np.flatnonzero(fits.slots == s)[0]) for s in range(len(fits.n_train) * len(fits.rules))]
    table = materialize(
        listed.select(
            "term", "total", F.flatten(F.col("x.w")).alias("w"), F.flatten(F.transform("x.factor", wide)).alias("factor"),
            F.transform(F.lit(of_slot), lambda f: F.get("x.factor", f)).alias("idf"),
        ),
        "softmax-plain",
    )
    weights = table.select("term", "total", "idf", F.zip_with("w", "factor", lambda w, f: w * f).alias("w"))
    return SoftmaxModel(weights, table.select("term", "w", "factor"), bias, fits, doc_frequency(_used_terms(features, specs), parts), slope, passes)


def held_out(docs: Encoded, *keep: str, tolerance: float = SLOPE_TOLERANCE) -> DataFrame:
    """``doc_id, part, *keep, spec, ranked``: each row by the fit of its own part, all in the tasks of the fits."""
    labels = docs.fits.labels
    kind = docs.blocks.schema["keys"].dataType.elementType
    names = ["doc_id", "part", *keep]

    def tell(rows, of_rule, part, i, w, slope, passes):
        # Rows of no part belong to the first.
        held = (rows.part == part) | ((rows.part < 0) & (part == 0))
        which = np.flatnonzero(held)
        mine = held[rows.row]
        to = np.searchsorted(which, rows.row[mine]).astype(np.int32)
        sums, own = _Sums(to, rows.at[mine], rows.tf[mine], len(which)), of_rule.by_name(w)
        z = np.stack([sums.of(of_rule.factor * own[c]) for c in range(len(labels))]) * of_rule.shrink[which] + w[:, -1:]
        p = np.exp(z - z.max(0))
        p = (p / p.sum(0)).T
        keys = pa.concat_arrays(rows.keys).take(pa.array(which)) if len(which) else None
        for low in range(0, len(which), 10_000):
            some = keys.slice(low, 10_000)
            columns = [pc.struct_field(some, n) for n in names]
            arrays = [*columns, pa.array(np.full(len(some), i, np.int32)), _lists(p[low : low + 10_000])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "spec", "p"])

    types = ", ".join(f"`{n}` {kind[n].dataType.simpleString()}" for n in names)
    found = _solved(docs, tolerance, tell, f"{types}, spec int, p array<double>", "keys")
    return found.select(*names, "spec", rank_probabilities(labels, F.col("p")).alias("ranked"))


def out_of_fold(features: DataFrame, parts: int, *keep: str, specs: list[SoftmaxSpec] | None = None) -> DataFrame:
    """Rows by the fit of their own part: in single tasks where these can hold the rows, else by tables of weights."""
    specs = specs or [SoftmaxSpec()]
    docs = encode(features, specs, parts, *keep)
    if docs is None:
        return score_softmax(fit_softmax(features, specs, parts), features, *keep)
    return held_out(docs, *keep)
