"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A score is ``w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)`` through the logistic
function, linear in the number of features of a text. The model is fitted on a bounded sample of
labelled rows and has a fixed size (``BUCKETS`` times ``RANK + 1`` numbers); every row is scored where it
lies.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagekit.llm.structure import structure

BUCKETS = 1 << 16
RANK = 8
#: Labelled rows that a model is fitted on, at most.
SAMPLE_ROWS = 4000
#: Labelled texts of more characters are not in the sample, which bounds what reaches the driver.
SAMPLE_CHARS = 200_000
EPOCHS = 8
BATCH = 64
RATE = 0.05
WORD_CACHE = 100_000
DENSE = 10


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        bucket = DENSE + zlib.crc32(word.encode("utf-8", "surrogatepass")) % (BUCKETS - DENSE)
        if len(self) < WORD_CACHE:
            self[word] = bucket
        return bucket


_cache = _Buckets()


def features(text: str | None, n_chars: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values. The first ``DENSE`` are statistics of the text and its stated
    length (its own where that is null); the others are the distinct words, scaled to length one."""
    text = text or ""
    s = structure(text)
    per_word, per_line = 1 / max(s.n_words, 1), 1 / max(s.n_lines, 1)
    stated = len(text) if n_chars is None or n_chars < 0 else n_chars
    dense = [
        np.log1p(s.n_words) / 8, np.log1p(stated) / 10, min(s.n_symbols * per_word, 2.0), s.n_repeat_words * per_word,
        s.n_dup_lines * per_line, s.n_upper / max(s.n_letters, 1), min(s.word_chars * per_word, 20.0) / 10, s.n_short * per_word,
        min(s.n_stops * per_word, 2.0), s.n_distinct * per_word,
    ]
    words = set(text.lower().split())
    hashed = np.unique(np.fromiter(map(_cache.__getitem__, words), np.int64, len(words)))
    index = np.concatenate([np.arange(DENSE), hashed])
    value = np.concatenate([dense, np.full(len(hashed), 1 / np.sqrt(max(len(hashed), 1)))])
    return index.astype(np.int32), value.astype(np.float32)


@dataclass(frozen=True)
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logit(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.factors[index]
        summed = value @ v
        squares = (value * value) @ (v * v)
        return float(self.bias + value @ self.linear[index] + 0.5 * (summed @ summed - squares.sum()))

    def score(self, text: str | None, n_chars: int | None = None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(*features(text, n_chars)), -30, 30))))


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 42, decay: float = 1e-5) -> Machine:
    """Mini-batches of AdaGrad steps on the log-loss; without rows, every score is one half."""
    rng = np.random.default_rng(seed)
    bias, linear = 0.0, np.zeros(BUCKETS)
    factors = rng.normal(0, 0.05, (BUCKETS, RANK))
    seen_bias, seen_linear, seen_factors = 1e-6, np.full(BUCKETS, 1e-6), np.full((BUCKETS, RANK), 1e-6)
    if rows:
        share = np.clip(np.mean([y for *_, y in rows]), 0.01, 0.99)
        bias = float(np.log(share / (1 - share)))
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for low in range(0, len(rows), BATCH):
            picked = [rows[i] for i in order[low : low + BATCH]]
            sizes = np.array([len(r[0]) for r in picked])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            index = np.concatenate([r[0] for r in picked])
            x = np.concatenate([r[1] for r in picked]).astype(float)
            y = np.array([r[2] for r in picked], float)
            v = factors[index]
            xv = x[:, None] * v
            summed = np.add.reduceat(xv, starts)
            pair = 0.5 * ((summed**2).sum(1) - np.add.reduceat((xv**2).sum(1), starts))
            z = bias + np.add.reduceat(x * linear[index], starts) + pair
            slope = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            each = np.repeat(slope, sizes)
            g_linear = np.bincount(index, each * x, BUCKETS)
            touched = np.unique(index)
            where = np.searchsorted(touched, index)
            step = (each * x)[:, None] * (np.repeat(summed, sizes, 0) - xv)
            g_factors = np.stack([np.bincount(where, step[:, f], len(touched)) for f in range(RANK)], 1)
            g_linear = g_linear[touched] / len(picked) + decay * linear[touched]
            g_factors = g_factors / len(picked) + decay * factors[touched]
            g_bias = slope.mean()
            seen_bias += g_bias**2
            seen_linear[touched] += g_linear**2
            seen_factors[touched] += g_factors**2
            bias -= RATE * g_bias / np.sqrt(seen_bias)
            linear[touched] -= RATE * g_linear / np.sqrt(seen_linear[touched])
            factors[touched] -= RATE * g_factors / np.sqrt(seen_factors[touched])
    return Machine(float(bias), linear.astype(np.float32), factors.astype(np.float32))


def crc32_of(id_col: str) -> Column:
    """CRC-32 of an id written as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def labelled_sample(labels: DataFrame, label_col: str, allowed: Column, rows: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``rows`` labelled ids, chosen by a hash of the id: the same ones however rows are ordered.

    Rows without id or label count as unlabelled; ids with several labels take the largest.
    """
    return (
        labels.where(allowed & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("sample_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("sample_label"))
        .orderBy(F.xxhash64("sample_id"), "sample_id")
        .limit(rows)
    )


def training_rows(docs: DataFrame, sample: DataFrame, extract, schema: str, id_col: str, most_chars: int, text: Column, *columns: Column) -> list:
    """What ``extract`` makes of the sampled documents, one row of each id: the one with the least digest.

    Repeated ids are reduced before anything is extracted or collected, and texts of more than ``most_chars``
    characters are left out, so at most (rows of the sample) x (features of ``most_chars`` characters) are collected.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("sample_id"), text, *columns).join(F.broadcast(sample), "sample_id")
    names = [c for c in picked.columns if c != "sample_id"]
    digest = F.struct(*[F.xxhash64(F.lit(seed), *names) for seed in (1, 2)])
    one = picked.where(F.coalesce(F.length("text"), F.lit(0)) <= most_chars).groupBy("sample_id").agg(F.min_by(F.struct(*names), digest).alias("row"))
    return sorted(one.select("sample_id", "row.*").mapInArrow(extract, schema).collect(), key=lambda r: r[0])


def _metadata(docs: DataFrame) -> Column:
    return (F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")).alias("n_chars")


def fit_quality(
    docs: DataFrame, labels: DataFrame, allowed: Column, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> Machine:
    """Fit on at most ``sample_rows`` documents, of ``SAMPLE_CHARS`` characters at most, whose label row satisfies ``allowed``."""

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"sample_id": [], "label": [], "i": [], "x": []}
            for key, text, n_chars, label in zip(*(c.to_pylist() for c in batch.columns)):
                index, value = features(text, n_chars)
                for name, item in zip(out, (key, label, index.tobytes(), value.tobytes())):
                    out[name].append(item)
            types = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    sample = labelled_sample(labels, label_col, allowed, sample_rows)
    rows = training_rows(
        docs, sample, extract, "sample_id long, label int, i binary, x binary", id_col, SAMPLE_CHARS,
        F.col(text_col).cast("string").alias("text"), _metadata(docs),
    )
    return fit_machine([(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32), r[1]) for r in rows])


def quality_score(docs: DataFrame, machine: Machine, text_col: str = "text") -> Column:
    """Score of each row; empty and null texts get one too."""
    model = docs.sparkSession.sparkContext.broadcast(machine)  # of a fixed size

    @F.pandas_udf("double")
    def score(texts: pd.Series, n_chars: pd.Series) -> pd.Series:
        own = model.value
        stated = [None if pd.isna(n) else int(n) for n in n_chars]
        return pd.Series([own.score(t, n) for t, n in zip(texts, stated)], dtype=float)

    return score(F.col(text_col).cast("string"), _metadata(docs))
