"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a score from its hashed words and word beginnings;
the document's score is the noisy-or of its sentences, ``1 - prod(1 - p)``. Harmless sentences must not add up, however
many there are: of those with a faint score only the strongest counts, and a text's number of sentences enters through
a prior that saturates. Only documents have labels:
the slope of the log-loss flows through the noisy-or to the sentences, so that the fitted model also says
which sentences offend. Fitted on a bounded sample of labelled rows; its size is fixed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagekit.llm.fm import labelled_sample, training_rows

BUCKETS = 1 << 18
#: Labelled rows that a model is fitted on, at most.
SAMPLE_ROWS = 6000
EPOCHS = 30
BATCH = 64
RATE = 1.0
#: Labelled texts of more characters are not in the sample, which bounds what reaches the driver.
SAMPLE_CHARS = 50_000
#: Features whose share of toxic and of clean documents differs by fewer standard errors are left out.
TELLING = 4.0
#: Sentences below this score are faint; ``MOST_PRIOR * n / (n + HALF_PRIOR)`` is the prior of a text of n sentences.
FAINT = 0.02
MOST_PRIOR, HALF_PRIOR = 0.01, 50
STARTS = (4, 5)
OFFENDS_AT = 0.3
WORD_CACHE = 100_000
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


class _Buckets(dict):
    """Buckets of a word and of its beginnings."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        keys = [f"w{word}", *(f"{n}{word[:n]}" for n in STARTS if len(word) > n)]
        found = tuple(zlib.crc32(k.encode("utf-8", "surrogatepass")) % BUCKETS for k in keys)
        if len(self) < WORD_CACHE:
            self[word] = found
        return found


_cache = _Buckets()


def sentences_of(text: str | None) -> list[tuple[int, int]]:
    """Start and end of each sentence that has a word; none in a null or empty text."""
    return [m.span() for m in SENTENCE.finditer(text or "") if not m[0].isspace()]


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Features of all sentences in a row, where each sentence begins among them, and their places."""
    text = text or ""
    index: list[int] = []
    starts: list[int] = []
    spans = []
    for low, high in sentences_of(text):
        words = set(WORD.findall(text[low:high].lower()))
        if words:
            starts.append(len(index))
            spans.append((low, high))
            index.extend({b for w in words for b in _cache[w]})
    return np.array(index, np.int32), np.array(starts, np.int64), spans


@dataclass(frozen=True)
class SentenceModel:
    bias: float
    weights: np.ndarray

    def sentences(self, index: np.ndarray, starts: np.ndarray) -> np.ndarray:
        z = self.bias + np.add.reduceat(self.weights[index].astype(float), starts) if len(starts) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def document_score(p: np.ndarray) -> float:
    """Score of a document from those of its sentences; zero without sentences."""
    if not len(p):
        return 0.0
    faint = p[p < FAINT].max(initial=0.0)
    prior = MOST_PRIOR * len(p) / (len(p) + HALF_PRIOR)
    return noisy_or(np.concatenate([p[p >= FAINT], [faint, prior]]))


def noisy_or(p: np.ndarray) -> float:
    return float(0.0 - np.expm1(np.log1p(-np.clip(p, 0, 1 - 1e-12)).sum()))


def _telling(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Which features are in clearly more, or fewer, toxic documents than clean ones."""
    n, count = [0, 0], [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for index, _, label in rows:
        n[label > 0] += 1
        count[label > 0][np.unique(index)] += 1
    if not all(n):
        return np.zeros(BUCKETS, bool)
    pooled = (count[0] + count[1]) / sum(n)
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n[0] + 1 / n[1]))
    return np.abs(count[1] / n[1] - count[0] / n[0]) >= TELLING * error


def _only(telling: np.ndarray, index: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bag without the other features; a sentence that loses all keeps one of weight zero."""
    kept = telling[index]
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(index))))
    sizes = np.bincount(owner[kept], minlength=len(starts))
    filled = np.concatenate([index[kept], np.full((sizes == 0).sum(), BUCKETS, np.int32)])
    order = np.argsort(np.concatenate([owner[kept], np.flatnonzero(sizes == 0)]), kind="stable")
    sizes = np.maximum(sizes, 1)
    return filled[order], np.cumsum(sizes) - sizes


def fit_sentences(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 42) -> SentenceModel:
    """Mini-batches of AdaGrad steps on the log-loss of documents, over the telling features."""
    rng = np.random.default_rng(seed)
    rows = [r for r in rows if len(r[1])]
    telling = _telling(rows)
    rows = [(*_only(telling, *r[:2]), r[2]) for r in rows]
    bias, weights = -6.0, np.zeros(BUCKETS + 1)
    seen_bias, seen = 1.0, np.full(BUCKETS + 1, 1e-2)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for low in range(0, len(rows), BATCH):
            picked = [rows[i] for i in order[low : low + BATCH]]
            index = np.concatenate([r[0] for r in picked])
            before = np.concatenate([[0], np.cumsum([len(r[0]) for r in picked])[:-1]])
            starts = np.concatenate([r[1] + b for r, b in zip(picked, before)])
            bags = np.array([len(r[1]) for r in picked])
            bag_starts = np.concatenate([[0], np.cumsum(bags)[:-1]])
            y = np.array([r[2] for r in picked], float)
            z = np.clip(bias + np.add.reduceat(weights[index], starts), -30, 30)
            p = 1 / (1 + np.exp(-z))
            whole = np.clip(-np.expm1(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), bag_starts)), 1e-9, 1)
            # Of the log-loss by a sentence's logit: p for a clean document, -p (1 - P) / P for a toxic one.
            slope = p * np.repeat(np.where(y > 0, -(1 - whole) / whole, 1.0), bags)
            each = np.repeat(slope, np.diff(np.append(starts, len(index))))
            touched = np.unique(index)
            touched = touched[touched < BUCKETS]
            g = np.bincount(np.searchsorted(touched, index), each, len(touched) + 1)[: len(touched)] / len(picked)
            seen[touched] += g**2
            weights[touched] -= RATE * g / np.sqrt(seen[touched])
            g_bias = slope.sum() / len(picked)
            seen_bias += g_bias**2
            bias -= RATE * g_bias / np.sqrt(seen_bias)
    return SentenceModel(float(bias), weights[:BUCKETS].astype(np.float32))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, allowed: Column, label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> SentenceModel:
    """Fit on at most ``sample_rows`` documents, of ``SAMPLE_CHARS`` characters at most, whose label row satisfies ``allowed``."""

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, label in zip(*(c.to_pylist() for c in batch.columns)):
                index, starts, _ = bag(text)
                rows.append((key, label, index.tobytes(), starts.tobytes()))
            types = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["sample_id", "label", "i", "s"])

    rows = training_rows(
        docs, labelled_sample(labels, label_col, allowed, sample_rows), extract, "sample_id long, label int, i binary, s binary",
        id_col, SAMPLE_CHARS, F.col(text_col).cast("string").alias("text"),
    )
    return fit_sentences([(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.int64), r[1]) for r in rows])


def toxicity(docs: DataFrame, model: SentenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of every row, how many sentences offend, and where the worst one lies (in code points).

    A text without words scores zero and has no worst sentence. Repeated rows and null ids are scored
    like others; an empty table gives no rows. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                index, starts, spans = bag(text.as_py())
                p = shared.value.sentences(index, starts)
                worst = spans[int(p.argmax())] if len(p) else (None, None)
                rows.append((document_score(p), int((p >= OFFENDS_AT).sum()), *worst))
            if rows:
                types = (pa.float64(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "score", "n_offending", "worst_start", "worst_end"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, score double, n_offending long, worst_start long, worst_end long")


def offending_sentences(
    docs: DataFrame, model: SentenceModel, at_least: float = OFFENDS_AT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The sentences whose own score is at least ``at_least``, with their places (in code points) and texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                index, starts, spans = bag(text)
                for p, (low, high) in zip(shared.value.sentences(index, starts), spans):
                    if p >= at_least:
                        rows.append((key, low, high, float(p), text[low:high]))
            if rows:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "sentence_start", "sentence_end", "sentence_score", "sentence"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, sentence_start long, sentence_end long, sentence_score double, sentence string")
