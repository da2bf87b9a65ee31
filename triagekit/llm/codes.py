"""Vector codes by product quantisation, with equal-average search for the nearest entry.

Vectors become integers and are cut into equal consecutive parts; every part position has a codebook of its
own. The search keeps a codebook's entries in the order of their component sums. For a part it starts at the
entry whose sum is next to the part's own and goes outwards on both sides. The squared gap between two sums,
divided by the number of components, never exceeds the squared distance, so a side ends as soon as that
bound is strictly above the best distance so far; at equality an entry of lower index may still win.

Codebooks are small (parts x entries) and live on the driver; vectors are scanned once per round, and what
a task sends is one row of sums per entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagekit.llm.skew import join_by_weight
from triagekit.sources.store import materialize

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components are held within this size divided by the part width, so that no 64-bit sum overflows.
LARGEST = 1 << 28


@dataclass(frozen=True)
class Codebooks:
    """Entries as integers, ``[part, entry, position within part]``."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    @property
    def dimension(self) -> int:
        return self.entries.shape[0] * self.width

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each vector (ties to the lower index) and its squared distance."""
    k, width = entries.shape
    sums = entries.sum(1)
    order = np.argsort(sums, kind="stable")
    ranked, sums = entries[order], sums[order]
    own = vectors.sum(1)
    at = np.searchsorted(sums, own)
    best = np.full(len(vectors), (1 << 62) // width, np.int64)
    found = np.full(len(vectors), k, np.int64)
    for side in (0, -1):
        live, place = np.arange(len(vectors)), at + side
        step = 1 if side == 0 else -1
        while True:
            inside = (place >= 0) & (place < k)
            live, place = live[inside], place[inside]
            gap = sums[place] - own[live]
            near = gap * gap <= best[live] * width
            live, place = live[near], place[near]
            if not len(live):
                break
            apart = vectors[live] - ranked[place]
            distance = np.einsum("ij,ij->i", apart, apart)
            index = order[place]
            better = (distance < best[live]) | ((distance == best[live]) & (index < found[live]))
            won = live[better]
            best[won], found[won] = distance[better], index[better]
            place = place + step
    return found, best


def integers(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of one batch as integers, ``[row, component]``; all have the same length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    limit = LARGEST // width
    return np.clip(np.floor(flat * SCALE), -limit, limit).astype(np.int64).reshape(len(column), -1)


def is_usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def usable(vectors: DataFrame, id_col: str, vector_col: str, dimension: int | None = None) -> DataFrame:
    """``(vec_id, vector)`` and the other columns of rows that can be coded."""
    kept = vectors.withColumn("_vector", F.col(vector_col).cast("array<double>")).where(is_usable(F.col("_vector")))
    return kept.where(F.size("_vector") == dimension if dimension else F.size("_vector") > 0)


def first_entries(vectors: DataFrame, id_col: str, vector_col: str, parts: int, entries: int) -> Codebooks | None:
    """The parts of the vectors with the smallest ids; at most ``entries`` rows reach the driver."""
    kept = usable(vectors, id_col, vector_col).select(F.col(id_col).alias("id"), "_vector")
    ids = [r.id for r in kept.select("id").distinct().orderBy(F.asc_nulls_last("id")).limit(entries).collect()]
    if not ids:
        return None
    named = F.col("id").isin([i for i in ids if i is not None])
    named = named | F.col("id").isNull() if None in ids else named
    rows = {r.id: r.v for r in kept.where(named).groupBy("id").agg(F.min("_vector").alias("v")).collect()}
    dimension = len(rows[ids[0]])
    if dimension % parts:
        raise ValueError(f"vectors of {dimension} components cannot be cut into {parts} equal parts")
    width = dimension // parts
    alike = pa.array([rows[i] for i in ids if len(rows[i]) == dimension], pa.list_(pa.float64()))
    return Codebooks(integers(alike, width).reshape(-1, parts, width).transpose(1, 0, 2).copy())


def _moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry becomes the mean of the parts next to it, rounded down; an entry without parts stays."""
    parts, k, width = books.entries.shape
    names = [f"s{i}" for i in range(width)]
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64())] + [(s, pa.int64()) for s in names])

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, k), np.int64)
        sums = np.zeros((parts, k, width), np.int64)
        for batch in batches:
            rows = integers(batch.column(0), width)
            for p in range(parts):
                piece = rows[:, p * width : (p + 1) * width]
                entry, _ = nearest(piece, books.entries[p])
                count[p] += np.bincount(entry, minlength=k)
                for i in range(width):  # sums of one batch are exact as doubles
                    sums[p, :, i] += np.bincount(entry, piece[:, i], k).astype(np.int64)
        part, entry = np.nonzero(count)
        columns = [part.astype(np.int32), entry.astype(np.int32), count[part, entry], *sums[part, entry].T]
        yield pa.record_batch([pa.array(c) for c in columns], schema=schema)

    found = vectors.select("_vector").mapInArrow(partial, "part int, entry int, n long, " + ", ".join(f"{s} long" for s in names))
    entries = books.entries.copy()
    for r in found.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect():  # one row per entry
        entries[r.part, r.entry] = [r[s] // r.n for s in names]
    return Codebooks(entries)


def fit_codebooks(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> Codebooks | None:
    """Codebooks after ``rounds`` of assigning all parts and moving the entries; None if no vector is usable."""
    books = first_entries(vectors, id_col, vector_col, parts, entries)
    if books is not None:
        rows = usable(vectors, id_col, vector_col, books.dimension)
        for _ in range(rounds):
            books = _moved(rows, books)
    return books


def encode_vectors(
    vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", keep: Iterable[str] = ()
) -> DataFrame:
    """``vec_id, *keep, code binary, error``: one byte per part, and the squared distances added up.

    Books of more than 256 entries have no code. See ``compress_vectors`` for rows that are dropped.
    """
    parts, k, width = books.entries.shape
    if k > 256:
        raise ValueError("a code byte holds 256 entries at most")
    keep = list(keep)

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = integers(batch.column(0), width)
            codes, error = np.zeros((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
            for p in range(parts):
                entry, distance = nearest(rows[:, p * width : (p + 1) * width], books.entries[p])
                codes[:, p] = entry
                error += distance
            made = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(batch.columns[1:] + made, names=[*batch.schema.names[1:], "code", "error"])

    rows = usable(vectors, id_col, vector_col, books.dimension).select("_vector", F.col(id_col).alias("vec_id"), *keep)
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]
    return rows.mapInArrow(code, ", ".join([*types, "code binary", "error long"]))


def compress_vectors(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of every usable vector.

    Dropped: null and empty vectors, vectors with a null or non-finite component, and those whose length is not
    that of the usable vector with the smallest id (its length must be a multiple of ``parts``, else ValueError).
    A scaled component beyond 2^28 / part width counts as that bound. Start entries come from the smallest
    distinct ids (null last; of repeated ids the least vector); fewer ids give smaller codebooks. Repeated rows
    and null ids are coded like any others. ``label_error`` adds up the errors of equal labels, nulls together.
    No usable vector gives no rows. Other columns are ignored, whatever their names.
    """
    vectors = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label")
    )
    books = fit_codebooks(vectors, parts, entries, rounds)
    if books is None:
        types = f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}, code binary, error long"
        return vectors.sparkSession.createDataFrame([], types + ", label_error long, codebooks_sha256 string")
    coded = materialize(encode_vectors(vectors, books, keep=["label"]), "codes")
    sums = materialize(coded.groupBy("label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error")), "code-errors")
    total = sums.agg(F.sum("n")).first()[0] or 0
    return join_by_weight(coded, sums, ["label"], total).withColumn("codebooks_sha256", F.lit(books.sha256()))
