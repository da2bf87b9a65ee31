"""Near-duplicates by SimHash, compared exactly in tiles.

Distinct fingerprints are grouped by the population counts of their four 16-bit quarters and cut into
tiles of bounded size. Two fingerprints within the radius have counts that differ by no more than the
radius in total, so a tile is only paired with tiles of such counts; all other tile pairs are skipped.
A pair of tiles is compared in full with numpy exclusive-or and bit counts. A tile pair reports a
spanning forest of its links instead of every link, which leaves the same components. Copies of a
fingerprint are never compared: they share it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagekit.llm.components import components
from triagekit.llm.structure import words_of
from triagekit.sources.store import materialize

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
TILE = 4096
QUARTERS, QUARTER_BITS = 4, 16
#: Shingles whose hashes are unpacked into bits at a time.
HASHES_AT_ONCE = 1 << 15
A_TO_Z = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: str | None, words_each: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every shingle, repeats included; one of all words where they are fewer, none without words."""
    words = words_of((text or "").encode("utf-8", "surrogatepass").translate(A_TO_Z))
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words_each, len(words))
    pairs = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)


def fingerprint(text: str | None, words_each: int = SHINGLE_WORDS) -> int:
    """Each bit that is set in over half of the shingle hashes, as a signed 64-bit integer."""
    hashes = shingle_hashes(text, words_each)
    ones = np.zeros(64, np.int64)
    for low in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[low : low + HASHES_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_of(text: Column, words_each: int = SHINGLE_WORDS) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words_each) for t in texts], dtype="int64")

    return run(text.cast("string"))


def _counts(fp: Column) -> list[Column]:
    mask = (1 << QUARTER_BITS) - 1
    return [F.bit_count(F.shiftrightunsigned(fp, QUARTER_BITS * q).bitwiseAND(F.lit(mask))) for q in range(QUARTERS)]


def _class(counts: list[Column]) -> Column:
    return sum((c * 17**q for q, c in enumerate(counts)), F.lit(0)).cast("int")


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of quarter counts within the radius, one of each pair of opposites, and none at all."""
    found: list[tuple[int, ...]] = [()]
    for _ in range(QUARTERS):
        found = [(*f, d) for f in found for d in range(-radius, radius + 1) if sum(map(abs, f)) + abs(d) <= radius]
    return [f for f in found if f >= (0,) * QUARTERS]


def _forest(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """Links between two tiles, without those whose ends are joined already."""
    parent = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    step = max(1, (1 << 20) // max(1, len(right)))
    for low in range(0, len(left), step):
        rows = left[low : low + step]
        near = np.bitwise_count(rows[:, None] ^ right[None, :]) <= radius
        for i, j in zip(*np.nonzero(near)):
            if same and j <= low + i:
                continue
            a, b = int(rows[i]), int(right[j])
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[ra] = rb
                out.append((a, b))
    return out


def links(fingerprints: DataFrame, radius: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` that join all distinct ``fp`` within the radius of each other into components."""
    counts = _counts(F.col("fp"))
    classed = fingerprints.select("fp", _class(counts).alias("class"), F.array(*counts).alias("counts"))
    sizes = classed.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / tile).alias("cuts"))  # at most 17^4 rows
    tiles = (
        classed.join(F.broadcast(sizes), "class")
        .groupBy("class", F.pmod(F.xxhash64("fp"), F.col("cuts")).alias("cut"))
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"), F.first("counts").alias("counts"))
    )
    tiles = materialize(tiles, "tiles")
    steps = F.array(*[F.array(*[F.lit(d) for d in o]) for o in _offsets(radius)])
    moved = [F.col("counts")[q] + F.col("step")[q] for q in range(QUARTERS)]
    inside = F.lit(True)
    for m in moved:
        inside = inside & m.between(0, QUARTER_BITS)
    visits = (
        tiles.withColumn("step", F.explode(steps))
        .where(inside)
        .select(_class(moved).alias("class"), F.col("class").alias("from_class"), F.col("cut").alias("from_cut"), F.col("fps").alias("visitors"))
    )
    # Each visitor goes to every tile of the class, so a class with many tiles is many keys.
    visits = visits.join(F.broadcast(sizes), "class").withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))).drop("cuts")
    pairs = tiles.select("class", "cut", "fps").join(visits, ["class", "cut"]).where(
        (F.col("class") != F.col("from_class")) | (F.col("from_cut") <= F.col("cut"))
    )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for same, here, there in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                left, right = (x.values.to_numpy().astype(np.int64).view(np.uint64) for x in (there, here))
                out.extend(_forest(left, right, radius, same))
            ends = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    same = (F.col("class") == F.col("from_class")) & (F.col("cut") == F.col("from_cut"))
    return pairs.select(same.alias("same"), "fps", "visitors").mapInArrow(compare, "a long, b long")


def components_of(fingerprints: DataFrame, radius: int = MAX_BITS) -> DataFrame:
    """``(fp, component)`` for every fingerprint that is linked to another one."""
    return components(links(fingerprints.select("fp").distinct(), radius)).select(F.col("node").alias("fp"), "component")


def classes_of(table: DataFrame, radius: int) -> DataFrame:
    """``(fp, component_id)`` of each distinct fingerprint of a written table with ``doc_id`` and ``fp``."""
    distinct = materialize(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    joined = components_of(distinct, radius)
    named = distinct.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = materialize(named, "named-fingerprints")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(least, "component").select("fp", "component_id")


def near_duplicates(
    docs: DataFrame, words_each: int = SHINGLE_WORDS, radius: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row; a component is named by its least id.

    Null, empty and blank texts have the fingerprint zero and are linked like any others. Repeated rows
    each get a row; null ids never name a component unless it has no other. An empty table gives no
    rows. Other columns are ignored.
    """
    table = materialize(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_of(F.col(text_col), words_each).alias("fp")), "fingerprints"
    )
    return table.join(classes_of(table, radius), "fp").select("doc_id", "fp", "component_id")


def keep_one(
    docs: DataFrame, words_each: int = SHINGLE_WORDS, radius: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each component with all its columns: the one with the least id, and of rows that
    share it the one with the least fingerprint; of rows equal in both, any one.

    A row is known by two hashes of its id and text, so fingerprints are made once and texts move once: the
    choice of rows and the removal of repeated ones use the same partitioning.
    """
    key, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    hashes = [F.xxhash64(F.lit(seed), key.isNull(), key, text.isNull(), text) for seed in (1, 2)]
    table = materialize(
        docs.select(key.alias("doc_id"), hashes[0].alias("h1"), hashes[1].alias("h2"), fingerprint_of(text, words_each).alias("fp")), "fingerprints"
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp", "h1", "h2")).alias("one")
    chosen = table.join(classes_of(table, radius), "fp").groupBy("component_id").agg(first)
    chosen = materialize(chosen.select(F.col("one.h1").alias("h1"), F.col("one.h2").alias("h2")), "chosen-rows")
    names = [f"c{i}" for i in range(len(docs.columns))]
    marked = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], hashes[0].alias("h1"), hashes[1].alias("h2"))
    met = marked.join(chosen, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    return met.select(*names).toDF(*docs.columns)


def hex_digits(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
