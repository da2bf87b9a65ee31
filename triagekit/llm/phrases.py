"""Document fingerprints by locally consistent parsing.

A text is parsed into ever longer phrases. At each level equal neighbours are joined into one symbol,
deterministic coin tossing turns the names of neighbours into a few labels (the place and value of the
lowest bit in which a name differs from its left neighbour, repeated until labels are below eight), and
every local minimum of the labels starts a phrase. Where a phrase starts depends on a few neighbours
only, so equal substrings are cut in the same way inside, wherever they stand, and their phrases have
equal names. The last level has one phrase: the name of the text.

The fingerprint is that name followed by a sketch of the phrase names from ``FIRST_LEVEL`` up: each name
falls into one of ``SLOTS`` slots and the least of a slot is kept, where a level's names count less the
more of them there are. The likeness of two fingerprints is the share of slots with equal content.

All texts of a group are parsed at once, as one array in which no phrase crosses from text to text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 64
SLOT_DIGITS = 3
EMPTY = "." * SLOT_DIGITS
FIRST_LEVEL = 2
#: About how many symbols of a level make one of the next; evens out what levels count.
SHRINK = 3.0
TOSSES = 4
GROUP_CHARS = 1_000_000
#: Ranges of ids for each task; more of them even out what tasks get.
RANGES_PER_TASK = 4
NO_ID = -(1 << 63)

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, which maps 64-bit names one to one."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _tossed(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below eight, different for neighbours of the same text. ``first`` marks starts of texts."""
    labels = names
    for _ in range(TOSSES):
        left = np.empty_like(labels)
        left[1:] = labels[:-1]
        left[first] = labels[first] ^ labels.dtype.type(1)
        differ = labels ^ left
        lowest = np.bitwise_count((differ & (~differ + differ.dtype.type(1))) - differ.dtype.type(1)).astype(np.uint8)
        value = (labels >> lowest.astype(labels.dtype)).astype(np.uint8) & np.uint8(1)
        labels = 2 * lowest + value
    return labels


def _runs_joined(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    if new.all():
        return names, owner
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(names))).astype(np.uint64)
    kept = names[at]
    return np.where(length > 1, _mix(kept + length * _M3), kept), owner[at]


def _next_level(names: np.ndarray, owner: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    names, owner = _runs_joined(names, owner)
    first = np.ones(len(names), bool)
    first[1:] = owner[1:] != owner[:-1]
    labels = _tossed(names, first)
    lower = np.zeros(len(names), bool)
    lower[1:-1] = (labels[1:-1] < labels[:-2]) & (labels[1:-1] < labels[2:])
    last = np.roll(first, -1)
    starts = np.flatnonzero(first | (lower & ~last))
    length = np.diff(np.append(starts, len(names)))
    place = (np.arange(len(names)) - np.repeat(starts, length)).astype(np.uint64)
    salted = _mix(names + (place + np.uint64(1)) * _M3)
    whole = np.add.reduceat(salted, starts)
    return _mix(whole ^ (length.astype(np.uint64) << np.uint64(8)) ^ np.uint64(level)), owner[starts]


def parse(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Phrases of each level from 1 up: level, names, and the number of the text of each phrase.

    A text takes part until it is a single phrase; an empty one has none.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    names, owner = _mix(points.astype(np.uint64) + _M3), np.repeat(np.arange(len(texts)), sizes)
    level = 0
    while len(names):
        level += 1
        names, owner = _next_level(names, owner, level)
        yield level, names, owner
        alone = np.bincount(owner, minlength=len(texts))[owner] == 1
        names, owner = names[~alone], owner[~alone]


def fingerprints(texts: list[str]) -> list[str]:
    """Name (16 hexadecimal digits) and sketch of each text; equal for equal texts.

    A text too short for a phrase of ``FIRST_LEVEL`` is sketched by its phrases of any level.
    """
    root = np.zeros(len(texts), np.uint64)
    levels = []
    top = np.zeros(len(texts), np.int64)
    for level, names, owner in parse(texts):
        root[owner] = names
        top[owner] = level
        levels.append((level, names, owner))
    slots = np.full(len(texts) * SLOTS, np.inf)
    held = np.zeros(len(texts) * SLOTS, np.uint64)
    for level, names, owner in levels:
        use = top[owner] >= FIRST_LEVEL
        if level < FIRST_LEVEL:
            use = ~use
        names, owner = names[use], owner[use]
        drawn = _mix(names ^ _M1)
        slot = owner * SLOTS + (drawn >> np.uint64(58)).astype(np.int64)
        rank = ((drawn & np.uint64((1 << 52) - 1)).astype(float) + 1) / SHRINK**level
        order = np.lexsort((rank, slot))
        slot, rank, names = slot[order], rank[order], names[order]
        one = np.ones(len(slot), bool)
        one[1:] = slot[1:] != slot[:-1]
        slot, rank, names = slot[one], rank[one], names[one]
        better = rank < slots[slot]
        slots[slot[better]] = rank[better]
        held[slot[better]] = names[better]
    digits = held & np.uint64(16**SLOT_DIGITS - 1)
    out = []
    for i in range(len(texts)):
        own = slice(i * SLOTS, (i + 1) * SLOTS)
        sketch = "".join(EMPTY if np.isinf(r) else f"{d:0{SLOT_DIGITS}x}" for r, d in zip(slots[own], digits[own].tolist()))
        out.append(f"{int(root[i]):016x}{sketch}")
    return out


def likeness(a: str, b: str) -> float:
    """Share of the slots used by either text that hold the same; 1 for equal texts, empty ones included."""
    if a == b:
        return 1.0
    pairs = [(a[i : i + SLOT_DIGITS], b[i : i + SLOT_DIGITS]) for i in range(16, len(a), SLOT_DIGITS)]
    used = [(x, y) for x, y in pairs if x != EMPTY or y != EMPTY]
    return sum(x == y for x, y in used) / len(used) if used else 0.0


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the beginning of the following one."""
    cut = len(text) // 2
    return text[: len(text) - cut] + following[:cut]


def _groups(pairs: Iterable[tuple]) -> Iterator[list[tuple]]:
    held, chars = [], 0
    for pair in pairs:
        held.append(pair)
        chars += len(pair[1])
        if chars >= GROUP_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)`` per row, in place; a null text is empty. Other columns are ignored."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, t or "") for b in batches for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for group in _groups(rows):
            found = fingerprints([t for _, t in group])
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in group], pa.int64()), pa.array(found)], names=["doc_id", "fingerprint"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, fingerprint string")


EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike it is to that and to the next text.

    The next text is that of the next id in ascending order, of the first one after the last. Null ids
    come first; rows with equal ids follow each other by their texts. A null text is empty. An only row
    is followed by itself; an empty table gives no rows. Other columns are ignored.

    Texts move once, into ranges of ids. A range needs one more text, the first of the next range, so
    those rows are sent to two ranges; there are as many as ranges.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = RANGES_PER_TASK * tasks
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    shares = [i / ranges for i in range(1, ranges)]
    found = source.agg(F.percentile_approx("doc_id", shares, 100 * ranges).alias("cuts")).first()["cuts"]
    cuts = spark.sparkContext.broadcast(np.unique(np.array(found or [], np.int64)))  # fewer than ranges

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts.value, ids.to_numpy(np.int64)), dtype="int32")

    ranged = source.withColumn("range", range_of(F.coalesce("doc_id", F.lit(NO_ID))))
    least = ranged.groupBy("range").agg(F.min(F.struct("doc_id")).alias("least")).orderBy("range").collect()  # one row per range
    firsts = spark.createDataFrame(
        [(r["least"]["doc_id"], least[i - 1]["range"]) for i, r in enumerate(least)], "first_id long, previous int"
    )
    own = F.struct("range", F.lit(False).alias("tail"))
    spots = F.when(F.col("previous").isNull(), F.array(own)).otherwise(
        F.array(own, F.struct(F.col("previous").alias("range"), F.lit(True).alias("tail")))
    )
    placed = (
        ranged.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
        .select("doc_id", "text", F.explode(spots).alias("spot"))
        .select("spot.range", "spot.tail", "doc_id", "text")
        .repartition(tasks, "range")
        .sortWithinPartitions("range", "tail", "doc_id", "text")
    )

    def followed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        held = None
        for batch in batches:
            for at, tail, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0] == at:
                    yield held[1], held[2], text
                # Of several rows that share the first id of the next range, only the first follows.
                held = None if tail else (at, key, text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(followed(batches)):
            texts = [t for _, t, _ in group]
            changed = [edited(t, n) for _, t, n in group]
            found = fingerprints(texts)
            changed_found = fingerprints(changed)
            # The next text is that of the next row, except at the end of a range or a group.
            ends = [i for i, (_, _, n) in enumerate(group) if i + 1 == len(group) or n != texts[i + 1]]
            nexts = found[1:] + [""]
            for i, f in zip(ends, fingerprints([group[i][2] for i in ends])):
                nexts[i] = f
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, *_ in group], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                    pa.array(found),
                    pa.array(changed_found),
                    pa.array([likeness(a, b) for a, b in zip(found, changed_found)], pa.float64()),
                    pa.array([likeness(a, b) for a, b in zip(found, nexts)], pa.float64()),
                ],
                names=[c.split(" ")[0] for c in EDITED.split(", ")],
            )

    return placed.mapInArrow(run, EDITED)
