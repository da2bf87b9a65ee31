"""Packing of token lists into sequences of a fixed length.

Each partition keeps a fixed number of open windows. A document gives whole windows while it is long
enough; what is left goes to the open window with the smallest sufficient gap. When none is large
enough, the fullest window is closed: as texts may be cut, its gap takes the head of the document, so
that it needs no padding. The open windows that partitions leave behind go through the same packer
again, in ever fewer partitions; the last one joins what is left into full windows and cuts the
remainder at powers of two, lengths that need no padding. Windows carry ids only while they are open.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagekit.llm.encode import encoder
from triagekit.sources.store import materialize

ID_BYTES = 4
#: Partitions whose leftovers meet in one task of the next round.
FAN_IN = 16

PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "part int, ids binary"
)
ARROW_SCHEMA = pa.schema(
    [(n, pa.int64()) for n in "doc_id start length ids_crc32 doc_tokens sequence_id offset".split()]
    + [("part", pa.int32()), ("ids", pa.binary())]
)
RESULT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@dataclass
class Piece:
    """A stretch of a document's ids."""

    doc_id: int | None
    start: int
    doc_tokens: int
    ids: memoryview

    @property
    def length(self) -> int:
        return len(self.ids) // ID_BYTES

    def split(self, n: int) -> tuple[Piece, Piece]:
        cut = n * ID_BYTES
        return (
            Piece(self.doc_id, self.start, self.doc_tokens, self.ids[:cut]),
            Piece(self.doc_id, self.start + n, self.doc_tokens, self.ids[cut:]),
        )


@dataclass
class Window:
    number: int
    gap: int
    pieces: list[Piece] = field(default_factory=list)

    def put(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.gap -= piece.length


class Packer:
    """Bounded-space best fit: at most ``open_windows`` windows are held at any time."""

    def __init__(self, size: int, open_windows: int):
        self.size, self.limit = size, open_windows
        self.made = 0
        self.windows: list[tuple[int, int]] = []  # (gap, number), ascending
        self.by_number: dict[int, Window] = {}

    def _new(self) -> Window:
        self.made += 1
        return Window(self.made - 1, self.size)

    def _keep(self, window: Window) -> None:
        self.by_number[window.number] = window
        bisect.insort(self.windows, (window.gap, window.number))

    def _take(self, at: int) -> Window:
        return self.by_number.pop(self.windows.pop(at)[1])

    def add(self, piece: Piece) -> Iterator[Window]:
        """Place a piece; yields the windows that it fills."""
        while piece.length:
            if piece.length >= self.size:
                window = self._new()
                head, piece = piece.split(self.size)
                window.put(head)
                yield window
                continue
            at = bisect.bisect_left(self.windows, (piece.length, -1))
            if at < len(self.windows):
                window = self._take(at)
                window.put(piece)
                if window.gap:
                    self._keep(window)
                else:
                    yield window
                return
            if len(self.windows) < self.limit:
                window = self._new()
                window.put(piece)
                self._keep(window)
                return
            window = self._take(0)
            head, piece = piece.split(window.gap)
            window.put(head)
            yield window

    def rest(self) -> list[Window]:
        """The windows that are still open, the fullest first."""
        return [self.by_number[n] for _, n in self.windows]

    def join_rest(self) -> Iterator[Window]:
        """All that is open, cut into full windows, then into lengths that are powers of two."""
        left = sum(self.size - gap for gap, _ in self.windows)
        sizes = [self.size] * (left // self.size)
        sizes += [1 << b for b in range(left.bit_length(), -1, -1) if (left % self.size) >> b & 1]
        pieces = [p for w in self.rest() for p in w.pieces][::-1]
        for size in sizes:
            window = Window(self.made, size)
            self.made += 1
            while window.gap:
                piece = pieces.pop()
                if piece.length > window.gap:
                    piece, later = piece.split(window.gap)
                    pieces.append(later)
                window.put(piece)
            yield window


def _rows(window: Window, base: int, part: int, still_open: bool) -> Iterator[tuple]:
    offset = 0
    for p in window.pieces:
        ids = bytes(p.ids)
        yield (
            p.doc_id, p.start, p.length, zlib.crc32(ids), p.doc_tokens, base + window.number, offset,
            part if still_open else None, ids if still_open else None,
        )
        offset += p.length


def _batches(rows: Iterable[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), ARROW_SCHEMA.types)], schema=ARROW_SCHEMA)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held = []
    if held:
        yield batch()


def _pack_partition(pieces: Iterable[Piece], size: int, open_windows: int, round_no: int, last: bool) -> Iterator[tuple]:
    part = TaskContext.get().partitionId()
    base = (round_no << 52) + (part << 32)
    packer = Packer(size, open_windows)
    for piece in pieces:
        for window in packer.add(piece):
            yield from _rows(window, base, part, False)
    for window in packer.join_rest() if last else packer.rest():
        yield from _rows(window, base, part, not last)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, open_windows: int = 64,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece of a document: where it lies in its document and in its sequence.

    ``size`` is a power of two. A null or empty text is just the end id. Repeated rows and null ids are
    packed like any others, each row on its own. An empty table gives no rows. Other columns are ignored.
    """
    if size & (size - 1) or size < 1:
        raise ValueError("the sequence length must be a power of two")
    end = end_id.to_bytes(ID_BYTES, "little")

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode

        def pieces() -> Iterator[Piece]:
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                    whole = memoryview(ids + end)
                    yield Piece(doc_id, 0, len(whole) // ID_BYTES, whole)

        return _batches(_pack_partition(pieces(), size, open_windows, 0, False))

    def again(round_no: int, last: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def pieces() -> Iterator[Piece]:
                for batch in batches:
                    for doc_id, start, tokens, ids in zip(*(c.to_pylist() for c in batch.columns)):
                        yield Piece(doc_id, start, tokens, memoryview(ids))

            return _batches(_pack_partition(pieces(), size, open_windows, round_no, last))

        return run

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = materialize(source.mapInArrow(first, PIECE_SCHEMA), "packed")
    done = [table.where(F.col("part").isNull())]
    parts = (table.agg(F.max("part")).first()[0] or 0) + 1
    round_no = 0
    while True:
        round_no += 1
        parts = -(-parts // FAN_IN)
        last = parts == 1
        left = (
            table.where(F.col("part").isNotNull())
            .repartition(parts, F.floor(F.col("part") / FAN_IN))
            .sortWithinPartitions("sequence_id", "offset")
            .select("doc_id", "start", "doc_tokens", "ids")
        )
        table = materialize(left.mapInArrow(again(round_no, last), PIECE_SCHEMA), "packed-rest")
        done.append(table.where(F.col("part").isNull()))
        if last:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*RESULT)
