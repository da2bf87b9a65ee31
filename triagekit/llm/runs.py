"""Periodic runs of words, found on a Re-Pair grammar of each text.

Word numbers are compressed by Re-Pair: the pair that occurs most often becomes a new symbol until no pair
occurs twice. Where pairs are equally frequent, the one seen first goes first, which keeps the grammar of a
repeated passage balanced. What is left of the text is joined by a balanced tree. A run lies within some node
of these trees and crosses the boundary between the node's two children, so it is enough to compute, once per
nonterminal, the runs across its boundary, to translate them to every place where the nonterminal is derived,
and to merge intervals of equal period that overlap by a period or more.

A run repeats its period four times or more, so each of its word pairs occurs three times or more within it;
the grammar is built for the stretches in which all pairs do, and for most texts there is none.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagekit.llm.structure import words_of

LEAST_LENGTH, LEAST_REPEATS = 6, 4
#: Rounds that take out pairs which occur fewer than three times in their stretch; more would change no result.
PRUNING_ROUNDS = 12
ENDS = -1


class Run(NamedTuple):
    start: int
    length: int
    period: int


class Grammar:
    """Re-Pair grammar of stretches of one sequence.

    ``rules[x - base]`` is ``(left, right, size, at)``: the children of symbol ``x``, how many words it derives,
    and one place where it is derived. ``rest`` holds for each stretch the symbols that are left, as (symbol, place).
    """

    def __init__(self, ids: list[int], stretches: list[tuple[int, int]], base: int):
        self.base = base
        self.rules: list[tuple[int, int, int, int]] = []
        symbol, after, before = ids[:], list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        places: dict[tuple[int, int], list[int]] = {}
        for low, high in stretches:
            before[low], after[high - 1] = ENDS, ENDS
            for i in range(low, high - 1):
                places.setdefault((ids[i], ids[i + 1]), []).append(i)
        queue = [(-len(at), n, pair) for n, (pair, at) in enumerate(places.items()) if len(at) > 1]
        heapq.heapify(queue)
        made = len(places)
        while queue:
            count, n, pair = heapq.heappop(queue)
            left, right = pair
            now, end = [], -1  # places where the pair still stands, without overlaps
            for i in places[pair]:
                if symbol[i] == left and i >= end and (j := after[i]) != ENDS and symbol[j] == right:
                    now.append(i)
                    end = j + 1
            if len(now) < 2:
                continue
            if len(now) < -count:
                places[pair] = now
                heapq.heappush(queue, (-len(now), n, pair))
                continue
            new = base + len(self.rules)
            self.rules.append((left, right, self.size(left) + self.size(right), now[0]))
            fresh: dict[tuple[int, int], list[int]] = {}
            for i in now:
                j = after[i]
                k, h = after[j], before[i]
                symbol[i], symbol[j], after[i] = new, ENDS, k
                if k != ENDS:
                    before[k] = i
                    fresh.setdefault((new, symbol[k]), []).append(i)
                if h != ENDS:
                    fresh.setdefault((symbol[h], new), []).append(h)
            for met, at in fresh.items():
                if len(at) > 1:
                    places[met] = at
                    heapq.heappush(queue, (-len(at), made, met))
                    made += 1
        self.rest = []
        for low, _ in stretches:
            line, i = [], low
            while i != ENDS:
                line.append((symbol[i], i))
                i = after[i]
            self.rest.append(line)

    def size(self, symbol: int) -> int:
        return 1 if symbol < self.base else self.rules[symbol - self.base][2]


class Neighbours:
    """Where the word pair at each place occurs next and before, within its stretch."""

    def __init__(self, pairs: np.ndarray, kept: np.ndarray):
        n = len(pairs)
        at = np.flatnonzero(kept)
        order = at[np.argsort(pairs[at], kind="stable")]
        same = pairs[order[1:]] == pairs[order[:-1]]
        following, preceding = np.full(n, n + 1, np.int64), np.full(n, -1, np.int64)
        following[order[:-1][same]] = order[1:][same]
        preceding[order[1:][same]] = order[:-1][same]
        self.following, self.preceding = following.tolist(), preceding.tolist()


def _reach(words: np.ndarray, listed: list[int], x: int, period: int, stop: int, step: int) -> int:
    """The first place from ``x`` on, in the direction of ``step``, whose word is not that a period later."""
    for _ in range(8):
        if x == stop or listed[x] != listed[x + period]:
            return x
        x += step
    width = 32
    while x != stop:
        if step > 0:
            high = min(stop, x + width)
            differ = words[x:high] != words[x + period : high + period]
        else:
            low = max(stop + 1, x + 1 - width)
            high = x + 1
            differ = (words[low:high] != words[low + period : high + period])[::-1]
        first = int(differ.argmax()) if len(differ) else 0
        if len(differ) and differ[first]:
            return x + step * first
        x += step * len(differ)
        width *= 2
    return x


def crossing(words: np.ndarray, listed: list[int], near: Neighbours, low: int, high: int, mid: int) -> list[tuple[int, int, int]]:
    """Runs ``(start, end, period)`` within ``[low, high)`` across the boundary before ``mid``.

    Such a run holds two periods on one side at least, so the pair at the boundary stands again one period away.
    """
    found: list[tuple[int, int, int]] = []
    if high - low < LEAST_LENGTH:
        return found
    at = mid - 1
    following, preceding = near.following, near.preceding
    ahead, back = following[at], preceding[at]
    while True:
        to_right, to_left = ahead - at, at - back if back >= 0 else high
        right_fits, left_fits = mid + 2 * to_right <= high, mid - 2 * to_left >= low
        if right_fits and (to_right <= to_left or not left_fits):
            period, first, ahead = to_right, at, following[ahead]
            span = (at, mid + 2 * period)
        elif left_fits:
            period, first, back = to_left, at - to_left, preceding[back]
            span = (mid - 2 * period, mid + 1)
        else:
            return found
        # The run must cover the span; where a run of a smaller period does, this period only repeats it.
        if any(period % q == 0 and s <= span[0] and e >= span[1] for s, e, q in found):
            continue
        end = _reach(words, listed, first, period, high - period, 1)
        start = _reach(words, listed, first, period, low - 1, -1) + 1
        if end + period - start >= max(LEAST_LENGTH, LEAST_REPEATS * period):
            run = (start, end + period, period)
            if not any(period % q == 0 and s <= start and e >= run[1] for s, e, q in found):
                found.append(run)


def stretches_of(ids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Stretches of words whose adjacent pairs all occur three times or more in the stretch.

    Also a number for each pair, equal for equal pairs of one stretch, and which pairs are in a stretch.
    """
    pairs = ids[:-1] * (int(ids.max()) + 1) + ids[1:]
    kept = np.ones(len(pairs), bool)
    for _ in range(PRUNING_ROUNDS):
        _, pairs, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        often = kept & (counts[pairs] >= 3)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], often.astype(np.int8), [0]])))
        short = (edge[1::2] - edge[::2]) < LEAST_LENGTH - 1
        for a, b in zip(edge[::2][short].tolist(), edge[1::2][short].tolist()):
            often[a:b] = False
        edge = edge.reshape(-1, 2)[~short]
        if not len(edge) or (often == kept).all():
            break
        kept = often
        number = np.zeros(len(pairs), np.int64)
        number[edge[:, 0]] = 1
        number = np.cumsum(number)
        pairs = np.where(kept, (pairs + 1) * (len(edge) + 1) + number, -1 - np.arange(len(pairs)))
    return [(a, b + 1) for a, b in edge.tolist()], pairs, kept


def find_runs(ids: np.ndarray) -> list[Run]:
    """All runs of a sequence of word numbers, by start, then period.

    A run is a stretch with smallest period q and at least max(6, 4 q) words that no neighbour extends.
    """
    if len(ids) < LEAST_LENGTH:
        return []
    stretches, pairs, kept = stretches_of(ids)
    if not stretches:
        return []
    listed = ids.tolist()
    near = Neighbours(pairs, kept)
    base = int(ids.max()) + 1
    grammar = Grammar(listed, stretches, base)
    own = [crossing(ids, listed, near, at, at + size, at + grammar.size(left)) for left, _, size, at in grammar.rules]
    holds = [bool(r) for r in own]  # whether the symbol or one below it has runs
    for x, (left, right, _, _) in enumerate(grammar.rules):
        holds[x] = holds[x] or any(c >= base and holds[c - base] for c in (left, right))

    intervals: set[tuple[int, int, int]] = set()  # (period, start, end)
    for line in grammar.rest:
        below = [(symbol, at) for symbol, at in line]
        while below:
            symbol, at = below.pop()
            if symbol < base or not holds[symbol - base]:
                continue
            left, right, _, made = grammar.rules[symbol - base]
            intervals.update((q, s - made + at, e - made + at) for s, e, q in own[symbol - base])
            below += [(left, at), (right, at + grammar.size(left))]
        starts = [at for _, at in line] + [line[-1][1] + grammar.size(line[-1][0])]
        spans = [(0, len(line))]
        while spans:
            a, b = spans.pop()
            if b - a < 2 or starts[b] - starts[a] < LEAST_LENGTH:
                continue
            mid = (a + b) // 2
            intervals.update((q, s, e) for s, e, q in crossing(ids, listed, near, starts[a], starts[b], starts[mid]))
            spans += [(a, mid), (mid, b)]

    merged: list[list[int]] = []
    for q, s, e in sorted(intervals):
        if merged and merged[-1][0] == q and s + q <= merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([q, s, e])
    return sorted(Run(s, e - s, q) for q, s, e in merged)


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period; of ties the one that starts first, then the smaller period."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run.length * best.period > best.length * run.period:
            best = run
    return best


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that are in no run, or in the first period of every run that they are in."""
    if not runs:
        return words
    dropped = np.zeros(len(words), bool)
    for run in runs:
        dropped[run.start + run.period : run.start + run.length] = True
    return [words[i] for i in np.flatnonzero(~dropped).tolist()]


def numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


RUN = "struct<start: bigint, length: bigint, period: bigint>"


def periodic_runs(
    docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_words, runs, longest, collapsed`` per row: all runs, the strongest one and the text without repeats.

    Words are what stands between ASCII blanks and line ends; ``rewrite`` may change a text's words first.
    ``collapsed`` joins the words that are kept by one space. A null, empty or blank text has no words, no runs, a
    null ``longest`` and an empty ``collapsed``. Repeated rows and null ids get a row each, an empty table none.
    Other columns are ignored. A text is worked on by one task, in memory and time near-linear in its length.
    """
    fields = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]
    run_type = pa.struct(fields)
    types = [pa.int64(), pa.int64(), pa.list_(run_type), run_type, pa.string()]
    names = ["doc_id", "n_words", "runs", "longest", "collapsed"]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_buffer().to_pybytes()) if text.is_valid else []
                words = rewrite(doc_id, words) if rewrite else words
                runs = find_runs(numbered(words))
                best = strongest(runs)
                row = (doc_id, len(words), [r._asdict() for r in runs], best and best._asdict(), b" ".join(collapse(words, runs)).decode())
                for column, value in zip(columns, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(scan, f"doc_id long, n_words long, runs array<{RUN}>, longest {RUN}, collapsed string")
