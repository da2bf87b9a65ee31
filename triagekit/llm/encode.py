"""Token ids of whole texts with a tokenizer file, at the speed of a dictionary.

A byte-level tokenizer starts a new piece at every blank that a non-blank follows, and takes line ends apart
from what stands beside them. So a text is cut there, and its ids are those of its pieces. A group of texts is
cut and its distinct pieces are found by Arrow; each distinct piece is looked up once and the ids are put in
their places by numpy. A piece is mostly a word of letters with marks behind it, whose ids are those of the word
and of the marks; words recur, so a worker keeps those that it has met lately. Texts with other blanks are cut
only at places that are sure, and a tokenizer of another kind gets whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker keeps of each of two generations, and bytes of texts that are encoded together.
KEPT_WORDS = 400_000
GROUP_BYTES = 8_000_000
#: Longer words are not kept.
LONG_WORD = 100
BEFORE_WORD = re.compile(r" (?=\S)")
#: A word of Latin letters and the marks behind it are two pieces for a byte-level tokenizer.
LETTERS = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+")
MARKS = ".,;:!?#$%&*|"
BLANK = "\u0120"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: printable ones stand
    for themselves, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LETTERS = byte_letters()

_encoders: dict[str, IdEncoder] = {}


def encoder(path: str) -> IdEncoder:
    """The encoder of this worker for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = IdEncoder(path)
    return _encoders[path]


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def cuts_at_blanks(spec: dict) -> bool:
    """Whether ids of a text are those of its pieces, for a tokenizer with this description."""
    pre = spec.get("pre_tokenizer") or {}
    plain_added = all(
        not any(c.isspace() for c in t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])
        for t in spec["added_tokens"]
    )
    byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    return bool(spec["normalizer"] is None and byte_level and plain_added)


class Recent:
    """Results of ``make`` by key; when a generation of keys is full, those not asked for since the one before are lost."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        self.make, self.limit = make, limit
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def get(self, key: str) -> bytes:
        found = self.now.get(key)
        if found is None:
            found = self.before.get(key)
            if found is None:
                found = self.make(key)
            if len(self.now) >= self.limit:
                self.before, self.now = self.now, {}
            if len(key) <= LONG_WORD:
                self.now[key] = found
        return found


class IdEncoder:
    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        spec = json.loads(self.tokenizer.to_str())
        self.by_piece = cuts_at_blanks(spec)
        self.added = tuple(t["content"] for t in spec["added_tokens"])
        self.model = self.tokenizer.model
        #: Words of letters after a blank, words of letters after something else, and all other texts.
        self.words = {" ": Recent(lambda w: self._word(BLANK, w), KEPT_WORDS), "": Recent(lambda w: self._word("", w), KEPT_WORDS // 4)}
        self.others = Recent(lambda text: self._encode([text])[0], KEPT_WORDS // 10)

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _word(self, before: str, word: str) -> bytes:
        """Ids of a word of letters, which the tokenizer would not cut further."""
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(before + letters)]).tobytes()

    def _plain(self, before: str, piece: str) -> bytes | None:
        """Ids of a word of letters with marks; None if it is something else."""
        word = piece.rstrip(MARKS)
        if not LETTERS.fullmatch(word):
            return None
        ids = self.words[before].get(word)
        return ids + self.others.get(piece[len(word) :]) if len(word) < len(piece) else ids

    def _piece(self, before: str, piece: str) -> bytes | None:
        """Ids of what stands after a blank, a line end (which it begins with) or nothing; None if it is empty or holds blanks.

        An added token is cut out of a text before line ends are, so what it stands next to may be cut otherwise.
        """
        if piece == "\n":
            return self.others.get(piece)
        if piece.startswith("\n"):
            ids = None if any(a in piece for a in self.added) else self._piece("", piece[1:])
            return None if ids is None else self.others.get("\n") + ids
        ids = self._plain(before, piece)
        if ids is None and piece and not any(c.isspace() for c in piece):
            return self.others.get(before + piece)
        return ids

    def _pieces(self, pieces: list[str]) -> list[bytes | None]:
        """Ids of pieces after a blank or a line end."""
        known, marks, out = self.words[" "].now.get, self.others, []
        for piece in pieces:
            word = piece.rstrip(MARKS)
            ids = known(word)
            if ids is None:
                ids = self._piece(" ", piece)
            elif len(word) < len(piece):
                ids = ids + marks.get(piece[len(word) :])
            out.append(ids)
        return out

    def _loose(self, text: str) -> bytes:
        """Ids of a text with blanks of all kinds, cut before words only."""
        pieces = BEFORE_WORD.split(text)
        ids = self._encode(pieces[:1])
        for piece in pieces[1:]:
            found = self._plain(" ", piece)
            ids.append(self.others.get(" " + piece) if found is None else found)
        return b"".join(ids)

    def encode(self, texts: pa.Array | Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text is empty."""
        column = texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.string())
        column = column.fill_null("")
        size = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < len(column):
            before = size[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(size, before + GROUP_BYTES, "right")))
            yield from self._group(column.slice(low, high - low))
            low = high

    def _group(self, texts: pa.Array) -> list[bytes]:
        if not self.by_piece:
            return self._encode(texts.to_pylist())
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        starts = cut.offsets.to_numpy()
        starts, all_pieces = starts - starts[0], cut.flatten()
        numbered = all_pieces.dictionary_encode()
        number = numbered.indices.to_numpy().astype(np.int64)
        listed = pa.ListArray.from_arrays([0, len(numbered.dictionary)], numbered.dictionary)
        distinct = pc.binary_join(listed, " ")[0].as_py().split(" ")
        ids = self._pieces(distinct)
        odd = np.array([x is None for x in ids])[number]
        odd[starts[:-1]] = False  # the first piece of a text follows no blank
        alone = number == (distinct.index("\n") if "\n" in distinct else -1)
        odd[1:] |= alone[1:] & alone[:-1]  # line ends in a row belong together, but for one before a word
        heads = [self._piece("", h) if h else b"" for h in all_pieces.take(pa.array(starts[:-1])).to_pylist()]
        loose = np.logical_or.reduceat(odd, starts[:-1]) | np.array([h is None for h in heads])
        number[starts[:-1]] = np.arange(len(ids), len(ids) + len(heads))
        ids = [x or b"" for x in ids + heads]

        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        ends = np.cumsum(lengths)
        pool, taken = np.frombuffer(b"".join(ids), np.uint32), lengths[number]
        until = np.cumsum(taken)
        shift = np.repeat((ends - lengths)[number] - (until - taken), taken)
        found = pool[shift + np.arange(len(shift))]
        bounds = np.concatenate([[0], until])[starts].tolist()
        return [
            self._loose(texts[i].as_py()) if x else found[a:b].tobytes() for i, (x, a, b) in enumerate(zip(loose.tolist(), bounds, bounds[1:]))
        ]
