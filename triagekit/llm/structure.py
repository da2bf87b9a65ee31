"""Structure statistics of one text; a small helper that runs inside tasks.

Words are runs without blanks, tabs and line ends (ASCII 9 to 13 and 32); a null text has none.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
STOPS = b".!?"
NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
ASCII = bytes(range(128))
#: Bytes that continue a code point.
CONTINUED = bytes(range(0x80, 0xC0))
WIDE_STOPS = frozenset("。！？｡．।॥؟۔።፧။។៕։‼⁇⁈⁉")
#: First and last letters of scripts that put no blanks between words: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han.
UNSPACED = (("\u0e00", "\u109f"), ("\u1780", "\u17ff"), ("\u3040", "\u30ff"), ("\u3400", "\u4dbf"), ("\u4e00", "\u9fff"), ("\uf900", "\ufaff"), ("\U00020000", "\U0003ffff"))
#: Up to this many words, three word numbers fit into one 64-bit integer.
MOST_WORDS_PACKED = 1 << 21


class Structure(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lines: int
    n_upper: int
    n_letters: int
    n_digits: int
    n_stops: int
    n_short: int
    n_distinct: int
    n_bare: int
    #: As n_upper, n_letters, n_stops and n_short, of all scripts and in code points.
    n_capitals: int
    n_alphabetic: int
    n_ends: int
    n_brief: int
    #: n_words, or 0 where most letters are of scripts without blanks between words.
    n_spaced: int


def _count(data: bytes, of: bytes) -> int:
    return len(data) - len(data.translate(None, of))


def words_of(data: bytes) -> list[bytes]:
    """Words of a text in UTF-8."""
    return data.split()  # bytes are split at exactly the blanks above


def repeat_words(codes: np.ndarray, window: int = 3) -> int:
    """How many words lie in a window of words that occurs at least twice in the text."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    key = codes[:n]
    for i in range(1, window):
        if i > 1 and len(codes) >= MOST_WORDS_PACKED:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(codes) + codes[i : i + n]
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(codes), bool)
    for i in range(window):
        covered[i : i + n] |= twice
    return int(covered.sum())


class Beyond(NamedTuple):
    """Counts of what is not ASCII."""

    n_capitals: int
    n_alphabetic: int
    n_ends: int
    n_unspaced: int


def beyond_ascii(data: bytes) -> Beyond:
    found = Counter(data.translate(None, ASCII).decode("utf-8", "surrogatepass"))
    letters = {c: n for c, n in found.items() if c.isalpha()}
    return Beyond(
        sum(n for c, n in letters.items() if c.isupper()),
        sum(letters.values()),
        sum(n for c, n in found.items() if c in WIDE_STOPS),
        sum(n for c, n in letters.items() if any(low <= c <= high for low, high in UNSPACED)),
    )


def brief_beyond_ascii(word: bytes) -> bool:
    """Whether a word of four bytes or more has fewer than four code points."""
    return 4 <= len(word) <= 12 and not word.isascii() and len(word.translate(None, CONTINUED)) < 4


def structure(text: str | None) -> Structure:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = words_of(data)
    n = len(words)
    numbers = dict(zip(words, range(n)))
    codes = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    lines = [line for line in data.split(b"\n") if line.strip(BLANKS)]
    n_upper = _count(data, UPPER)
    bare = {w for w in numbers if not w.translate(None, NO_LETTERS)}
    n_letters = n_upper + _count(data, LOWER)
    n_stops = _count(data, STOPS)
    n_short = sum(map((4).__gt__, map(len, words)))
    other = beyond_ascii(data)
    brief = set() if data.isascii() else set(filter(brief_beyond_ascii, numbers))
    return Structure(
        n_words=n,
        word_chars=len(text) - _count(data, BLANKS),
        n_symbols=_count(data, SYMBOLS),
        n_dup_lines=len(lines) - len(set(lines)),
        n_repeat_words=repeat_words(codes),
        n_lines=len(lines),
        n_upper=n_upper,
        n_letters=n_letters,
        n_digits=_count(data, DIGITS),
        n_stops=n_stops,
        n_short=n_short,
        n_distinct=len(numbers),
        n_bare=sum(map(bare.__contains__, words)) if bare else 0,
        n_capitals=n_upper + other.n_capitals,
        n_alphabetic=n_letters + other.n_alphabetic,
        n_ends=n_stops + other.n_ends,
        n_brief=n_short + (sum(map(brief.__contains__, words)) if brief else 0),
        n_spaced=0 if 2 * other.n_unspaced > n_letters + other.n_alphabetic else n,
    )
