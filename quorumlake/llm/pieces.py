"""Splitting texts into tokenizer pieces with whole-array operations, and a table of the pieces met so far.

All functions here work inside one task on a bounded batch of texts.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import regex

LETTER, NUMBER, OTHER, QUOTE, SPACE, WHITE = range(6)
#: The contractions that the splitting pattern takes whole, without their apostrophe (fixed values).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SLICE = 1_000_000
#: A character of the class WHITE or SPACE after one of another class.
_CUT = regex.compile(r"(?<=\P{White_Space})\p{White_Space}")


@functools.cache
def class_table() -> np.ndarray:
    """The class of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", WHITE)):
        for m in regex.finditer(pattern, points):
            table[ord(points[m.start()]) : ord(points[m.end() - 1]) + 1] = kind
    table[0xD800:0xE000] = OTHER
    table[ord("'")], table[ord(" ")] = QUOTE, SPACE
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def slices(text: str, limit: int = SLICE) -> Iterator[str]:
    """Parts of a text that no piece crosses: a white character after another one always begins a piece.

    A part is longer than the limit only where the text has no such place.
    """
    while len(text) > limit:
        m = _CUT.search(text, limit)
        if not m:
            break
        yield text[: m.start()]
        text = text[m.start() :]
    yield text


class Joined:
    """Parts laid end to end: their code points, classes, and flags of the first and last place of each."""

    def __init__(self, parts: list[str]):
        self.text = "".join(parts)
        self.points = code_points(self.text)
        self.kinds = class_table()[self.points]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths
        n = len(self.points)
        self.first, self.last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        self.first[self.begins[lengths > 0]] = True
        self.last[self.ends[lengths > 0] - 1] = True
        self.first, self.last = self.first[:n], self.last[:n]

    def contractions(self) -> np.ndarray:
        """At each apostrophe that a contraction's letters follow: their number; else 0. Whether it stands at the
        start of a piece is for the caller to know."""
        out = np.zeros(len(self.points), np.uint8)
        at = np.flatnonzero(self.kinds == QUOTE)
        if len(at):
            n = len(self.points)
            pad = np.concatenate([self.points, np.zeros(2, np.uint32)])
            one_in, two_in = ~self.last[at], ~self.last[at] & ~self.last[np.minimum(at + 1, n - 1)]
            for letters in CONTRACTIONS:
                hit = (pad[at + 1] == ord(letters[0])) & (one_in if len(letters) == 1 else two_in & (pad[at + 2] == ord(letters[-1])))
                out[at[hit]] = len(letters)
        return out

    def word_spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each piece of the lower-case word pattern: contractions, letter runs, single numbers and
        runs of other characters; white space belongs to none."""
        kinds, n = self.kinds, len(self.points)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        white = kinds >= SPACE
        group = np.where(kinds == QUOTE, OTHER, np.where(white, SPACE, kinds))
        before = np.concatenate([[255], group[:-1]]).astype(np.uint8)
        before[self.first] = 255
        start = (group != before) | (group == NUMBER)
        short = self.contractions()
        at = np.flatnonzero((short > 0) & (before != OTHER))
        start[at + 1] = False
        after = at + 1 + short[at]
        inside = at[short[at] == 2] + 2
        start[inside] = False
        # letters that follow a contraction begin a piece of their own
        after = after[after < n]
        start[after[~white[after]]] = True
        start &= ~white
        begins = np.flatnonzero(start)
        edges = np.flatnonzero(start | white | self.first)
        following = np.searchsorted(edges, begins, "right")
        ends = np.concatenate([edges, [n]])[following]
        return begins, ends


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@functools.cache
def _randoms() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 64, 0x110000, np.uint64)


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        row = np.full(max(n, 1 << 16) + 1, base, np.uint64)
        row[0] = 1
        held = np.multiply.accumulate(row)
        if n <= 1 << 23:
            _powers[name] = held
    return held


def span_hashes(points: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, from one running sum: equal spans hash alike wherever they stand."""
    n = len(points)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_randoms()[points] * _power("base", _BASE, n + 1)[:n], out=sums[1:])
        h = (sums[ends] - sums[begins]) * _power("inverse", _INVERSE, n + 1)[begins]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


class PieceTable:
    """Rows of token ids for the pieces met so far, found by hash; encode turns new pieces into lists of ids.

    It starts anew beyond `limit` pieces, so its memory is bounded.
    """

    def __init__(self, encode: Callable[[list[str]], list], limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.known, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.offset = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def rows(self, joined: Joined, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table row of each span."""
        h = span_hashes(joined.points, begins, ends)
        found, at, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(found) > self.limit:
            self._clear()
        place = np.searchsorted(self.known, found)
        hit = np.zeros(len(found), bool)
        if len(self.known):
            hit = self.known[np.minimum(place, len(self.known) - 1)] == found
        rows = np.empty(len(found), np.int64)
        rows[hit] = self.row[place[hit]]
        fresh = np.flatnonzero(~hit)
        if len(fresh):
            text, source = joined.text, at[fresh]
            new = [text[a:b] for a, b in zip(begins[source].tolist(), ends[source].tolist(), strict=True)]
            coded = self.encode(new)
            lengths = np.fromiter(map(len, coded), np.int64, len(coded))
            numbers = len(self.length) + np.arange(len(fresh))
            rows[fresh] = numbers
            self.length = np.concatenate([self.length, lengths])
            self.flat = np.concatenate([self.flat, np.concatenate(coded).astype(np.uint32) if len(coded) else self.flat[:0]])
            self.offset = np.concatenate([[0], np.cumsum(self.length)])[:-1]
            merged = np.concatenate([self.known, found[fresh]])
            order = np.argsort(merged, kind="stable")
            self.known, self.row = merged[order], np.concatenate([self.row, numbers])[order]
        return rows[back]

    def tokens(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the rows, laid end to end."""
        lengths = self.length[rows]
        total = int(lengths.sum())
        if not total:
            return np.zeros(0, np.uint32)
        ends = np.cumsum(lengths)
        return self.flat[np.arange(total) + np.repeat(self.offset[rows] - (ends - lengths), lengths)]
