"""Vectorised pre-tokenising of many texts at once, and a table of encoded pre-tokens."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

from loomstead.llm import text as tx

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Code points with the Unicode property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Endings that an apostrophe splits off.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """Class of each code point, made once per process from the Unicode categories."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        _classes = np.array([kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], np.uint8)
        _classes[list(WHITE_SPACE)] = SPACE
    return _classes


def _contractions(points: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray, lone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs that are one apostrophe before a known ending, and the ending's length.

    ``lone``: runs where a match can begin at the run itself, and that the next run adjoins.
    """
    quote = np.flatnonzero(lone & (kind == OTHER) & (end - start == 1) & (points[start] == 39))
    quote = quote[quote + 1 < len(start)]
    quote = quote[(kind[quote + 1] == LETTER) & (start[quote + 1] == end[quote])]
    size = np.zeros(len(quote), np.int64)
    first = points[start[quote + 1]]
    two = np.where(end[quote + 1] - start[quote + 1] > 1, points[np.minimum(start[quote + 1] + 1, len(points) - 1)], 0)
    for ending in ENDINGS:
        hit = first == ord(ending[0])
        if len(ending) == 2:
            hit &= two == ord(ending[1])
        size[hit & (size == 0)] = len(ending)
    return quote[size > 0], size[size > 0]


def split(points: np.ndarray, offsets: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each pre-token, in order; none crosses a text.

    ``spaced``: a space belongs to what follows it, other white space stands alone and numbers
    run on (byte-level vocabularies). Else white space is dropped and each digit stands alone.
    """
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = char_classes()[points]
    cut = np.ones(len(points), bool)
    cut[1:] = cls[1:] != cls[:-1]
    if not spaced:
        cut |= cls == NUMBER
    cut[offsets[offsets < len(points)]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(points))
    kind = cls[start]
    text_ends = np.zeros(len(points) + 1, bool)
    text_ends[offsets] = True

    led = np.zeros(len(start), bool)  # a space before it in the same text belongs to it
    if spaced:
        led[1:] = (kind[:-1] == SPACE) & (points[start[1:] - 1] == 32) & ~text_ends[start[1:]]
    quote, size = _contractions(points, start, end, kind, ~led)
    quote_ok = ~text_ends[end[quote]]
    quote, size = quote[quote_ok], size[quote_ok]
    end[quote] += size
    start[quote + 1] += size
    whole = start < end

    blank = kind == SPACE
    if not spaced:
        keep = whole & ~blank
        return start[keep], end[keep]
    start = start - led
    last = blank & ~text_ends[end]  # white space before more text gives up its last character
    given = np.zeros(len(start), bool)
    given[:-1] = led[1:]
    lone = last & ~given
    body_end = np.where(last, end - 1, end)
    starts = np.concatenate([start[blank], start[~blank], body_end[lone]])
    ends = np.concatenate([body_end[blank], end[~blank], end[lone]])
    good = starts < ends
    starts, ends = starts[good], ends[good]
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


class Encoder:
    """Ids of pre-tokens, looked up by hash; only those not yet seen are encoded.

    ``encode`` maps a list of distinct pre-tokens to (ids, how many each has). The table holds
    at most ``limit`` pre-tokens and starts anew beyond that, so memory stays bounded. Two of
    N pre-tokens share a 64-bit hash with a chance of N * N / 2**65.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], spaced: bool, limit: int = 600_000) -> None:
        self.encode, self.spaced, self.limit = encode, spaced, limit
        self._clear()

    def _clear(self) -> None:
        self.key, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and each text's offset among them."""
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=offsets[1:])
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        start, end = split(points, offsets, self.spaced)
        hashes = tx.span_hashes(points, start, end)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.key) + len(distinct) > self.limit:
            self._clear()
        at = np.searchsorted(self.key, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.key)
        known[inside] = self.key[at[inside]] == distinct[inside]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            spans = zip(start[first[fresh]].tolist(), end[first[fresh]].tolist(), strict=True)
            ids, size = self.encode([joined[s:e] for s, e in spans])
            rows = len(self.begin) + np.arange(len(fresh))
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.key = np.insert(self.key, at[fresh], distinct[fresh])
            self.row = np.insert(self.row, at[fresh], rows)
            at = np.searchsorted(self.key, distinct)
        row = self.row[at][inverse]
        size = self.size[row]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.begin[row] - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(start, offsets)]
