"""Vectorised views of Arrow text columns: bounded slices, words, hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Text bytes that one numpy step handles; a single longer text is its own step.
SLICE_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64(0xD6E8FEB86659FD93)
#: Places in a span whose byte codes are kept in a table; later places are computed.
_TABLED = 64

#: Values that are scrambled at a time.
CACHED = 1 << 16
#: Word separators: space and 0x09-0x0D.
SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SEPARATORS)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _stir(x: np.ndarray, spare: np.ndarray) -> None:
    """Scramble unsigned 64-bit values in place, by a bijection."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        np.right_shift(x, np.uint64(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint64(factor), out=x)
    np.right_shift(x, np.uint64(31), out=spare)
    np.bitwise_xor(x, spare, out=x)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit values, in pieces that stay in the cache."""
    x = x.astype(np.uint64, order="C", copy=True)
    flat = x.reshape(-1)
    spare = np.empty(min(len(flat), CACHED), np.uint64)
    for begin in range(0, len(flat), CACHED):
        piece = flat[begin : begin + CACHED]
        _stir(piece, spare[: len(piece)])
    return x


def _codes(symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A random-looking 64-bit value of each symbol at each place of a span."""
    return mix((symbol.astype(np.uint64) + np.uint64(1)) * _ODD + place.astype(np.uint64) * _PLACE)


_TABLE = _codes(np.tile(np.arange(256), _TABLED), np.repeat(np.arange(_TABLED), 256))


def span_hashes(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, limit: int = SLICE_BYTES) -> np.ndarray:
    """64-bit hash of each span: a sum modulo 2**64 over (symbol, place) values that are mixed one by one.

    Whatever pattern two different spans follow, their sums agree with a chance of 2**-64, as
    no value is a multiple of another. Work is done for ``limit`` symbols at a time, which
    may end inside a span, so a long text takes no more memory here than a short one.
    """
    size = end - start
    total = np.zeros(len(start), np.uint64)
    used = np.flatnonzero(size > 0)
    begin = np.cumsum(size[used]) - size[used]
    shift = start[used] - begin
    last = begin + size[used]
    flat = int(last[-1]) if len(used) else 0
    plain = symbols.dtype == np.uint8 or not len(symbols) or int(symbols.max()) < 256
    for low in range(0, flat, limit):
        high = min(low + limit, flat)
        a, b = int(np.searchsorted(begin, low, "right")) - 1, int(np.searchsorted(begin, high, "left"))
        first = np.maximum(begin[a:b], low)
        count = np.minimum(last[a:b], high) - first
        at = np.arange(low, high)
        symbol = symbols[at + np.repeat(shift[a:b], count)]
        place = at - np.repeat(begin[a:b], count)
        value = _TABLE[np.minimum(place, _TABLED - 1) * 256 + (symbol if plain else np.minimum(symbol, 255))]
        if not plain or (size[used[a:b]] > _TABLED).any():
            rest = np.flatnonzero((place >= _TABLED) | (symbol > 255))
            value[rest] = _codes(symbol[rest], place[rest])
        total[used[a:b]] += np.add.reduceat(value, first - low)
    return mix(total + size.astype(np.uint64))


def prefix_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """:func:`span_hashes` of the first 1, 2, ... bytes from each start, up to the largest ``size`` (at most 64): rows by columns.

    What stands beyond a row's own size is of no use.
    """
    places = np.arange(min(int(size.max(initial=0)), _TABLED))
    value = _TABLE[places * 256 + data[np.minimum(start[:, None] + places, len(data) - 1)]]
    return mix(np.cumsum(value, axis=1) + (places + 1).astype(np.uint64))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of two things in a row from the names of both, which have one shape."""
    out = np.empty(len(a), np.uint64)
    spare = np.empty(min(len(out), CACHED), np.uint64)
    for begin in range(0, len(out), CACHED):
        piece = out[begin : begin + CACHED]
        np.multiply(a[begin : begin + CACHED], _ODD, out=piece)
        np.add(piece, b[begin : begin + CACHED], out=piece)
        _stir(piece, spare[: len(piece)])
    return out


def gram_names(data: np.ndarray, levels: int) -> list[np.ndarray]:
    """By level, the name of the ``8 * 2 ** level`` bytes from each place on: eight bytes as they are, then pairs of names.

    There is one name a place at which so many bytes stand; strings may cross from a text into the next.
    """
    wide = data.astype(np.uint64)
    for k in (1, 2, 4):
        wide = wide[: max(len(wide) - k, 0)] | (wide[k:] << np.uint64(8 * k))
    found = [mix(wide)]
    for level in range(levels):
        last, k = found[-1], 8 << level
        found.append(joined(last[: max(len(last) - k, 0)], last[k:]))
    return found


class SpanNames:
    """Names of spans, all of at least ``8 * 2 ** level`` bytes: those of the strings of that size that cover them.

    Spans of equal length have equal names if and only if they are equal, up to the chance of
    2**-64 with which two different strings share a name; there is no pattern that nesting
    names of pairs would not break.
    """

    def __init__(self, names: np.ndarray, level: int) -> None:
        self.names, self.unit = names, 8 << level

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        last = np.clip(end - self.unit, 0, max(len(self.names) - 1, 0))
        total = (end - start).astype(np.uint64)
        for k in range(-(-int((end - start).max(initial=0)) // self.unit)):
            total = joined(total, self.names[np.minimum(start + k * self.unit, last)])
        return total


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64)
        begin = 0
        while begin < batch.num_rows:
            done = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and each text's offset (one more than there are texts)."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of true values that stays in one text."""
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    after[inner - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word ``[^\\x20\\x09-\\x0D]+``."""
    start, end = runs(IS_WORD[data], offsets)
    return start, end, np.searchsorted(offsets, start, "right") - 1


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the flags are set in each text."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    counts = np.zeros(len(offsets) - 1, np.int64)
    if len(full):
        counts[full] = np.add.reduceat(flags.view(np.uint8), offsets[full], dtype=np.int64)
    return counts


def windows(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word number of each window of ``width`` words inside one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(n, np.uint64(width))
    for k in range(width):
        total ^= total >> np.uint64(29)
        total *= _ODD
        total += hashes[k : k + n]
    first = np.flatnonzero(owner[:n] == owner[width - 1 :])
    return mix(total[first]), first


def give_back() -> None:
    """Return freed memory to the system, as Python workers are reused by later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``__name`` that the table doesn't have, whatever its letters' case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def append_columns(
    df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], text: str = "text"
) -> DataFrame:
    """Add columns computed from bounded slices; a column of the same name is replaced.

    ``make`` runs once per task and returns the function that maps a slice to the new columns.
    """
    names = {f.name for f in fields}
    df = df.select(*[f"`{c}`" for c in df.columns if c not in names])
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        try:
            for part in slices(batches, text):
                new = step(part)
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *[f.name for f in fields]])
        finally:
            del step
            give_back()

    return df.mapInArrow(run, schema)
