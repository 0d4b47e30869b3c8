"""How many intervals of others, and of how many others, each key's intervals overlap: counted in tiles of keys, without a row for each pair."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstead.operators.intervals import _number
from loomstead.storage import durable

#: Keys of a block; a tile of two blocks takes a bit for each pair of keys, twice: 256 MB.
KEYS = 1 << 15
#: Intervals of a block.
INTERVALS = 1 << 21
#: Small inputs are cut to as many blocks, of this many keys each, so that there are tiles for several tasks.
SPREAD, FEW_KEYS = 6, 1 << 11
#: Events that are Python objects at a time.
STEP = 1 << 18
#: Rows of a tile's bits that are unpacked at a time.
ROWS = 512


class _Side:
    """The intervals of a tile's rows, a row for each key."""

    def __init__(self, rows: pa.Table) -> None:
        self.key = rows.column("key")
        spans = rows.column("spans").combine_chunks()
        self.start, self.end = (spans.flatten().field(k).to_numpy() for k in range(2))
        self.n = spans.value_lengths().to_numpy()
        self.row = np.repeat(np.arange(len(self.n)), self.n)

    def pairs(self, other: _Side) -> np.ndarray:
        """For each row, the pairs of its intervals with those of ``other`` that overlap them."""
        begun, over = np.searchsorted(np.sort(other.start), self.end, "left"), np.searchsorted(np.sort(other.end), self.start, "right")
        return np.add.reduceat(begun - over, np.cumsum(self.n) - self.n)

    def disjoint(self) -> bool:
        order = np.lexsort((self.start, self.row))
        same = self.row[order][1:] == self.row[order][:-1]
        return bool(np.all(self.start[order][1:][same] >= self.end[order][:-1][same]))


def _held(mine: _Side, other: _Side) -> np.ndarray:
    """Bits: rows of ``other`` that hold a start of one of my row's intervals; a sweep in which ends come before starts."""
    times = np.concatenate([other.end, other.start, mine.start])
    codes = np.concatenate([other.row, other.row, ~mine.row])[np.argsort(times, kind="stable")]
    held = np.zeros((len(mine.n), -(-len(other.n) // 64)), np.uint64)
    rows, merge, open_now = list(held), np.bitwise_or, bytearray(held.shape[1] * 8)
    now = np.frombuffer(open_now, np.uint64)
    for begin in range(0, len(codes), STEP):
        for code in codes[begin : begin + STEP].tolist():
            if code < 0:
                row = rows[~code]
                merge(row, now, row)
            else:
                open_now[code >> 3] ^= 1 << (code & 7)
    return held


def _bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")


def _tile(rows: pa.Table) -> pa.Table:
    """Of two intervals that overlap, one holds the other's start: pairs of keys are those of one sweep or the other."""
    right = rows.column("right")
    mine = _Side(rows.filter(pc.invert(right)))
    alone = len(mine.n) == rows.num_rows
    if alone and rows.column("own")[0].as_py() and not mine.disjoint():
        raise ValueError("intervals of one key overlap each other")
    other = mine if alone else _Side(rows.filter(right))
    if not len(mine.n) or (alone and not rows.column("own")[0].as_py()):
        return pa.table({"key": rows.column("key").slice(0, 0), "overlaps": pa.array([], pa.int64()), "others": pa.array([], pa.int64())})
    held = _held(mine, other)
    back = held if alone else _held(other, mine)
    across, down = np.zeros(len(mine.n), np.int64), np.zeros(len(other.n), np.int64)
    for begin in range(0, len(mine.n), ROWS):
        end = min(begin + ROWS, len(mine.n))
        met = _bits(held[begin:end])[:, : len(other.n)] | _bits(back[:, begin // 64 : -(-end // 64)])[:, : end - begin].T
        across[begin:end] = met.sum(axis=1, dtype=np.uint32)
        down += met.sum(axis=0, dtype=np.uint32)
    if alone:
        return pa.table({"key": mine.key, "overlaps": mine.pairs(mine) - mine.n, "others": across - 1})
    keys = pa.chunked_array([*mine.key.chunks, *other.key.chunks], mine.key.type)
    return pa.table({"key": keys, "overlaps": np.concatenate([mine.pairs(other), other.pairs(mine)]), "others": np.concatenate([across, down])})


def overlap_counts(intervals: DataFrame, key: str, span: tuple[str, str], keys: int = KEYS) -> DataFrame:
    """Rows (``key``, overlaps, others): pairs of a key's intervals ``[start, end)`` with overlapping ones of other keys, and how many other keys those are.

    Ends are times, dates or whole numbers. One key's intervals must not overlap each other, and are
    held in one row; rows with a null key or end, or that end no later than they start, count nothing, and keys
    without overlaps have no row.

    Keys are dealt to blocks of about ``keys`` by hash, and each pair of blocks is a tile: a task
    sweeps along its intervals with a bit for each key and pair of keys. Data and memory of a tile
    are bounded; the work in bits and the copies of intervals (one a block) grow with the square of the keys,
    as the pairs of keys to tell apart do, but pairs of intervals are only counted.
    """
    start, end = (_number(intervals, c) for c in span)
    valid = intervals.select(F.col(f"`{key}`").alias("key"), F.struct(start.alias("start"), end.alias("end")).alias("span")).where("key is not null and span.start < span.end")
    packed = durable(valid.groupBy("key").agg(F.collect_list("span").alias("spans")), "overlaps")
    n_keys, n_spans = packed.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    blocks = max(1, ceil(n_keys / keys), ceil(n_spans / INTERVALS), min(SPREAD, ceil(n_keys / min(keys, FEW_KEYS))))
    own = packed.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    dealt = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = dealt.select(F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), F.expr("block = with").alias("own"), F.expr("block > with").alias("right"), "key", "spans")
    schema = T.StructType([T.StructField("key", packed.schema["key"].dataType), T.StructField("overlaps", T.LongType()), T.StructField("others", T.LongType())])
    counted = tiles.groupBy("low", "high").applyInArrow(_tile, schema)
    found = counted.groupBy("key").agg(F.sum("overlaps").alias("overlaps"), F.sum("others").alias("others")).where("overlaps > 0")
    return found.withColumnRenamed("key", key)
