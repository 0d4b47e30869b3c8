"""A bitmap over hashes, gathered from tasks: it lets rows go early that an exact join would drop."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Packed bits of the ``hash`` column modulo ``bits``; a few tasks' bitmaps are all that reaches the driver."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = np.unique(batch.column(0).to_numpy(zero_copy_only=False))
            if len(at):
                first = np.flatnonzero(np.append(True, at[1:] >> 3 != at[:-1] >> 3))
                own[at[first] >> 3] |= np.bitwise_or.reduceat(np.left_shift(1, at & 7).astype(np.uint8), first)
        step = 1 << 16
        chunks = [(i, own[i : i + step].tobytes()) for i in range(0, len(own), step) if own[i : i + step].any()]
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in chunks], pa.int32()), pa.array([c[1] for c in chunks], pa.binary())], ["i", "bits"])

    packed = np.zeros(bits // 8, np.uint8)
    rows = hashes.select(F.pmod("hash", F.lit(bits)).cast("long").alias("b"))
    for r in rows.coalesce(4).mapInArrow(gather, "i int, bits binary").toLocalIterator():
        packed[r["i"] : r["i"] + len(r["bits"])] |= np.frombuffer(r["bits"], np.uint8)
    return packed


def in_bitmap(packed: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = hashes % bits
    return ((packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
