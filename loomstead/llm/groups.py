"""Rows that share a key, from a partition that is sorted by it, in bounded memory."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Rows of one key that are held together; a key with more is handed on in parts.
KEY_ROWS = 1 << 18


def by_key(batches: Iterable[pa.RecordBatch], limit: int = KEY_ROWS) -> Iterator[tuple[bool, np.ndarray]]:
    """Integer columns (the first is the key) as arrays of one row a column, with whether their keys are whole.

    Whole keys come several at a time. A key of more than ``limit`` rows comes alone, in parts.
    """
    held: np.ndarray | None = None
    going: int | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        if going is not None:
            cut = int(np.searchsorted(rows[0], going, "right"))
            if cut:
                yield False, rows[:, :cut]
            rows = rows[:, cut:]
            if not rows.shape[1]:
                continue
            going = None
        rows = rows if held is None else np.concatenate([held, rows], axis=1)
        cut = int(np.searchsorted(rows[0], rows[0, -1]))  # the last key may go on
        if cut:
            yield True, rows[:, :cut]
        held = rows[:, cut:]
        if held.shape[1] > limit:
            going = int(held[0, 0])
            yield False, held
            held = None
    if held is not None and held.shape[1]:
        yield True, held


class Told:
    """Names that a task has handed on already; it forgets them beyond a bound, which costs repeats only."""

    def __init__(self, limit: int = 500_000) -> None:
        self.names: set[int] = set()
        self.limit = limit

    def fresh(self, names: np.ndarray) -> np.ndarray:
        """Whether each name is new, and its first in the array."""
        _, once = np.unique(names, return_index=True)
        new = np.zeros(len(names), bool)
        new[once] = [x not in self.names for x in names[once].tolist()]
        if len(self.names) > self.limit:
            self.names.clear()
        self.names.update(names[new].tolist())
        return new
