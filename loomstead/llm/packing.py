"""Best-fit packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.llm import text as tx
from loomstead.llm.bpe import TextEncoder
from loomstead.llm.storage import durable

_PIECE_NAMES = ("piece", "start", "length", "ids_crc32")


def cut(size: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: all full but the first, which takes the remainder."""
    first = size % capacity
    starts = ([0] if first else []) + list(range(first, size, capacity))
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], size], strict=True)]


@dataclass
class Layout:
    """Where the pieces of each length go.

    For a length, pieces ranked from ``first`` on go to sequences ``sequence + (rank - first)
    // per * 1`` at ``offset + (rank - first) % per * length``, until the next row's ``first``.
    Rows are ordered by length, then ``first``; their number is bounded by the capacity.
    """

    length: np.ndarray
    first: np.ndarray
    per: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        span = int(self.first.max(initial=0)) + 1
        span = max(span, int(rank.max(initial=0)) + 1)
        row = np.searchsorted(self.length * span + self.first, length * span + rank, "right") - 1
        step = rank - self.first[row]
        return self.sequence[row] + step // self.per[row], self.offset[row] + step % self.per[row] * length


def plan(counts: dict[int, int], capacity: int) -> Layout:
    """Pack counted lengths: large ones matched in pairs, the others best-fit into the gaps.

    Lengths over a third of the capacity share a sequence at most two at a time: each takes,
    longest first, the longest partner that fits. Smaller lengths, longest first, go where
    the least room is left; what finds no gap opens sequences of its own. Equal lengths are
    handled as one group, so the work depends on the capacity and not on the documents.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[list[int]]] = {}  # room -> [first sequence, how many]
    total = 0

    def put(length: int, per: int, sequence: int, offset: int, number: int) -> None:
        rows.append((length, used[length], per, sequence, offset))
        used[length] += number
        left[length] -= number

    def open_gap(room: int, sequence: int, many: int) -> None:
        if room and many:
            gaps.setdefault(room, []).append([sequence, many])

    large = [n for n in sorted(left, reverse=True) if 3 * n > capacity]
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= n and m + n <= capacity and (left[m] if m != n else left[m] >= 2)), None)
            if mate is None:
                many = left[n]
                put(n, 1, total, 0, many)
                open_gap(capacity - n, total, many)
            elif mate == n:
                many = left[n] // 2
                put(n, 2, total, 0, 2 * many)
                open_gap(capacity - 2 * n, total, many)
            else:
                many = min(left[n], left[mate])
                put(n, 1, total, 0, many)
                put(mate, 1, total, n, many)
                open_gap(capacity - n - mate, total, many)
            total += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            room = min((g for g in gaps if g >= n), default=None)
            if room is None:
                per = capacity // n
                many = -(-left[n] // per)
                open_gap(capacity, total, many)
                total += many
                continue
            sequence, many = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
            per = min(room // n, left[n])
            whole = min(many, left[n] // per)
            put(n, per, sequence, capacity - room, whole * per)
            open_gap(room - per * n, sequence, whole)
            open_gap(room, sequence + whole, many - whole)
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return Layout(*columns, total)


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, text: str = "text", carry: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Tokenise each text, end it with ``end_id``, and cut it; columns ``carry`` are repeated on each piece.

    A null or empty text is a document of the end id alone, as is each of repeated rows; an
    empty table has no pieces. A long text is encoded part by part, its ids are held together.
    """
    body = tx.unused(docs, "text")
    own = docs.select(*carry, F.col(text).alias(body))
    kinds = [f"{c.name} {c.dataType.simpleString()}" for c in own.schema.fields[:-1]]
    schema = ", ".join([*(f"`{k.split(' ', 1)[0]}` {k.split(' ', 1)[1]}" for k in kinds), "piece int", "start long", "length long", "ids_crc32 long", *(["ids array<int>"] if with_ids else [])])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(tokenizer_path)
        for part in tx.slices(batches, body):
            ids, offsets = encoder([t or "" for t in part.column(body).to_pylist()])
            size = np.diff(offsets)
            row, out = [], ([], [], [], [])
            lists = []
            for d, n in enumerate(size.tolist()):
                doc = np.append(ids[offsets[d] : offsets[d + 1]], end_id).astype("<u4")
                for k, (s, m) in enumerate(cut(n + 1, capacity)):
                    row.append(d)
                    for column, value in zip(out, (k, s, m, zlib.crc32(doc[s : s + m])), strict=True):
                        column.append(value)
                    if with_ids:
                        lists.append(doc[s : s + m].astype(np.int32))
            taken = part.select(list(carry)).take(pa.array(row, pa.int64()))
            columns = [*taken.columns, pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:])]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [*carry, *_PIECE_NAMES, *(["ids"] if with_ids else [])])
        del encoder
        tx.give_back()

    return own.mapInArrow(run, schema)


def pack(cut_pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    The pieces are written once, each with its number among its task's pieces of the same
    length; counts by task and length give every piece its rank without gathering a length
    in one place. The layout is planned on at most ``capacity`` counted lengths. Pieces of
    an empty table give an empty result; equal pieces are placed one by one.
    """
    names = cut_pieces.columns
    at_task, at_rank, at_base, at_n = (tx.unused(cut_pieces, x) for x in ("task", "rank", "base", "n"))

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for part in batches:
            length = part.column("length").to_numpy(zero_copy_only=False)
            order = np.argsort(length, kind="stable")
            sorted_ = length[order]
            rank = np.empty(len(length), np.int64)
            rank[order] = seen[sorted_] + np.arange(len(length)) - np.searchsorted(sorted_, sorted_)
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(length), task, np.int32)), pa.array(rank)], [*names, at_task, at_rank])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema.fields), f"{at_task} int", f"{at_rank} long"])
    numbered = durable(cut_pieces.mapInArrow(number, kinds), "pieces")
    by_task = durable(numbered.groupBy(at_task, "length").agg(F.count("*").alias(at_n)), "piece-counts")
    layout = plan({r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum(at_n).alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy(at_task).rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select(at_task, "length", F.coalesce(F.sum(at_n).over(before), F.lit(0)).alias(at_base))
    shared = cut_pieces.sparkSession.sparkContext.broadcast(layout)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rank = part.column(at_rank).to_numpy(zero_copy_only=False) + part.column(at_base).to_numpy(zero_copy_only=False)
            sequence, offset = shared.value.place(part.column("length").to_numpy(zero_copy_only=False), rank)
            yield pa.RecordBatch.from_arrays([*part.select(names).columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema.fields), "sequence_id long", "offset long"])
    return numbered.join(base, [at_task, "length"]).mapInArrow(place, kinds)
