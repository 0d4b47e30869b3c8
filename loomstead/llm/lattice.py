"""Near duplicates among embeddings: E8 lattice hashing, exact cosine, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm import text as tx
from loomstead.llm.components import components
from loomstead.llm.groups import Told, by_key
from loomstead.llm.storage import discard, durable

#: Vectors that one task compares with as many others at a time.
BLOCK = 2048


@dataclass(frozen=True)
class LatticeSpec:
    """Hash tables, the lattice's scale, and how near a cell's border has to be for its neighbour to be probed.

    With these defaults two unit vectors at cosine 0.93 share no cell of one table with a
    chance under 0.3, and of all eight with one under 1e-4; at 0.97 under 1e-7.
    ``codes`` joins several lattice codes to one key, for corpora whose cells grow too full.
    """

    threshold: float = 0.93
    tables: int = 8
    codes: int = 1
    scale: float = 0.7
    border: float = 0.1
    seed: int = 29


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the better of the nearest even-sum integer and half-integer points."""

    def even(z: np.ndarray) -> np.ndarray:
        point = np.rint(z)
        rest = z - point
        odd = np.flatnonzero(point.sum(1) % 2)
        worst = np.abs(rest[odd]).argmax(1)
        point[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
        return point

    whole, half = even(x), even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half)


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8, which lead to the cells around one."""
    found = []
    for i, j in combinations(range(8), 2):
        for signs in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[[i, j]] = signs
            found.append(v)
    found += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(found)


def cells(unit: np.ndarray, spec: LatticeSpec) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, cell name and whether it is the row's own cell, for each table."""
    around = neighbours()
    width = max(unit.shape[1], 8)
    padded = np.zeros((len(unit), width))
    padded[:, : unit.shape[1]] = unit
    rng = np.random.default_rng([spec.seed, width])
    odd = (2 * rng.integers(1, 1 << 62, 8, dtype=np.uint64)) + np.uint64(1)

    def name(points: np.ndarray) -> np.ndarray:
        return ((2 * points).astype(np.int64).astype(np.uint64) * odd).sum(1)

    for table in range(spec.tables):
        rows, keys, own = np.arange(len(unit)), np.full(len(unit), np.uint64(table + 1)), np.ones(len(unit), bool)
        for _ in range(spec.codes):
            frame = np.linalg.qr(rng.standard_normal((width, 8)))[0] * np.sqrt(width / 8) / spec.scale
            y = padded @ frame
            home = nearest(y)
            to_border = (1 - (y - home) @ around.T) / np.sqrt(2) * spec.scale
            near_row, near = np.nonzero(to_border <= spec.border)
            row = np.concatenate([np.arange(len(unit)), near_row])
            key = np.concatenate([name(home), name(home[near_row] + around[near])])
            mine = np.concatenate([np.ones(len(unit), bool), np.zeros(len(near_row), bool)])
            order = np.argsort(row, kind="stable")
            row, key, mine = row[order], key[order], mine[order]
            count = np.bincount(row, minlength=len(unit))
            begin = np.cumsum(count) - count
            each = count[rows]
            pick = np.repeat(begin[rows] - np.cumsum(each) + each, each) + np.arange(each.sum())
            rows, keys, own = np.repeat(rows, each), tx.mix(np.repeat(keys, each) * np.uint64(31) + key[pick]), np.repeat(own, each) & mine[pick]
        yield rows, keys, own


def _units(column: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def _by_width(part: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    size = pc.list_value_length(part.column(column)).to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        yield part.filter(pa.array(size == n))


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of each key in turn; the input is sorted by the keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        same = all(held[0].column(k)[0].as_py() == batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
        if same:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            v = table.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist()]
        for s, e in zip(edges, edges[1:], strict=False):
            yield table.slice(s, e - s)
        held = table.slice(edges[-1]).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    unseen = np.ones(len(linked), bool)
    edges = []
    for root in range(len(linked)):
        if not unseen[root]:
            continue
        unseen[root] = False
        queue = [root]
        while queue:
            a = queue.pop()
            new = np.flatnonzero(linked[a] & unseen)
            unseen[new] = False
            edges += [(a, b) for b in new.tolist()]
            queue += new.tolist()
    return edges


def _block_pairs(rows: DataFrame, key: str, split_on: str, block: int) -> DataFrame:
    """Deal the members of each ``key`` to blocks, and each to every pair that its block is in (i <= j)."""
    counts = rows.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64(split_on, F.lit(7)), F.col("blocks")).cast("int")
    dealt = rows.join(counts.where("blocks > 1"), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", mine)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("blocks", "other")
    return dealt.repartition(parts, key, "i", "j").sortWithinPartitions(key, "i", "j")


def _cell_groups(nodes: DataFrame, spec: LatticeSpec) -> DataFrame:
    """Members (gid, node) of each distinct set of vectors that a cell brings together, one of them in its own cell.

    Only names travel. Cells with the same members, in whatever table, are one group.
    """

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                for part in _by_width(batch.slice(begin, 1024), "embedding"):
                    label = tx.mix(part.column("label").to_numpy().astype(np.uint64) + np.uint64(len(part.column("embedding")[0]) << 40))
                    node = part.column("node").to_numpy()
                    for row, cell, own in cells(_units(part.column("embedding")), spec):
                        yield pa.RecordBatch.from_arrays([pa.array(tx.mix(cell + label[row]).view(np.int64)), pa.array(node[row]), pa.array(own.astype(np.int8))], ["cell", "node", "own"])
        tx.give_back()

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = Told()
        for whole, (cell, node, own) in by_key(batches):
            if not whole:
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(node)], ["gid", "node"])
                continue
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            count = np.diff(np.append(first, len(cell)))
            gid = tx.mix(np.add.reduceat(tx.mix(node.view(np.uint64)), first) + count.astype(np.uint64)).view(np.int64)
            some = np.flatnonzero((count > 1) & (np.maximum.reduceat(own, first) > 0))
            keep = np.zeros(len(first), bool)
            keep[some] = told.fresh(gid[some])
            take = np.repeat(keep, count)
            if take.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(gid, count)[take]), pa.array(node[take])], ["gid", "node"])

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = nodes.select("node", "label", "embedding").mapInArrow(hashed, "cell long, node long, own byte")
    return keyed.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(gather, "gid long, node long").distinct()


def _links(nodes: DataFrame, spec: LatticeSpec) -> DataFrame:
    """Links (a, b) that connect what any cell connects: a spanning forest of each group's exact links."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()
        for group in grouped(batches, ["gid", "i", "j"]):
            mine = group.column("mine").to_numpy()
            if group.num_rows < 2:
                continue
            node = group.column("node").to_numpy()
            unit = _units(group.column("embedding").combine_chunks())
            linked = unit @ unit.T >= spec.threshold
            if mine.min() != mine.max():
                linked &= mine[:, None] != mine[None, :]
            edges = [(int(min(node[a], node[b])), int(max(node[a], node[b]))) for a, b in spanning(linked)]
            edges = [e for e in edges if e not in told]
            if len(told) < 500_000:
                told.update(edges)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges]), pa.array([e[1] for e in edges])], ["a", "b"])
        tx.give_back()

    members = _cell_groups(nodes, spec).join(nodes.select("node", "embedding"), "node")
    return _block_pairs(members, "gid", "node", BLOCK).mapInArrow(compare, "a long, b long").distinct()


def _degrees(nodes: DataFrame, joined: DataFrame, spec: LatticeSpec) -> DataFrame:
    """Exact number of other vectors that each node of a component links to; links stay inside components."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["component", "i", "j"]):
            mine, weight = group.column("mine").to_numpy(), group.column("weight").to_numpy()
            unit = _units(group.column("embedding").combine_chunks())
            linked = unit @ unit.T >= spec.threshold
            np.fill_diagonal(linked, False)
            if group.column("i")[0].as_py() != group.column("j")[0].as_py():
                linked &= mine[:, None] != mine[None, :]
            yield pa.RecordBatch.from_arrays([group.column("node").combine_chunks(), pa.array(linked @ weight)], ["node", "n"])

    members = nodes.join(joined, "node").select("component", "node", "weight", "embedding")
    counted = _block_pairs(members, "component", "node", BLOCK).mapInArrow(count, "node long, n long")
    return counted.groupBy("node").agg(F.sum("n").alias("n"))


def near_duplicates(rows: DataFrame, spec: LatticeSpec = LatticeSpec(), row_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Exact links among what lattice cells bring together: row_id, n_links, component_id, kept.

    Only rows of one label and length are compared. Each vector is stored in its own cell of
    every table and looks into the neighbouring cells whose border is near. Equal vectors are
    one node with a weight. Vectors that are null, empty, zero or hold null or non-finite
    components, and null labels, link with nothing. Rows repeated under one id are rows of
    their own; a component of null ids has a null id, and its rows aren't kept. An empty
    table gives an empty one.
    """
    usable = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    base = rows.select(F.col(row_id).alias("id"), F.col(vector).alias("embedding"), F.col(label).cast("long").alias("label"))
    base = base.withColumn("node", F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("label", "embedding")))
    nodes = durable(base.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("weight"), F.min("id").alias("least")), "vectors")
    joined = durable(components(_links(nodes, spec)), "vector-components")
    least = nodes.join(joined, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    degrees = _degrees(nodes, joined, spec)
    facts = nodes.select("node", "weight", "least").join(joined, "node", "left").join(least, "component", "left").join(degrees, "node", "left")
    facts = facts.select("node", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = base.select("id", "node").join(facts, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    result = durable(out.select(F.col("id").alias(row_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")), "near-vectors")
    discard(nodes)
    return result
