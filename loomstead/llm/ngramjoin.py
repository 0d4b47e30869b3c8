"""Exact Jaccard join of word n-gram sets by token and token-combination prefixes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm import text as tx
from loomstead.llm.bitmap import bitmap, in_bitmap
from loomstead.llm.components import components
from loomstead.llm.groups import KEY_ROWS, Told, by_key
from loomstead.llm.lattice import grouped
from loomstead.llm.storage import discard, durable

#: Token classes whose documents are counted; the counts are all that is broadcast of them.
CLASS_BITS = 16
#: Least bits of the parity sketch that bounds an intersection from above.
LEAST_SKETCH = 256
#: At most so many bits (as a power of two) are in the bitmap of sets that any candidate pair names.
FILTER_BITS = 27
#: Members of a group that one task compares at a time.
BLOCK = 4096
#: Shingles of the members whose sketches one task holds of each block.
BLOCK_SKETCHED = 1 << 24
#: Tokens of undecided members that one task holds of each block.
BLOCK_TOKENS = 1 << 19


@dataclass(frozen=True)
class JoinSpec:
    """Words in a shingle, and the least similarity in hundredths."""

    width: int = 5
    percent: int = 75

    def __post_init__(self):
        if self.percent < 75:
            raise ValueError("adjacent token pairs cover similarities of 75 hundredths or more")

    def enough(self, common, a, b):
        return 100 * common >= self.percent * (a + b - common)

    def near(self, a, b):
        """Whether sizes allow the similarity."""
        return 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)


@dataclass
class Sets:
    """Distinct shingles of several texts, ordered by text, then rare before frequent, then hash."""

    size: np.ndarray
    begin: np.ndarray
    token: np.ndarray
    sid: np.ndarray


def _shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    data, offsets = tx.utf8(column)
    data = tx.LOWER[data]
    start, end, owner = tx.words(data, offsets)
    hashes = tx.span_hashes(data, start, end)
    token, first = tx.windows(hashes, owner, width)
    owners = owner[first]
    count = np.bincount(owner, minlength=len(offsets) - 1)
    for n in range(1, width):  # a short text is one shingle
        short, at = tx.windows(hashes, owner, n)
        mine = count[owner[at]] == n
        token = np.concatenate([token, tx.mix(short[mine] + np.uint64(n))])
        owners = np.concatenate([owners, owner[at[mine]]])
    return token, owners, len(offsets) - 1


def token_class(token: np.ndarray) -> np.ndarray:
    return (tx.mix(token) >> np.uint64(64 - CLASS_BITS)).astype(np.int64)


def shingle_sets(column: pa.Array, width: int, frequent: np.ndarray | None = None) -> Sets:
    """``sid`` names the set: equal sets have equal names, whatever the order of their words."""
    token, owner, n = _shingles(column, width)
    order = np.argsort(token)
    token, owner = token[order], owner[order]
    if frequent is not None:
        owner = 2 * owner + frequent[token_class(token)]
    order = np.argsort(owner.astype(np.uint16) if n < 1 << 15 else owner, kind="stable")
    token, owner = token[order], owner[order]
    keep = np.ones(len(token), bool)
    keep[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[keep], owner[keep]
    if frequent is not None:
        owner = owner // 2
    size = np.bincount(owner, minlength=n)
    begin = np.cumsum(size) - size
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx.mix(token ^ np.uint64(0x5BD1E995)))])
    sid = tx.mix(sums[begin + size] - sums[begin] + size.astype(np.uint64)).view(np.int64)
    return Sets(size, begin, token, sid)


def index_keys(sets: Sets, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and key of every index entry.

    In the common order (rare tokens first) two similar sets share a token among the first
    ``n - ceil(percent * n / 100) + 1`` of each. Rare ones there are keys as they are. If all
    shared tokens are frequent, the sets' rare tokens all differ, and since common tokens
    outnumber differing ones three to one, two of them follow each other in both sets; before
    the first such pair stand at most all differing tokens and as many single common ones.
    So pairs of adjacent frequent tokens are keys, up to that place, in sets whose prefix
    reaches the frequent ones.
    """
    owner = np.repeat(np.arange(len(sets.size)), sets.size)
    at = np.arange(len(sets.token)) - sets.begin[owner]
    often = frequent[token_class(sets.token)].astype(bool)
    n = sets.size
    need = -(-percent * n // 100)
    prefix = n - need + 1
    single = (at < prefix[owner]) & ~often
    rare = np.bincount(owner[~often], minlength=len(n))
    reach = (n - need) + (n * (100 - percent)) // percent + 2
    pair = often[:-1] & often[1:] & (owner[:-1] == owner[1:]) & (at[:-1] <= reach[owner[:-1]]) & (rare < prefix)[owner[:-1]]
    left = np.flatnonzero(pair)
    keys = np.concatenate([sets.token[single], tx.mix(sets.token[left] * np.uint64(0x9E3779B97F4A7C15) + tx.mix(sets.token[left + 1]))])
    owners = np.concatenate([owner[single], owner[left]])
    order = np.argsort(owners, kind="stable")
    return owners[order], keys[order].view(np.int64)


def sketch_bits(size: np.ndarray) -> np.ndarray:
    """Bits of a sketch: a power of two, one and a half to three for each token."""
    return np.maximum(LEAST_SKETCH, 1 << np.ceil(np.log2(1.5 * np.maximum(size, 1))).astype(np.int64))


def parity_sketches(sets: Sets, chosen: np.ndarray) -> list[bytes]:
    """For each chosen set, the parity of the tokens that fall on each bit."""
    bits = sketch_bits(sets.size[chosen])
    spots = (tx.mix(sets.token + np.uint64(77)) >> np.uint64(20)).astype(np.int64)
    return [np.packbits((np.bincount(spots[b : b + n] % k, minlength=k) & 1).astype(np.uint8)).tobytes() for b, n, k in zip(sets.begin[chosen], sets.size[chosen], bits.tolist(), strict=True)]


def fold(sketches: np.ndarray) -> np.ndarray:
    """Sketches (rows of bytes) of half the bits."""
    half = sketches.shape[-1] // 2
    return sketches[..., :half] ^ sketches[..., half:]


def most_common(size_a, size_b, sketch_a: np.ndarray, sketch_b: np.ndarray):
    """Upper bound of the intersection: each differing bit stands for a token of one set alone."""
    while sketch_a.shape[-1] > sketch_b.shape[-1]:
        sketch_a = fold(sketch_a)
    while sketch_b.shape[-1] > sketch_a.shape[-1]:
        sketch_b = fold(sketch_b)
    differ = np.bitwise_count(sketch_a ^ sketch_b).sum(-1, dtype=np.int64)
    return (size_a + size_b - differ) // 2


class SketchRows:
    """Sketches of several lengths, by row."""

    def __init__(self, rows: list[bytes]) -> None:
        self.length = np.array([len(r) for r in rows], np.int64)
        self.place = np.zeros(len(rows), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for n in np.unique(self.length).tolist():
            at = np.flatnonzero(self.length == n)
            self.place[at] = np.arange(len(at))
            self.of[n] = np.frombuffer(b"".join(rows[i] for i in at), np.uint8).reshape(len(at), n)

    def take(self, rows: np.ndarray, length: int) -> np.ndarray:
        return self.of[length][self.place[rows]]


def _longs(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(begin, begin[-1] + size[-1] if len(begin) else 0).astype(np.int32)), pa.array(values))


def _survey(docs: DataFrame, spec: JoinSpec, text: str) -> DataFrame:
    """One row per document (doc_id, sid, size, hash of the text), and rows that count documents by token class."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CLASS_BITS, np.int64)
        names = ["doc_id", "sid", "size", "hash", "token_class", "n"]
        for part in tx.slices(batches, text):
            sets = shingle_sets(part.column(text), spec.width)
            total += np.bincount(token_class(sets.token), minlength=len(total))
            none = pa.nulls(part.num_rows, pa.int32()), pa.nulls(part.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets.sid), pa.array(sets.size.astype(np.int64)), part.column("hash"), *none], names)
        used = np.flatnonzero(total)
        none = [pa.nulls(len(used), pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([*none, pa.array(used.astype(np.int32)), pa.array(total[used])], names)
        tx.give_back()

    rows = docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text).alias("hash"))
    return rows.mapInArrow(run, "doc_id long, sid long, size long, hash long, token_class int, n long")


def _frequent_classes(survey: DataFrame) -> np.ndarray:
    """1 for classes with over twice the mean number of tokens, which one token must cause."""
    rows = survey.where("token_class is not null").groupBy("token_class").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 << CLASS_BITS, np.int64)
    for r in rows:
        counts[r["token_class"]] = r["n"]
    return (counts > 2 * counts.mean() + 64).astype(np.int64)


def _entries(docs: DataFrame, spec: JoinSpec, frequent, text: str) -> DataFrame:
    """Index keys of each distinct set; copies are merged before and in the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, text):
            sets = shingle_sets(part.column(text), spec.width, frequent.value)
            owner, keys = index_keys(sets, frequent.value, spec.percent)
            size = np.bincount(owner, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(sets.sid), pa.array(sets.size.astype(np.int32)), _longs(keys, np.cumsum(size) - size, size)], ["sid", "size", "keys"])
        tx.give_back()

    rows = docs.select(text).mapInArrow(run, "sid long, size int, keys array<long>").where("size > 0")
    return rows.groupBy("sid", "size").agg(F.first("keys").alias("keys"))


def _groups(entries: DataFrame, spec: JoinSpec) -> DataFrame:
    """Sets that share a key: rows (gid, sid, size, hub, hub_size, members) of each distinct group of two or more.

    By size a key's sets fall apart wherever one is too small to be similar to the next, and
    each part is a group of its own. Groups of the same sets, met under many keys, are one.
    The hub is the member whose scrambled name is least, so that groups with common members
    mostly choose the same. A key too frequent to be held is one group, handed on in parts,
    whose hub is of its first part.
    """
    names = ["gid", "sid", "size", "hub", "hub_size", "members"]

    def rows_of(gid, sid, size, hub, hub_size, members) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(gid), pa.array(sid), pa.array(size.astype(np.int32)), pa.array(hub), pa.array(hub_size.astype(np.int32)), pa.array(members.astype(np.int32))], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = Told()
        going = hub = hub_size = None
        for whole, (key, sid, size) in by_key(batches):
            if not whole:
                if going != key[0]:
                    least = int(tx.mix(sid.view(np.uint64)).argmin())
                    going, hub, hub_size = key[0], sid[least], size[least]
                same = np.ones(len(key), np.int64)
                yield rows_of(key, sid, size, same * hub, same * hub_size, same * KEY_ROWS)
                continue
            order = np.lexsort((size, key))
            key, sid, size = key[order], sid[order], size[order]
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (100 * size[:-1] < spec.percent * size[1:])))
            count = np.diff(np.append(first, len(key)))
            rank = tx.mix(sid.view(np.uint64))
            gid = tx.mix(np.add.reduceat(tx.mix(rank), first) + count.astype(np.uint64)).view(np.int64)
            some = np.flatnonzero(count > 1)
            keep = np.zeros(len(first), bool)
            keep[some] = told.fresh(gid[some])
            take = np.repeat(keep, count)
            if not take.any():
                continue
            group = np.repeat(np.arange(len(first)), count)
            is_hub = np.flatnonzero(rank == np.minimum.reduceat(rank, first)[group])
            hub_at = np.zeros(len(first), np.int64)
            hub_at[group[is_hub]] = is_hub
            at = hub_at[group[take]]
            yield rows_of(gid[group[take]], sid[take], size[take], sid[at], size[at], count[group[take]])
        tx.give_back()

    rows = entries.select(F.explode("keys").alias("key"), "sid", "size")
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "gid long, sid long, size int, hub long, hub_size int, members int")
    return found.distinct()


def _sets_of(docs: DataFrame, survey: DataFrame, wanted: DataFrame, spec: JoinSpec, text: str, tokens: bool) -> DataFrame:
    """Sketch, or with ``tokens`` the whole set, of every ``wanted`` name (column sid), made anew from one text of each.

    The survey tells which text, by its hash. A bitmap over those hashes, which has at least
    32 bits for each up to ``FILTER_BITS`` in all, spares most other texts; what it lets
    through besides is harmless.
    """
    one = durable(survey.where("token_class is null").join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min("hash").alias("hash")), "wanted")
    bits = 1 << min(FILTER_BITS, max(24, int(32 * one.count()).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(one, bits))
    discard(one)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value
        for batch in batches:
            hit = in_bitmap(packed, batch.column("hash").to_numpy(zero_copy_only=False), bits)
            for part in tx.slices([batch.filter(pa.array(hit))], text):
                sets = shingle_sets(part.column(text), spec.width)
                keep = np.flatnonzero(sets.size > 0)
                if not len(keep):
                    continue
                if tokens:
                    body = pa.array([sets.token[b : b + n].view(np.int64) for b, n in zip(sets.begin[keep], sets.size[keep], strict=True)], pa.list_(pa.int64()))
                else:
                    body = pa.array(parity_sketches(sets, keep), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(sets.sid[keep]), pa.array(sets.size[keep].astype(np.int32)), body], ["sid", "size", "body"])
        tx.give_back()

    found = docs.select(text, F.xxhash64(text).alias("hash")).mapInArrow(run, f"sid long, size int, body {'array<long>' if tokens else 'binary'}")
    return found.groupBy("sid").agg(F.first(F.struct("size", "body")).alias("s")).select("sid", "s.size", F.col("s.body").alias("tokens" if tokens else "sketch"))


def _bounded(pairs: DataFrame, sets: DataFrame, spec: JoinSpec) -> DataFrame:
    """Pairs (a, b) whose sketches allow the similarity, with the intersection's bound as a share of it."""
    left = sets.select(F.col("sid").alias("a"), F.col("size").alias("size_a"), F.col("sketch").alias("sketch_a"))
    right = sets.select(F.col("sid").alias("b"), F.col("size").alias("size_b"), F.col("sketch").alias("sketch_b"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            size_a, size_b = size = [batch.column(f"size_{x}").to_numpy(zero_copy_only=False).astype(np.int64) for x in "ab"]
            left, right = (SketchRows(batch.column(f"sketch_{x}").to_pylist()) for x in "ab")
            most = np.zeros(n, np.int64)
            for p, q in np.unique(np.stack([left.length, right.length]), axis=1).T.tolist():
                at = np.flatnonzero((left.length == p) & (right.length == q))
                most[at] = most_common(size_a[at], size_b[at], left.take(at, p), right.take(at, q))
            ok = pa.array(spec.enough(most, *size))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(most / np.maximum(size[0] + size[1], 1))], ["a", "b", "close"]).filter(ok)

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long, close double")


def _verified(pairs: DataFrame, sets: DataFrame, spec: JoinSpec) -> DataFrame:
    """The pairs (a, b) that are similar, by their whole sets."""
    left = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("tokens_a"))
    right = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tokens_b"))
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    a, b = F.size("tokens_a"), F.size("tokens_b")
    return pairs.select("a", "b").join(right, "b").join(left, "a").where(100 * common >= spec.percent * (a + b - common)).select("a", "b")


def _similar(docs: DataFrame, survey: DataFrame, pairs: DataFrame, spec: JoinSpec, text: str) -> DataFrame:
    """The similar ones of the pairs (a, b) that sketches allow; only their sets are made whole."""
    pairs = durable(pairs.select("a", "b"), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    links = durable(_verified(pairs, _sets_of(docs, survey, wanted, spec, text, True), spec), "links")
    discard(pairs)
    return links


def _apart(groups: DataFrame, sets: DataFrame, comps: DataFrame, spec: JoinSpec, forest: bool) -> DataFrame:
    """Compare by sketches the members of a group that are in different components.

    Groups of one component are done. A larger group is compared block by block. With
    ``forest`` the result is pairs (a, b) that sketches allow, without those that earlier ones
    of their block connect, so there are fewer than members; and rows that hold only a gid,
    for groups with any such pair. Without, it is the undecided members (gid, sid, size,
    comp): those that are in any allowed pair.
    """
    tagged = groups.select("gid", "sid", "size").join(comps, groups["sid"] == comps["node"], "left").select("gid", "sid", "size", F.coalesce("component", "sid").alias("comp"))
    mixed = tagged.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("members"), F.sum("size").alias("shingles")).where("low < high")
    mixed = mixed.select("gid", F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SKETCHED)).cast("int").alias("blocks"))
    rows = tagged.join(mixed, "gid").join(sets.select("sid", "sketch"), "sid")
    mine = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("gid", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "sid", "size", "comp", "sketch")

    def compare(group: list[np.ndarray], sketches: SketchRows) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs in the group, or of its undecided members (twice)."""
        sid, size, comp, mine = group
        comp = comp.copy()
        left, right = [], []
        undecided = np.zeros(len(sid), bool)
        for k in range(len(sid)):
            rest = slice(k + 1, None)
            ok = np.flatnonzero((comp[rest] != comp[k]) & spec.near(size[rest], size[k])) + k + 1
            if mine.min() != mine.max():
                ok = ok[mine[ok] != mine[k]]
            if not len(ok):
                continue
            own = sketches.take(k, int(sketches.length[k]))
            most = np.zeros(len(ok), np.int64)
            for n in np.unique(sketches.length[ok]).tolist():
                at = np.flatnonzero(sketches.length[ok] == n)
                most[at] = most_common(size[ok[at]], size[k], sketches.take(ok[at], n), own)
            allowed = spec.enough(most, size[ok], size[k])
            at, most = ok[allowed], most[allowed]
            if forest and len(at):
                at = at[np.argsort(-most / (size[at] + size[k]), kind="stable")]
                reached, first = np.unique(comp[at], return_index=True)
                at = at[first]
                comp[np.isin(comp, reached)] = comp[k]
                left.append(np.full(len(at), k))
                right.append(at)
            elif len(at):
                undecided[at] = undecided[k] = True
        if not forest:
            left = right = [np.flatnonzero(undecided)]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *left]), np.concatenate([none, *right])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit(table: pa.Table) -> pa.RecordBatch:
            column = {c: table.column(c).to_numpy() for c in ("gid", "i", "j", "sid", "size", "comp", "mine")}
            sketch = table.column("sketch").to_pylist()
            key = np.stack([column["gid"], column["i"], column["j"]])
            first = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0)))
            found = []
            for s, e in zip(first, np.append(first[1:], table.num_rows), strict=True):
                a, b = compare([column[c][s:e].astype(np.int64) for c in ("sid", "size", "comp", "mine")], SketchRows(sketch[s:e]))
                found.append((a + s, b + s))
            a, b = np.concatenate([p[0] for p in found]), np.concatenate([p[1] for p in found])
            if not forest:
                return pa.RecordBatch.from_arrays([pa.array(column[c][a].astype(np.int64)) for c in ("gid", "sid", "size", "comp")], ["gid", "sid", "size", "comp"])
            gids = np.unique(column["gid"][a])
            a, b = column["sid"][a], column["sid"][b]
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            no_gid, no_pair = pa.nulls(both.shape[1], pa.int64()), pa.nulls(len(gids), pa.int64())
            columns = [[pa.array(both[0]), no_pair], [pa.array(both[1]), no_pair], [no_gid, pa.array(gids)]]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["a", "b", "gid"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            gid, i, j = (table.column(c).to_numpy() for c in ("gid", "i", "j"))
            tail = np.flatnonzero((gid != gid[-1]) | (i != i[-1]) | (j != j[-1]))
            if len(tail):
                cut = int(tail[-1]) + 1
                yield emit(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield emit(pa.Table.from_batches(held))
        held.clear()
        tx.give_back()

    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = "a long, b long, gid long" if forest else "gid long, sid long, size long, comp long"
    return rows.repartition(parts, "gid", "i", "j").sortWithinPartitions("gid", "i", "j").mapInArrow(run, kinds).distinct()


def _rest(members: DataFrame, sets: DataFrame, spec: JoinSpec, whole: bool) -> DataFrame:
    """Pairs (gid, a, b) that connect all similar undecided members of a group: a spanning forest of each block.

    Unless ``whole``, tokens are compared by 32-bit hashes, which can only make an intersection
    look larger; so a pair may not hold.
    """
    blocks = members.groupBy("gid").agg(F.ceil(F.sum("size") / BLOCK_TOKENS).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    rows = members.join(blocks, "gid").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("gid", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "sid", "comp")
    tokens = F.col("tokens") if whole else F.transform("tokens", lambda t: F.hash(t))
    rows = rows.join(sets.select("sid", tokens.alias("tokens")), "sid")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["gid", "i", "j"]):
            sid, mine = group.column("sid").to_numpy(), group.column("mine").to_numpy()
            comp = group.column("comp").to_numpy().copy()
            lists = group.column("tokens").combine_chunks()
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            begin = np.cumsum(size) - size
            values, token = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            mark = np.zeros(len(values), np.int32)
            across = mine.min() != mine.max()
            pairs = []
            for k in range(len(sid) - 1):
                ok = (comp != comp[k]) & spec.near(size, size[k])
                ok[: k + 1] = False
                if across:
                    ok &= mine != mine[k]
                if not ok.any():
                    continue
                own = token[begin[k] : begin[k] + size[k]]
                mark[own] = 1
                common = np.add.reduceat(mark[token], begin)
                mark[own] = 0
                at = np.flatnonzero(ok & spec.enough(common, size, size[k]))
                reached, first = np.unique(comp[at], return_index=True)
                pairs += [(int(min(sid[k], sid[x])), int(max(sid[k], sid[x]))) for x in at[first]]
                comp[np.isin(comp, reached)] = comp[k]
            if pairs:
                gid = pa.repeat(group.column("gid")[0], len(pairs))
                yield pa.RecordBatch.from_arrays([gid, pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs])], ["gid", "a", "b"])

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "gid", "i", "j").sortWithinPartitions("gid", "i", "j").mapInArrow(run, "gid long, a long, b long").distinct()


def _classes(members: DataFrame) -> DataFrame:
    """Members of overlapping groups as one group, where their tokens fit in one block, so that each is sent once.

    In classes that are larger the members stay in their own groups.
    """
    hubs = members.groupBy("gid").agg(F.min("sid").alias("b"))
    named = components(members.join(hubs, "gid").select(F.col("sid").alias("a"), "b").where("a <> b"))
    rows = members.select("sid", "size", "comp").distinct().join(named, F.col("sid") == F.col("node")).select(F.col("component").alias("class"), "sid", "size", "comp")
    small = rows.groupBy("class").agg(F.sum("size").alias("n")).where(F.col("n") <= BLOCK_TOKENS).select("class")
    merged = durable(rows.join(small, "class", "left_semi").select(F.col("class").alias("gid"), "sid", "size", "comp"), "classes")
    return merged.unionByName(members.join(merged.select("sid"), "sid", "left_anti"))


def _decided(members: DataFrame, sets: DataFrame, spec: JoinSpec) -> DataFrame:
    """Similar pairs (a, b) that connect all similar undecided members of the groups.

    Tokens that share a 32-bit hash share it whatever is hashed after them, so groups with a
    pair that doesn't hold, which may have hidden a link, are compared by whole tokens: then
    every pair holds.
    """
    pairs = durable(_rest(members, sets, spec, False), "pairs")
    links = durable(_verified(pairs.select("a", "b").distinct(), sets, spec), "links")
    failed = durable(pairs.join(links, ["a", "b"], "left_anti").select("gid").distinct(), "failed")
    discard(pairs)
    if failed.isEmpty():
        return links
    return links.unionByName(_rest(members.join(failed, "gid", "left_semi"), sets, spec, True).select("a", "b"))


def similar_sets(docs: DataFrame, spec: JoinSpec = JoinSpec(), text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Name each document's shingle set, and find which sets similarity connects.

    Returns (doc_id, sid, size, hash of the text) of every document and (node, component) of the sets that
    have a link. Sets are named by a 64-bit sum over 64-bit shingle hashes: among N distinct
    texts about N * N / 2**65 pairs would share a name by chance.

    Links are looked for where they can matter. Each set is compared with its groups' hubs,
    with the likeliest first, then groups of three or more that are still in several
    components by spanning forests. Sketches rule most pairs out by an exact bound, whole sets
    decide the rest. Last, all members that sketches leave undecided are compared by hashed
    tokens; if a pair so found doesn't hold, which takes a collision of hashes, its groups are
    compared again by whole tokens, as it may have hidden a link.
    """
    spark = docs.sparkSession
    survey = durable(_survey(docs, spec, text), "survey")
    frequent = spark.sparkContext.broadcast(_frequent_classes(survey))
    groups = durable(_groups(_entries(docs, spec, frequent, text), spec), "groups")
    sets = durable(_sets_of(docs, survey, groups.select("sid").distinct(), spec, text, False), "sketches")

    near = (100 * F.least("size", "hub_size")) >= (spec.percent * F.greatest("size", "hub_size"))
    stars = groups.where((F.col("sid") != F.col("hub")) & near).select(F.col("hub").alias("a"), F.col("sid").alias("b")).distinct()
    close = durable(_bounded(stars, sets, spec), "close")
    best = durable(close.groupBy("b").agg(F.max_by("a", "close").alias("a")).select("a", "b"), "best")
    joined = components(_similar(docs, survey, best, spec, text))

    def join(more: DataFrame) -> DataFrame:
        return joined if more.isEmpty() else components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    def component_of(side: str) -> DataFrame:
        return joined.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))

    others = close.join(best, ["a", "b"], "left_anti").join(component_of("a"), "a", "left").join(component_of("b"), "b", "left")
    others = others.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
    joined = join(_similar(docs, survey, others, spec, text))
    discard(close)
    discard(best)

    # pairs with a hub are decided, so groups of two are done
    more = groups.where("members > 2").select("gid", "sid", "size")
    allowed = durable(_apart(more, sets, joined, spec, True), "allowed")
    joined = join(_similar(docs, survey, allowed.where("a is not null"), spec, text))
    # coarser components leave no pair in a group that had none before
    left = more.join(allowed.where("gid is not null").select("gid").distinct(), "gid", "left_semi")
    members = durable(_apart(left, sets, joined, spec, False), "undecided")
    discard(allowed)
    whole = durable(_sets_of(docs, survey, members.select("sid").distinct(), spec, text, True), "sets")
    joined = join(durable(_decided(_classes(members), whole, spec), "links"))
    for done in (whole, groups, sets, members):
        discard(done)
    return survey.where("token_class is null").select("doc_id", "sid", "size", "hash"), joined


def connect(docs: DataFrame, spec: JoinSpec = JoinSpec(), text: str = "text") -> DataFrame:
    """Each document's set size and the smallest ``doc_id`` that links reach: doc_id, n_shingles, component_id.

    A document without words (null, empty or blank) links with nothing. Rows repeated under
    one id, or with a null id, are rows of their own; a component of null ids alone has its
    own null id. An empty table gives an empty one. ``doc_id`` has to be an integer. A long
    text takes about sixty bytes a word, and five a byte, while its set is made.
    """
    named, final = similar_sets(docs, spec, text)
    rows = named.join(final, named["sid"] == final["node"], "left").select("doc_id", "size", F.when(F.col("size") > 0, F.coalesce("component", "sid")).alias("c"))
    least = rows.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"))
    out = rows.join(least, "c", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, spec: JoinSpec = JoinSpec(), text: str = "text") -> DataFrame:
    """One row of each component, that of the smallest ``doc_id``; columns stay as they are.

    Rows without words (null, empty or blank texts) stay, each of them. A null id counts as the largest. Among texts of
    one id the one whose hash is least stays, and of rows that repeat id and text the one
    whose other columns' hash is least.
    """
    named, final = similar_sets(docs, spec, text)
    rows = named.join(final, named["sid"] == final["node"], "left").select("doc_id", "hash", "size", F.coalesce("component", "sid").alias("c"))
    texts = rows.where("size > 0").groupBy("c", "doc_id", "hash").agg(F.count("*").alias("n"))
    least = texts.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash", "n")).alias("r"))
    first = durable(least.select("r.doc_id", "r.hash", "r.n"), "kept")
    wordless = rows.where("size = 0").select("doc_id", "hash", F.lit(1).cast("long").alias("n")).distinct()

    key = tx.unused(docs, "hash")
    hashed = docs.withColumn(key, F.xxhash64(text))
    chosen = lambda keys: hashed.join(keys, hashed["doc_id"].eqNullSafe(keys["doc_id"]) & (hashed[key] == keys["hash"]), "left_semi")
    others = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    order = tx.unused(hashed, "order")
    repeated = chosen(first.where("n > 1")).withColumn(order, others)
    one = repeated.groupBy("doc_id", key).agg(F.min_by(F.struct(*[f"`{c}`" for c in docs.columns]), order).alias("row")).select("row.*")
    return chosen(first.where("n = 1").unionByName(wordless)).drop(key).unionByName(one)
