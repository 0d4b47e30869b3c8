"""Removal of repeated substrings: prefix doubling over positions that content samples, then exact extents.

Of the positions of a text those are sampled whose bytes hash to the least value among any
``reach`` neighbours. Equal strings of ``length`` bytes have a sampled position at the same
place, with ``core`` bytes after it in the string; so only sampled positions need ranks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstead.llm import text as tx
from loomstead.llm.bitmap import bitmap, in_bitmap
from loomstead.llm.storage import discard, durable, new_path

#: Text bytes whose grams a task names at a time; names of all levels take about a hundred bytes a byte.
GRAM_BYTES = 1 << 18
#: Bits of the bitmap of texts that still have candidates.
FILTER_BITS = 26
FACTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
PASSAGE_FACTS = ("n_passage_bytes", "n_passages")
_EDGE = np.uint64((1 << 64) - 1)


@dataclass(frozen=True)
class RepeatSpec:
    """Length of a repeat in bytes, 128 to 4096."""

    length: int = 400

    def __post_init__(self):
        if not 128 <= self.length <= 4096:
            raise ValueError("repeats are of 128 to 4096 bytes")

    @property
    def reach(self) -> int:
        return self.length * 48 // 100

    @property
    def core(self) -> int:
        """Bytes from a position on that each of its strings covers; a multiple of four."""
        return (self.length - self.reach) // 4 * 4

    @property
    def block(self) -> int:
        """Bytes of the strings that are ranked first; ranks of pairs at this offset and twice it make the core's."""
        return self.core // 4

    @property
    def level(self) -> int:
        """Doublings from eight bytes to the unit that a block is covered with."""
        return (self.block // 8).bit_length() - 1

    @property
    def steps(self) -> list[int]:
        """Sizes of the offset ranges that are told apart in turn."""
        sizes = [1]
        while sizes[-1] * 8 < self.reach:
            sizes.append(sizes[-1] * 8)
        return sizes[::-1]


#: What counts as a passage of over 50 words: 51 words of four letters and a space.
PASSAGE = RepeatSpec(256)


def sample(grams: np.ndarray, offsets: np.ndarray, spec: RepeatSpec) -> tuple[np.ndarray, ...]:
    """Sampled positions: row, byte position in the slice, and the offsets they answer for.

    ``grams`` names the 16 bytes from each place on. The string that starts ``d`` bytes before
    a position is its own for ``low <= d <= high``; every string of ``spec.length`` bytes
    inside a text is exactly one position's own, and equal strings have their positions at
    equal offsets.
    """
    starts = np.concatenate([np.zeros(0, np.int64), *[np.arange(s, e - spec.length + 1) for s, e in zip(offsets[:-1], offsets[1:], strict=True) if e - s >= spec.length]])
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    bits = np.uint64(int(offsets[-1]).bit_length())
    value = (grams >> bits << bits) | np.arange(len(grams)).astype(np.uint64)
    size = spec.reach
    padded = np.full(-(-len(value) // size) * size + size, _EDGE)
    padded[: len(value)] = value
    blocks = padded.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[starts], ahead[starts + size - 1])
    chosen = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    first = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])))
    last = np.append(first[1:], len(starts)) - 1
    where = chosen[first]
    return row[first], where, where - starts[last], where - starts[first]


def _blocks(names: tx.SpanNames, where: np.ndarray, spec: RepeatSpec, begin: int) -> list[np.ndarray]:
    """Names of the two blocks that stand ``begin`` blocks after each position."""
    return [names(where + k * spec.block, where + (k + 1) * spec.block).view(np.int64) for k in (begin, begin + 1)]


def _digests(part: pa.RecordBatch, column: str) -> tuple[np.ndarray, list[str]]:
    """Name (64 bits) and hexadecimal SHA-256 of each text; equal texts have equal names."""
    found = [hashlib.sha256(t or b"").digest() for t in pc.fill_null(part.column(column), "").cast(pa.binary()).to_pylist()]
    return np.frombuffer(b"".join(d[:8] for d in found), np.int64), [d.hex() for d in found]


def _survey(docs: DataFrame, spec: RepeatSpec, text: str) -> DataFrame:
    """Rows of documents (doc_id, name, n_bytes, sha256), and of sampled positions (name, pos, one, two).

    ``one`` and ``two`` name a position's first two blocks.
    """
    names = ["doc_id", "name", "n_bytes", "sha256", "pos", "one", "two"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, text, GRAM_BYTES):
            name, digest = _digests(part, text)
            data, offsets = tx.utf8(part.column(text))
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(name), pa.array(np.diff(offsets)), pa.array(digest), *[pa.nulls(n, pa.int64())] * 3], names)
            levels = tx.gram_names(data, max(1, spec.level))
            row, where, _, _ = sample(levels[1], offsets, spec)
            if len(row):
                one, two = _blocks(tx.SpanNames(levels[spec.level], spec.level), where, spec, 0)
                n = len(row)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(name[row]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array(where - offsets[row]), pa.array(one), pa.array(two)], names)
        tx.give_back()

    return docs.mapInArrow(run, "doc_id long, name long, n_bytes long, sha256 string, pos long, one long, two long")


def _rerank(positions: DataFrame, left: str, right: str, rank: str) -> DataFrame:
    """One round of doubling: rank the pairs (``left``, ``right``) that stand at two positions; other positions go.

    Pairs are counted before they are shuffled, sorted by both ranks and numbered in that
    order: a partition's first number is the sum of what the ones before it hold. Positions
    get their pair's number by a join, which Spark splits where a pair is very common.
    """
    at = F.xxhash64("name", "pos")
    shared = positions.groupBy(left, right).agg(F.min(at).alias("a"), F.max(at).alias("z")).where("a <> z").select(left, right)

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, task, np.int32)), pa.array(np.arange(done, done + n))], [left, right, "task", "nth"])
            done += n

    ordered = durable(shared.sort(left, right).mapInArrow(number, f"{left} long, {right} long, task int, nth long"), "pairs")
    held = sorted((r["task"], r["n"]) for r in ordered.groupBy("task").agg(F.count("*").alias("n")).collect())
    base = np.cumsum([0, *[n for _, n in held]])
    bases = positions.sparkSession.createDataFrame([(t, int(b)) for (t, _), b in zip(held, base, strict=False)], "task int, base long")
    ranked = durable(ordered.join(F.broadcast(bases), "task").select(left, right, (F.col("base") + F.col("nth")).alias(rank)), "ranks")
    discard(ordered)
    kept = durable(positions.join(ranked, [left, right]).drop(left, right), "positions")
    discard(ranked)
    return kept


def _candidates(docs: DataFrame, wanted: DataFrame, spec: RepeatSpec, text: str) -> str:
    """Write the distinct texts that ``wanted`` (column name) lists, bucketed by name; returns the table's name.

    A bitmap of fixed size lets most other texts go at once; the join on the name is exact.
    """
    spark = docs.sparkSession
    bits = 1 << FILTER_BITS
    packed = bitmap(wanted.select(F.col("name").alias("hash")), bits)
    shared = spark.sparkContext.broadcast(packed)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = shared.value
        told: set[int] = set()
        for part in tx.slices(batches, "body"):
            name, _ = _digests(part, "body")
            keep = [i for i in np.flatnonzero(in_bitmap(mask, name, bits)).tolist() if name[i] not in told and (len(told) > 1_000_000 or not told.add(name[i]))]
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(name[keep]), part.column("body").take(pa.array(keep)).cast(pa.binary())], ["name", "body"])
        tx.give_back()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bodies = docs.select(F.col(text).alias("body")).where(F.col("body").isNotNull()).mapInArrow(run, "name long, body binary")
    bodies = bodies.groupBy("name").agg(F.first("body").alias("body")).join(wanted, "name", "left_semi")
    table = f"loomstead_repeats_{uuid.uuid4().hex}"
    writer = bodies.repartition(parts, "name").write.format("parquet").bucketBy(parts, "name").sortBy("name")
    writer.option("path", new_path(spark, "bodies")).saveAsTable(table)  # in shared storage, wherever the warehouse is
    return table


def _drop(spark: SparkSession, table: str) -> None:
    """Forget a table of :func:`_candidates` and delete its files."""
    if spark.catalog.tableExists(table):
        discard(spark.table(table))
        spark.sql(f"DROP TABLE {table}")


_CELLS = "name long, pos long, low int, size int, length int, open boolean, from int, to int, own long, core long"


def _name_cells(bodies: DataFrame, cells: DataFrame, spec: RepeatSpec) -> DataFrame:
    """Name the strings of each cell: ``length`` bytes at offsets ``low .. low + size - 1`` before a position.

    ``own`` names the bytes that all the cell's strings cover together (null where they leave
    the text), ``core`` the bytes that each of them covers; cells of two lengths share no name.
    """
    state = cells.groupBy("name").agg(F.collect_list(F.struct("pos", "low", "size", "length", "open", "from", "to")).alias("cells"))
    level = min(4, ((spec.length - spec.reach) // 8).bit_length() - 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "body", GRAM_BYTES):
            data, offsets = tx.utf8(part.column("body").cast(pa.string()))
            lists = part.column("cells")
            flat = lists.flatten()
            row = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy())
            pos, low, size, length = (flat.field(k).to_numpy().astype(np.int64) for k in range(4))
            names = tx.SpanNames(tx.gram_names(data, level)[level], level)
            here = pos + offsets[row]
            start, end = here - low - size + 1, here - low + length
            core_start, core_end = here - low, here - low - size + 1 + length
            ok = (core_start >= offsets[row]) & (core_end <= offsets[row + 1])
            whole = (start >= offsets[row]) & (end <= offsets[row + 1])
            start, end = np.where(whole, start, here), np.where(whole, end, here)
            core_start, core_end = np.where(ok, core_start, here), np.where(ok, core_end, here)
            tag = tx.mix(low * 8192 + size)
            own = tx.joined(names(start, end), tag).view(np.int64)
            core = tx.joined(names(core_start, core_end), tag).view(np.int64)
            name = part.column("name").to_numpy()[row]
            columns = [pa.array(name), *(flat.field(k) for k in range(7)), pa.array(own, mask=~whole), pa.array(core)]
            yield pa.RecordBatch.from_arrays(columns, ["name", "pos", "low", "size", "length", "open", "from", "to", "own", "core"]).filter(pa.array(ok))
        tx.give_back()

    return bodies.join(state, "name").select("name", "body", "cells").mapInArrow(run, _CELLS)


def _told_apart(named: DataFrame, by_core: bool) -> DataFrame:
    """Add ``again``: the cell's own bytes occur at two positions.

    Of positions with the same own bytes one goes on (``first``), for others to match.
    ``by_core`` keeps cells whose core another position shares, while one of the group is
    open. Both counts are tables of their own, so that Spark can split the joins with them
    where a string is very common.
    """
    at = F.struct("name", "pos")
    owns = durable(named.where("own is not null").groupBy("own").agg(F.min(at).alias("a"), F.max(at).alias("z")).where("a < z").select("own", "a"), "owns")
    kept = named
    if by_core:
        cores = durable(named.groupBy("core").agg(F.min(at).alias("a"), F.max(at).alias("z"), F.max("open").alias("any_open")).where("a < z and any_open").select("core"), "cores")
        kept = named.join(cores, "core", "left_semi")
    kept = kept.join(owns, "own", "left").withColumn("again", F.col("a").isNotNull()).withColumn("first", F.coalesce(F.col("a") == at, F.lit(True)))
    found = durable(kept.drop("a", "own", "core"), "state")
    discard(owns)
    if by_core:
        discard(cores)
    return found


def repeated_spans(docs: DataFrame, spec: RepeatSpec = RepeatSpec(), text: str = "text", longer: tuple[int, ...] = ()) -> tuple[DataFrame, DataFrame, str]:
    """Find the strings of ``spec.length`` bytes that occur twice, and those of the ``longer`` lengths.

    Returns the documents (doc_id, name, n_bytes, sha256, copies), the spans (name, length,
    start, end) of distinct texts, which may overlap, and the bucketed table of the texts that
    have any. A longer string is looked for at the position of its first ``spec.length`` bytes,
    which occur twice if it does.

    Prefix doubling ranks the strings that begin at sampled positions. A round sorts the pairs
    of each position's rank and that of the position one rank's length further on, numbers
    them, and drops the positions whose pair is unique: blocks make ranks of two blocks, and
    those, at twice the offset, ranks of the core. Past that threshold an exact check
    follows: the offsets that a position answers for are told apart in ranges of falling size;
    a range whose bytes all occur elsewhere together is repeated, one whose common bytes don't
    isn't, and the rest is split. Blocks and ranges are compared by 64-bit names (two
    different strings among N share one with a chance of about N * N / 2**65). Whole copies
    are one text throughout.
    """
    survey = durable(_survey(docs.select(F.col("doc_id").cast("long"), text), spec, text), "survey")
    rows = survey.where("one is null").select("doc_id", "name", "n_bytes", "sha256")
    copies = durable(rows.where(F.col("n_bytes") >= spec.length).groupBy("name").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    fronts = _rerank(survey.where("one is not null").select("name", "pos", "one", "two"), "one", "two", "front")
    live = durable(fronts.distinct(), "live")
    discard(fronts)
    table = _candidates(docs, live.select("name").distinct(), spec, text)
    spark = docs.sparkSession
    try:
        bodies = spark.table(table)
        halves = durable(live.join(_own_ranges(bodies, spec), ["name", "pos"]), "halves")
        backs = _rerank(halves, "three", "four", "back")
        discard(live)
        discard(halves)
        cores = _rerank(backs, "front", "back", "core")
        discard(backs)
        whole = copies.select("name", F.lit(True).alias("copied"))
        ranges = durable(cores.join(whole, "name", "left").select("name", "pos", "low", "high", F.col("copied").isNull().alias("open")), "ranges")
        discard(cores)
        return rows.join(copies, "name", "left"), _extents(bodies, ranges, spec, (spec.length, *longer)), table
    except BaseException:
        _drop(spark, table)
        raise


def _extents(bodies: DataFrame, ranges: DataFrame, spec: RepeatSpec, lengths: tuple[int, ...]) -> DataFrame:
    """Spans (name, length, start, end) of the repeated strings of each length that the positions in ``ranges`` answer for."""
    # the first range is a position's own offsets (those of one core may differ, so cores rule
    # nothing out there), the cells after it lie on a common grid
    cells = ranges.select("name", "pos", "low", (F.col("high") - F.col("low") + 1).cast("int").alias("size"), F.explode(F.array(*map(F.lit, lengths))).alias("length"), "open", F.col("low").alias("from"), F.col("high").alias("to"))
    found = last = None
    for turn, size in enumerate([*spec.steps, 0]):
        named = durable(_name_cells(bodies, cells, spec), "cells")
        state = _told_apart(named, turn > 0)
        discard(named)
        discard(ranges if last is None else last)
        spans = durable(state.where("open and again").select("name", "length", (F.col("pos") - F.col("low") - F.col("size") + 1).alias("start"), (F.col("pos") - F.col("low") + F.col("length")).alias("end")), "spans")
        found = spans if found is None else found.unionByName(spans)
        if size:
            going = state.where("not again or first").withColumn("open", F.expr("open and not again"))
            begin = F.greatest("low", "from")
            end = F.least(F.col("low") + F.col("size") - 1, F.col("to"))
            steps = F.sequence((F.floor(begin / size) * size).cast("int"), end.cast("int"), F.lit(size))
            cells = going.select("name", "pos", F.explode(steps).alias("low"), F.lit(size).alias("size"), "length", "open", "from", "to")
        last = state
    discard(last)
    return found


def _own_ranges(bodies: DataFrame, spec: RepeatSpec) -> DataFrame:
    """Every sampled position of the texts with the offsets it answers for and its blocks three and four."""
    names = ["name", "pos", "low", "high", "three", "four"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "body", GRAM_BYTES):
            data, offsets = tx.utf8(part.column("body").cast(pa.string()))
            levels = tx.gram_names(data, max(1, spec.level))
            row, where, low, high = sample(levels[1], offsets, spec)
            three, four = _blocks(tx.SpanNames(levels[spec.level], spec.level), where, spec, 2)
            name = part.column("name").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(where - offsets[row]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(three), pa.array(four)], names)
        tx.give_back()

    return bodies.mapInArrow(run, "name long, pos long, low int, high int, three long, four long")


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs of spans that may overlap or touch."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1]) if len(start) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1] if len(first) else end


_KEPT = "name long, n_removed long, n_spans long, n_passage_bytes long, n_passages long, kept_sha256 string"


def _digest_kept(bodies: DataFrame, spans: DataFrame, spec: RepeatSpec, passage: RepeatSpec | None) -> DataFrame:
    """(name, n_removed, n_spans, n_passage_bytes, n_passages, kept_sha256, kept) of each text that has spans; the last two are null where only passages are found."""
    lists = spans.distinct().groupBy("name").agg(F.collect_list(F.struct("length", "start", "end")).alias("spans"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            n, found, bodies = part.num_rows, part.column("spans"), part.column("body")
            flat = found.flatten()
            row = np.repeat(np.arange(n), pc.list_value_length(found).to_numpy())
            length, start, end = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
            base = np.cumsum(np.append(0, pc.binary_length(bodies).to_numpy().astype(np.int64) + 1))  # a byte apart, so that no run is in two texts

            def covered(size: int, length=length, start=start, end=end, at=base[row]) -> tuple[np.ndarray, np.ndarray]:
                own = length == size
                return merged(start[own] + at[own], end[own] + at[own])

            def counts(first: np.ndarray, last: np.ndarray, base=base) -> tuple[np.ndarray, np.ndarray]:
                total, until = np.append(0, np.cumsum(last - first)), np.searchsorted(first, base)
                return np.diff(total[until]), np.diff(until)

            first, last = covered(spec.length)
            removed, spans = counts(first, last)
            until, digests, kept = np.searchsorted(first, base), [None] * n, [None] * n
            for i in np.flatnonzero(spans).tolist():
                body, runs = bodies[i].as_py(), slice(until[i], until[i + 1])
                edges = [0, *(np.stack([first[runs], last[runs]], 1).ravel() - base[i]).tolist(), len(body)]
                kept[i] = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                digests[i] = hashlib.sha256(kept[i]).hexdigest()
            passages = counts(*covered(passage.length)) if passage else (removed, spans)
            numbers = [pa.array(x, pa.int64()) for x in (removed, spans, *passages)]
            yield pa.RecordBatch.from_arrays([part.column("name"), *numbers, pa.array(digests, pa.string()), pa.array(kept, pa.binary())], ["name", "n_removed", "n_spans", *PASSAGE_FACTS, "kept_sha256", "kept"])

    return bodies.join(lists, "name").select("name", "body", "spans").mapInArrow(run, f"{_KEPT}, kept binary")


def remove_repeats(docs: DataFrame, spec: RepeatSpec = RepeatSpec(), text: str = "text", facts: bool = False, passage: RepeatSpec | None = None) -> DataFrame:
    """Documents without their repeated strings; columns stay as they are.

    A byte goes if it is in a string of ``spec.length`` bytes that also starts anywhere else.
    Where a cut leaves part of a character, its bytes go too. Texts that occur as whole copies
    of ``spec.length`` bytes or more become empty, null texts stay null, an empty table stays
    empty. Rows repeated under one id are documents of their own. A text takes about forty
    bytes a byte while its positions are ranked.

    With ``facts`` the long columns n_bytes, n_removed, n_spans and the string kept_sha256 (of
    the bytes that remain, before parts of characters go) are added, or replaced. With
    ``passage``, a shorter length, the long columns n_passage_bytes and n_passages follow: the
    bytes that strings of that length cover which occur twice, and their maximal runs. Only
    those of ``spec.length`` are removed; both lengths are found over the same ranks.
    """
    if passage and not (facts and passage.length < spec.length):
        raise ValueError("passages are facts, of a length below that of what is removed")
    added = (*FACTS, *PASSAGE_FACTS) if passage else FACTS if facts else ()
    own = [c for c in docs.columns if c not in added]
    name, cut_name, cut_text = tx.unused(docs, "name"), tx.unused(docs, "cut_name"), tx.unused(docs, "cut")

    def name_of(part: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(_digests(part, text)[0])]

    rows, spans, table = repeated_spans(docs.select(F.lit(0).cast("long").alias("doc_id"), text), passage or spec, text, (spec.length,) if passage else ())
    try:
        gone = F.col("n_bytes") >= spec.length  # other whole copies are passages only
        copied = rows.where("copies is not null").select(
            "name",
            F.when(gone, F.col("n_bytes")).otherwise(0).alias("n_removed"),
            F.when(gone, 1).otherwise(0).cast("long").alias("n_spans"),
            F.col("n_bytes").alias("n_passage_bytes"),
            F.lit(1).cast("long").alias("n_passages"),
            F.when(gone, hashlib.sha256(b"").hexdigest()).alias("kept_sha256"),
            F.when(gone, "").alias("cut"),
        )
        cut = _as_text(_digest_kept(docs.sparkSession.table(table), spans, spec, passage))
        cuts = durable(cut.join(copied.distinct(), "name", "left_anti").unionByName(copied.distinct()), "cuts")
    finally:
        _drop(docs.sparkSession, table)
    named = tx.append_columns(docs.select(*[f"`{c}`" for c in own]), [T.StructField(name, T.LongType())], lambda: name_of, text)
    joined = named.join(cuts.withColumnsRenamed({"name": cut_name, "cut": cut_text}), F.col(name) == F.col(cut_name), "left")
    body = F.col(f"`{text}`")
    new = F.when(body.isNull(), F.lit(None)).otherwise(F.coalesce(cut_text, body)).alias(text)

    def number(column: str) -> Column:
        return F.coalesce(cuts[column], F.lit(0)).cast("long").alias(column)

    more = [
        F.coalesce(F.octet_length(body), F.lit(0)).cast("long").alias("n_bytes"),
        number("n_removed"),
        number("n_spans"),
        F.coalesce(cuts["kept_sha256"], F.sha2(F.coalesce(body, F.lit("")).cast("binary"), 256)).alias("kept_sha256"),
        *([number(c) for c in PASSAGE_FACTS] if passage else []),
    ]
    return joined.select(*[new if c == text else named[f"`{c}`"] for c in own], *(more if facts else []))


def digest_removed(docs: DataFrame, spec: RepeatSpec = RepeatSpec(), text: str = "text", passage: RepeatSpec | None = None) -> DataFrame:
    """What removing every repeated string leaves: doc_id, n_bytes, n_removed, n_spans, kept_sha256, the remaining text, and with ``passage`` n_passage_bytes and n_passages.

    Null texts count as empty; rows repeated under one id are documents of their own.
    """
    return remove_repeats(docs.select("doc_id", text), spec, text, True, passage).select("doc_id", *FACTS, text, *(PASSAGE_FACTS if passage else ()))


def _as_text(cut: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = [None if b is None else b.decode("utf-8", "ignore") for b in part.column("kept").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*part.schema.names[:-1], "cut"])

    return cut.mapInArrow(run, f"{_KEPT}, cut string")
