"""Resampling towards a target's distribution, by counts of hashed word runs that DuckDB makes in each partition.

Each task hands slices of texts to a DuckDB of its own, whose SQL cuts words, makes runs of one and two
of them, hashes those with zlib's CRC and counts by bucket. The counts of each text are
written to shared storage as Parquet; Spark adds them up and scores every text from them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstead.llm.storage import durable
from loomstead.llm.text import give_back, runs, slices, unused, utf8
from loomstead.operators.running import number_rows

BUCKETS = 10_000
#: Texts longer than this many bytes go to DuckDB in blocks.
BLOCK_BYTES = 1 << 18
#: Bytes of text that one query of a task's DuckDB counts, or one block.
QUERY_BYTES = 1 << 20
#: Memory of a task's DuckDB; a query takes far less.
MEMORY = "400MB"
#: Spark draws with the shares of this many hash values.
_RANGE = 1 << 32
_KINDS = {"n_words": pa.int64(), "n_features": pa.int64(), "counts": pa.list_(pa.struct([("bucket", pa.int32()), ("n", pa.int32())]))}

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Rows are blocks of texts: ``led`` ones begin with the last word of the block before, which only completes a pair.
_SQL = """
    WITH cut AS (
        SELECT text_no, block, led, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
        FROM blocks
    ), placed AS (
        SELECT text_no, block, led, unnest(words) AS word, generate_subscripts(words, 1) AS nth FROM cut
    ), runs AS (
        SELECT text_no, led AND nth = 1 AS again, word, lead(word) OVER (PARTITION BY text_no, block ORDER BY nth) AS following FROM placed
    ), features AS (
        SELECT text_no, word AS feature, true AS single FROM runs WHERE NOT again
        UNION ALL
        SELECT text_no, word || ' ' || following, false FROM runs WHERE following IS NOT NULL
    ), counted AS (
        SELECT text_no, feature, single, count(*) AS n FROM features GROUP BY ALL
    ), hashed AS (
        SELECT feature, crc(feature) % {buckets} AS bucket FROM (SELECT DISTINCT feature FROM counted)
    ), bucketed AS (
        SELECT text_no, bucket, sum(n) AS n, sum(n) FILTER (single) AS words FROM counted JOIN hashed USING (feature) GROUP BY ALL
    )
    SELECT text_no, bucket::INTEGER AS bucket, n::BIGINT AS n, words::BIGINT AS words FROM bucketed
"""
#: The counts of all parts of a slice, as one list a text.
_LISTS = """
    SELECT text_no, sum(words)::BIGINT AS n_words, sum(n)::BIGINT AS n_features, list(struct_pack(bucket := bucket, n := n::INTEGER)) AS counts
    FROM (SELECT text_no, bucket, sum(n) AS n, coalesce(sum(words), 0) AS words FROM parts GROUP BY ALL) GROUP BY text_no
"""


def _crc(features: pa.Array) -> pa.Array:
    """zlib's CRC of each feature's UTF-8 bytes."""
    found: list[int] = []
    for part in features.chunks if isinstance(features, pa.ChunkedArray) else [features]:
        data, offsets = utf8(part)
        raw, ends = data.tobytes(), offsets.tolist()
        found += [zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    return pa.array(found, pa.uint32())


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> pa.Table:
    """Texts in blocks of about ``limit`` bytes, cut between words (``text_no``, ``block``, ``led``, ``body``).

    Every block of a text but its first is ``led`` by the last word before it. A word longer than
    a block stays whole.
    """
    data, offsets = utf8(texts)
    sizes = np.diff(offsets)
    if not len(sizes) or int(sizes.max()) <= limit:
        n = len(texts)
        return pa.table({"text_no": pa.array(np.arange(n)), "block": pa.array(np.zeros(n, np.int64)), "led": pa.array(np.zeros(n, bool)), "body": texts})
    out: list[tuple[int, int, bool, bytes]] = []
    for k in range(len(sizes)):
        own = data[offsets[k] : offsets[k + 1]]
        if len(own) <= limit:
            out.append((k, 0, False, own.tobytes()))
            continue
        start, end = runs(_IS_WORD[own], np.array([0, len(own)]))
        edges = np.unique(np.append(np.searchsorted(start, np.arange(0, len(own), limit)), len(start)))
        for block, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            lead = own[start[a - 1] : end[a - 1]].tobytes() + b" " if block else b""
            out.append((k, block, block > 0, lead + own[start[a] : end[b - 1]].tobytes()))
    columns = list(zip(*out, strict=True)) or [()] * 4
    return pa.table({"text_no": pa.array(columns[0], pa.int64()), "block": pa.array(columns[1], pa.int64()), "led": pa.array(columns[2], pa.bool_()), "body": pa.array([b.decode() for b in columns[3]], pa.large_string())})


def _counter(buckets: int) -> Callable[[pa.Array], dict[str, pa.Array]]:
    """A task's DuckDB, as a function of a slice's texts."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
    con.create_function("crc", _crc, ["VARCHAR"], "UINTEGER", type="arrow")
    query = _SQL.format(buckets=buckets)

    def over(view: str, table: pa.Table, sql: str) -> pa.Table:
        con.register(view, table)
        found = con.sql(sql).to_arrow_table()
        con.unregister(view)
        return found

    def count(texts: pa.Array) -> dict[str, pa.Array]:
        cut = blocks(texts)
        sizes = pc.fill_null(pc.binary_length(cut["body"]), 0).to_numpy()
        edges = np.flatnonzero(np.diff(np.cumsum(sizes) // QUERY_BYTES, prepend=-1)).tolist()  # a long text's blocks are counted a few at a time
        parts = [over("blocks", cut.slice(a, b - a), query) for a, b in zip(edges, [*edges[1:], cut.num_rows], strict=True)]
        found = over("parts", pa.concat_tables(parts), _LISTS) if parts else pa.table({"text_no": pa.array([], pa.int64())})
        if not found.num_rows:
            return {name: pa.nulls(len(texts), kind) for name, kind in _KINDS.items()}
        at = np.full(len(texts), -1)
        at[found["text_no"].to_numpy()] = np.arange(found.num_rows)
        take = pa.array(np.where(at < 0, 0, at), mask=at < 0)
        return {name: found[name].combine_chunks().take(take).cast(kind) for name, kind in _KINDS.items()}

    return count


def count_buckets(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Replace ``text`` by its counts, written to shared storage: ``n_words``, ``n_features`` and ``counts`` (bucket, n).

    A feature is a run of one or two neighbouring words of the text (letters A to Z as small ones), its bucket its CRC's
    remainder. Null, empty and wordless texts have none: zeros and empty lists. Whole texts count, long ones in blocks. Other
    columns stay, but those of the new names are replaced.
    """
    pair = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.IntegerType())])
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("counts", T.ArrayType(pair))]
    new = {f.name for f in fields}
    body = unused(docs, "body")
    others = [c for c in docs.columns if c != text and c.lower() not in new]
    rows = docs.select(*[f"`{c}`" for c in others], F.col(f"`{text}`").alias(body))
    schema = T.StructType([*rows.schema.fields[:-1], *fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(buckets)
        try:
            for part in slices(batches, body):
                found = count(part.column(body))
                kept = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, *[found[f.name] for f in fields]], [*others, *[f.name for f in fields]])
        finally:
            del count
            give_back()

    made = rows.mapInArrow(run, schema)
    filled = {"n_words": F.coalesce("n_words", F.lit(0).cast("long")), "n_features": F.coalesce("n_features", F.lit(0).cast("long")), "counts": F.coalesce("counts", F.array().cast(fields[2].dataType))}
    return durable(made.withColumns(filled), "bucket-counts")


def bucket_totals(counted: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How many features of all texts are in each bucket: added up by task, then by Spark; one number a bucket comes here."""
    pairs = counted.select(F.explode("counts").alias("p"))
    found = pairs.groupBy("p.bucket").agg(F.sum("p.n").alias("n")).collect()
    totals = [0] * buckets
    for bucket, n in found:
        totals[bucket] = n
    return totals


def bucket_gains(raw: list[int], target: list[int]) -> list[int]:
    """What one feature of each bucket adds to a text's weight: thousandths of the smoothed models' log ratio, rounded down."""
    every, wanted, k = sum(raw), sum(target), len(raw)
    return [math.floor(1000 * math.log((t + 1) * (every + k) / ((s + 1) * (wanted + k)))) for s, t in zip(raw, target, strict=True)]


def _weight(gains: list[int]) -> Column:
    """The mean of a text's gains, rounded down."""
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.get(table, c["bucket"]) * c["n"])
    n = F.greatest("n_features", F.lit(1))
    return F.call_function("div", total - F.pmod(total, n), n)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """Draw ``percent`` of the texts that have ``least_words`` words, with the target's buckets over all texts' as weights.

    ``docs`` has doc_id and text, ``target`` text. Returns every row's doc_id, n_words, n_features, weight
    (mean gain, 0 without features), score (weight plus the Gumbel noise of the id's hash, in thousandths, rounded
    down) and rank (1, 2, ... of those drawn, else null). Scores that tie go by doc_id, null
    last; a null id is hashed as nothing, and rows of one id, or repeated rows, are drawn one
    by one, in any order where all is equal. Ranks are places in a range sort, so no
    task gets all rows. With an empty target the weights are those of the smoothing alone; of
    empty ``docs`` nothing is drawn.
    """
    counted = count_buckets(docs.select("doc_id", "text"), buckets=buckets)
    gains = bucket_gains(bucket_totals(counted, buckets), bucket_totals(count_buckets(target.select("text"), buckets=buckets), buckets))
    share = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") + 0.5) / _RANGE
    weighed = counted.select("doc_id", "n_words", "n_features", _weight(gains).alias("weight"), F.monotonically_increasing_id().alias("row"))
    scored = durable(weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(share)))), "scores")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    placed = number_rows(able, [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("row")], "place")
    ranked = placed.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1)).drop("place")
    others = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others).drop("row")
