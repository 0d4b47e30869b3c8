"""Token counts of documents in flat, unindexed token files, by scanning for the separator."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstead.llm import text as tx
from loomstead.llm.bpe import TextEncoder
from loomstead.llm.storage import durable

#: Tokens that one task reads at a time.
BLOCK_TOKENS = 1 << 22


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, dtype: str = "<u2", text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Write every text's ids and ``end_id`` end to end, one flat file a task, below ``folder``.

    Returns the manifest (file, ordinal, row_id), which is written beside the files. A task
    that runs again writes a file of another name, and only the one it reports counts.
    ``folder`` is a URI that every executor can reach. Null and empty texts are the end id alone.
    """
    kind = docs.schema[row_id].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(tokenizer_path, plain=True)
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name, done, out = f"{uuid.uuid4().hex}.bin", 0, None
        try:
            for part in tx.slices(batches, "t"):
                out = out or fs.open_output_stream(f"{path}/{name}")
                ids, offsets = encoder([t or "" for t in part.column("t").to_pylist()])
                out.write(np.insert(ids, offsets[1:], end_id).astype(dtype).tobytes())
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * n), pa.array(np.arange(done, done + n)), part.column("id")], ["file", "ordinal", row_id])
                done += n
        finally:
            if out is not None:
                out.close()
            del encoder
            tx.give_back()

    own = docs.select(F.col(row_id).alias("id"), F.col(text).alias("t"))
    return durable(own.mapInArrow(run, f"file string, ordinal long, `{row_id}` {kind}"), "token-manifest")


def count_tokens(spark: SparkSession, files: DataFrame, end_id: int, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Each document of flat token files: file, ordinal, start, n_tokens, terminated.

    ``files`` has a column ``file`` of URIs. Files are read in blocks dealt over all tasks;
    each block yields its separators' places, and sums and maxima over a file's earlier
    blocks give a block its first ordinal and the start of the document that runs into it.
    ``n_tokens`` leaves the separator out. Tokens after a file's last separator are one
    document more, not terminated. An empty file has no documents; bytes that don't fill a
    last token are ignored; files listed twice are read once.
    """
    item = np.dtype(dtype).itemsize

    def sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uri in batch.column(0).to_pylist():
                fs, path = pyarrow.fs.FileSystem.from_uri(uri)
                found.append(fs.get_file_info(path).size // item)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["file", "tokens"])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, block, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = pyarrow.fs.FileSystem.from_uri(uri)
                begin = block * block_tokens
                with fs.open_input_file(path) as f:
                    f.seek(begin * item)
                    ids = np.frombuffer(f.read((min(begin + block_tokens, tokens) - begin) * item), dtype)
                ends = np.flatnonzero(ids == end_id) + begin
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([block], pa.int64()), pa.array([tokens], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], ["file", "block", "tokens", "ends"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = files.select("file").distinct().mapInArrow(sizes, "file string, tokens long").where("tokens > 0")
    blocks = sized.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / block_tokens))).alias("block"), "tokens")
    found = durable(blocks.repartition(parts, "file", "block").mapInArrow(search, "file string, block long, tokens long, ends array<long>"), "separators")

    # the prefix scan needs only a block's number of separators and its last one
    sums = found.select("file", "block", "tokens", F.size("ends").alias("n"), F.expr("try_element_at(ends, -1)").alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = sums.select(
        "file",
        "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"),
        (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("carry"),
    )
    placed = found.join(scanned, ["file", "block"])
    start = F.expr("if(at = 0, carry, ends[at - 1] + 1)")
    whole = placed.select("file", "ends", "base", "carry", F.posexplode("ends").alias("at", "end")).select("file", (F.col("base") + F.col("at")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("terminated"))
    tail = sums.groupBy("file").agg(F.sum("n").cast("long").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.max("tokens").alias("tokens"))
    tail = tail.where("tokens > start").select("file", "ordinal", "start", (F.col("tokens") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return whole.unionByName(tail)
