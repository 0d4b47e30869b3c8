"""Importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstead.llm import text as tx
from loomstead.llm.storage import durable


#: Root of the number of features at which a text's weight is the sum of their log ratios.
STRENGTH = 8.0


@dataclass
class RatioModel:
    """``log p_target - log p_raw`` of each hashed bucket; ``2 ** bits`` floats whatever the corpus."""

    log_ratio: np.ndarray


def _features(part: pa.RecordBatch, column: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every lower-cased word and word pair."""
    data, offsets = tx.utf8(part.column(column))
    data = tx.LOWER[data]
    start, end, owner = tx.words(data, offsets)
    one = tx.span_hashes(data, start, end)
    two, first = tx.windows(one, owner, 2)
    both = np.concatenate([one, two])
    return (both >> np.uint64(20)).astype(np.int64) % buckets, np.concatenate([owner, owner[first]])


def fit(docs: DataFrame, target: str, text: str = "text", bits: int = 16, smoothing: float = 1.0) -> RatioModel:
    """Model the rows where boolean column ``target`` is true against all rows.

    Each task sums its own buckets before the shuffle. Null texts have no features.
    """
    buckets = 1 << bits

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for part in tx.slices(batches, "t"):
            bucket, owner = _features(part, "t", buckets)
            raw += np.bincount(bucket, minlength=buckets)
            wanted = part.column("g").to_numpy(zero_copy_only=False).astype(bool)
            good += np.bincount(bucket[wanted[owner]], minlength=buckets)
        used = np.flatnonzero(raw)
        tx.give_back()
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(good[used])], ["bucket", "raw", "good"])

    rows = docs.select(F.col(text).alias("t"), F.coalesce(F.col(target), F.lit(False)).alias("g"))
    found = rows.mapInArrow(count, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    raw, good = np.full(buckets, smoothing), np.full(buckets, smoothing)
    raw[found["bucket"].to_numpy(int)] += found["raw"].to_numpy(float)
    good[found["bucket"].to_numpy(int)] += found["good"].to_numpy(float)
    return RatioModel(np.log(good / good.sum()) - np.log(raw / raw.sum()))


def weigh(docs: DataFrame, model: RatioModel, text: str = "text", weight: str = "log_weight", strength: float = STRENGTH) -> DataFrame:
    """Add each text's log importance weight: ``strength * sum / sqrt(n)`` over the log ratios of its n features.

    The plain sum grows with the text's length, which would decide alone, and is so large that the sampling's noise
    does next to nothing; the mean forgets how much evidence a long text is. Between them, a text of ``strength ** 2``
    features weighs its plain sum, longer ones less and shorter ones more. A null or wordless text weighs 0. A
    column named like the weight is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        table = shared.value.log_ratio

        def step(part: pa.RecordBatch) -> list[pa.Array]:
            bucket, owner = _features(part, text, len(table))
            total, n = (np.bincount(owner, weights=w, minlength=part.num_rows) for w in (table[bucket], None))
            return [pa.array(strength * total / np.sqrt(np.maximum(n, 1)))]

        return step

    return tx.append_columns(docs, [T.StructField(weight, T.DoubleType())], make, text)


def gumbel_key(weight: str, row_id: str, seed: int):
    """Weight plus Gumbel noise drawn from the row's id, so that a rerun task draws the same."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(row_id)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.col(weight) - F.log(-F.log(uniform))


def kth_largest(scores: DataFrame, column: str, k: int) -> float | None:
    """The exact k-th largest double (None if k < 1 or there are fewer rows).

    Radix selection over the order-preserving bits, 16 at a time: four grouped counts
    of at most 65,536 groups, so nothing larger reaches the driver.
    """
    if k < 1:
        return None

    def ordered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(bits < 0, ~bits ^ np.int64(-(1 << 63)), bits))], ["o"])

    keys = scores.select(F.col(column).cast("double").alias("x")).where("x is not null").mapInArrow(ordered, "o long")
    high, left = None, k
    for shift in (48, 32, 16, 0):
        rows = keys if high is None else keys.where(F.shiftright("o", shift + 16) == high)
        level = rows.groupBy(F.shiftright("o", shift).alias("d")).count().collect()
        for d, n in sorted(((r["d"], r["count"]) for r in level), reverse=True):
            if n >= left:
                high = d
                break
            left -= n
        else:
            return None
    bits = np.array([high], np.int64)
    return float(np.where(bits < 0, ~(bits ^ np.int64(-(1 << 63))), bits).view(np.float64)[0])


def resample(docs: DataFrame, model: RatioModel, fraction: float, text: str = "text", row_id: str = "doc_id", seed: int = 17) -> DataFrame:
    """Sample ``fraction`` of the rows without replacement in proportion to their importance.

    Returns ``row_id``, ``log_weight``, ``sample_key`` and ``kept`` for every row. The kept
    rows have the ``round(fraction * rows)`` largest keys; rows that tie with the last of
    them are kept too, which repeated ids may cause. Null, empty and wordless texts weigh 0;
    an empty table gives an empty result. A long text takes about five bytes a byte, and sixty
    a word.
    """
    scores = durable(weigh(docs.select(row_id, text), model, text).select(row_id, "log_weight", gumbel_key("log_weight", row_id, seed).alias("sample_key")), "importance")
    limit = kth_largest(scores, "sample_key", round(fraction * scores.count()))
    return scores.withColumn("kept", F.col("sample_key") >= F.lit(limit) if limit is not None else F.lit(False))


def mark_target(docs: DataFrame, labels: DataFrame, max_labels: int = 100_000, flag: str = "target") -> tuple[DataFrame, float]:
    """Flag documents labelled good (quality 1, not toxic), and the share of such labels.

    The models' target text comes from at most ``max_labels`` good labels (those of the least
    hashed ids), which bounds what is broadcast. A document labelled twice is good only if
    every label says so; labels with nulls count as not good. A column named like the flag is replaced;
    of an empty table nothing is flagged, and without labels the share is 0.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))).alias("good"))
    share = good.agg(F.avg(F.col("good").cast("int"))).first()[0]
    key = tx.unused(docs, "id")
    chosen = good.where("good").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).select(F.col("doc_id").alias(key), F.lit(True).alias(flag))
    return docs.drop(flag).join(F.broadcast(chosen), F.col("doc_id") == F.col(key), "left").drop(key), float(share or 0.0)
