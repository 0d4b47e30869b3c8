"""A corpus preparation pipeline: STAGES in order, each written and reread as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.llm import langid, ngramjoin, packing, secrets, suffix
from loomstead.llm import text as tx
from loomstead.llm.storage import durable

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 50256
CAPACITY = 1024
#: Repeats that are cut. (The contract's 400 bytes, of ``op5``, leave most passages of 50 to 70 words.)
PASSAGE = suffix.PASSAGE

#: Bytes of an Arrow batch between Spark and its Python workers.
BATCH_BYTES = 1 << 20


def _begin(spark: SparkSession) -> None:
    """Hand texts to Python workers in batches of ``BATCH_BYTES``, for the rest of the session, and free what earlier stages left in the driver.

    Spark's own 64 MB are held by executor and worker alike, in and out, for every task. Plans,
    shuffles and broadcasts of a stage that is over go only when both the driver's Python and its JVM collect them.
    """
    tx.give_back()
    spark._jvm.System.gc()
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told: null or letterless texts, and posteriors under one half.

    The model learns from the documents' own texts and non-null languages. Long texts count whole; of an empty table nothing stays.
    """
    _begin(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row, of the smallest id, of each group that word 5-gram similarity of 0.75 or more connects.

    Rows without words stay. Whole texts are compared, long ones too; an empty table stays empty.
    """
    _begin(spark)
    return ngramjoin.keep_one(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every string of 256 bytes that occurs twice out of the texts, as passages of over 50 words are; no document goes.

    Repeated rows lose what they share, in each; null texts and an empty table stay as they are.
    """
    _begin(spark)
    return suffix.remove_repeats(docs, PASSAGE)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts; no document goes. The models are trained on these documents.

    Null and empty texts stay; with no secrets to learn from, as in an empty table, only the fixed patterns are masked.
    """
    _begin(spark)
    model = secrets.fit(secrets.labelled_tokens(docs))
    return secrets.redact(docs, model)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every document's pieces in sequences of 1024 tokens, each with its token ids.

    ``row_id`` tells the rows of ``docs`` apart where ids are null or repeated, so that every text can be
    put together again. Repeated rows are packed one by one, a null or empty text is its end
    token alone, and of an empty table nothing is packed.
    """
    _begin(spark)
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_id"))
    return packing.pack(packing.pieces(rows, BYTE_BPE, END_ID, CAPACITY, carry=("doc_id", "row_id"), with_ids=True), CAPACITY)


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("suffix_dedup", repeat_stage),
    ("secret_scan", secret_stage),
    ("best_fit_packing", packing_stage),
]

#: Naive Bayes, suffix ranks, Markov models and packing have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``; each reads only what the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name)
    return docs
