"""The subpackage's registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.llm import bpe, conversations, importance, langid, lattice, ngramjoin, packing, risk_rules, secrets, shards, suffix, target_resampling, tokenscan, twins
from loomstead.llm.storage import durable, new_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample as large a share of the documents as the labels call good."""
    docs, share = importance.mark_target(_documents(spark, sf_dir).select("doc_id", "text"), _labels(spark, sf_dir))
    return importance.resample(docs.select("doc_id", "text"), importance.fit(docs, "target"), share)


def op2_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every document by base rules and by cutoffs that the labels certify for its language."""
    judged, _ = risk_rules.judge(_documents(spark, sf_dir), _labels(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings of one label."""
    return lattice.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with models trained on the documents' own tokens."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    found = secrets.scan(docs, secrets.fit(secrets.labelled_tokens(docs)))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined("secrets").alias("spans"), count("random"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove strings of 400 bytes that repeat; the facts of the removal, the text that remains, and how much of the whole text is in repeated passages of over 50 words (256 bytes)."""
    return suffix.digest_removed(_documents(spark, sf_dir).select("doc_id", "text"), passage=suffix.PASSAGE)


def op6_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    ids = bpe.encode(docs, WORD_BPE).select("doc_id", "ids")
    return bpe.decode(ids, WORD_BPE).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 1024 tokens."""
    cut = packing.pieces(_documents(spark, sf_dir).select("doc_id", "text"), BYTE_BPE, end_id=2, capacity=1024)
    return packing.pack(cut, 1024).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict every document's language by a model of the other folds."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.fit(docs.where(langid.fold() != 0))
    out = langid.predict(docs.select("doc_id", F.coalesce(langid.fold() == 0, F.lit(False)).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the documents as flat token files, then count each one's tokens by scanning them."""
    folder = new_path(spark, "tokens")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    try:
        manifest = tokenscan.write_token_files(_documents(spark, sf_dir).select("doc_id", "text"), folder, BYTE_BPE, end_id=50256)
        counts = tokenscan.count_tokens(spark, manifest.select("file"), end_id=50256)
        return durable(manifest.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens", "terminated"), "token-counts")
    finally:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join all documents whose sets of word shingles are similar."""
    return ngramjoin.connect(_documents(spark, sf_dir).select("doc_id", "text"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw a quarter of the documents of at least 20 words, towards the benchmark's distribution."""
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    found = target_resampling.resample(_documents(spark, sf_dir).select("doc_id", "text"), target)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage all conversations by the contract's rule, then find and apply each one's cheapest repair."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = conversations.repair(conversations.damage(turns)).withColumnRenamed("conv_id", "repaired_id")
    every = turns.select("conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("repaired_id")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    rows = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce(rows, F.lit("")), 256).alias("repaired_sha256"))


def op13_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deal all documents to 40 shards along a Hilbert curve through language, source, size and id.

    The law is ``rows``. Texts are measured where they are read and take no part in the sort.
    Equal texts in one cell of the curve are neighbours.
    """
    docs = _documents(spark, sf_dir)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    measured = docs.select("doc_id", "lang", "source", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    dealt = shards.assign(measured, ["lang", "source", "size", "doc_id"], 40, ties=["text_crc32", "doc_id"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_importance_resampling, op2_risk_controlled_rules, op3_lattice_dedup, op4_secret_scan, op5_suffix_dedup, op6_speculative_bpe, op7_best_fit_packing, op8_language_id, op9_token_counts, op10_ngram_jaccard_join, op11_target_resampling, op12_conversation_repair, op13_hilbert_sharding]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return twins.SQL
