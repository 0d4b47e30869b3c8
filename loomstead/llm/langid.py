"""Language identification: multinomial naive Bayes over hashed character n-grams."""

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
from loomstead.operators.running import number_rows

UNDETERMINED = "und"
#: N-grams that are hashed at a time, so that a long text takes no more memory than a slice of short ones.
BLOCK_CHARS = 1 << 19
#: Languages whose counts one task holds before it hands them on.
HELD_LANGUAGES = 32
#: Languages that are collected, broadcast and scored at a time.
PART_LANGUAGES = 128


@dataclass
class ModelPart:
    """Log-probabilities of the hashed n-grams for some languages, in name order."""

    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray


@dataclass
class LanguageModel:
    """Counted n-grams of every language in shared storage, read a part at a time.

    The driver and each task hold one part, ``PART_LANGUAGES`` times ``buckets`` floats, however many languages there are.
    """

    table: DataFrame
    parts: int
    prior_total: int
    buckets: int
    orders: tuple[int, ...]
    smoothing: float

    @property
    def languages(self) -> list[str]:
        """All names, in order; prediction doesn't need them together."""
        return [r.label for r in self.table.select("label").orderBy("label").collect()]

    def part(self, k: int) -> ModelPart:
        rows = self.table.where(F.col("part") == k).orderBy("label").toArrow()
        names, prior, prob = rows["label"].to_pylist(), [], np.empty((rows.num_rows, self.buckets), np.float32)
        for i in range(rows.num_rows):
            bucket, n = (rows[c][i].values.to_numpy(zero_copy_only=False) for c in ("buckets", "counts"))
            grams = np.zeros(self.buckets + 1)
            grams[bucket] = n
            prior.append(np.log((grams[self.buckets] + 1) / self.prior_total))
            grams = grams[: self.buckets] + self.smoothing
            prob[i] = np.log(grams / max(grams.sum(), 1e-300))
        return ModelPart(names, np.array(prior), prob)


def _code_points(part: pa.RecordBatch, column: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Lower-cased texts, their code points end to end, and offsets."""
    texts = [(t or "").lower() for t in part.column(column).to_pylist()]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return texts, np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def hashed_ngrams(points: np.ndarray, offsets: np.ndarray, order: int, buckets: int, limit: int = BLOCK_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and text number of each n-gram of ``order`` characters, ``limit`` at a time; none crosses texts."""
    for begin in range(0, len(points) - order + 1, limit):
        n = min(limit, len(points) - order + 1 - begin)
        wide = points[begin : begin + n + order - 1].astype(np.uint64)
        total = np.full(n, np.uint64(order * 0x9E3779B97F4A7C15 % (1 << 64)), np.uint64)
        for k in range(order):
            total *= np.uint64(0x100000001B3)
            total += wide[k : k + n] + np.uint64(1)
            total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        at = np.arange(begin, begin + n)
        owner = np.searchsorted(offsets, at, "right") - 1
        inside = at + order <= offsets[owner + 1]
        yield ((total[inside] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), owner[inside]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = 1 << 16, orders: tuple[int, ...] = (2, 3), smoothing: float = 0.1) -> LanguageModel:
    """Count n-grams of every row that has a language and a text; each task sums before Spark does.

    Every language is learned, however many the column holds. Null languages and null texts
    are left out. An empty table gives a model without languages. Counts stay in shared storage, a row a language.
    """
    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    schema = "label string, bucket int, n long"

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for name, sums in table.items():
                used = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(sums[used])], ["label", "bucket", "n"])
            table.clear()

        for part in tx.slices(batches, "t"):
            names, of = np.unique(np.array(part.column("l").to_pylist(), object), return_inverse=True)
            texts = np.bincount(of)
            _, points, offsets = _code_points(part, "t")
            for low in range(0, len(names), HELD_LANGUAGES):
                some = names[low : low + HELD_LANGUAGES]
                sums = np.zeros((len(some), buckets + 1), np.int64)
                sums[:, buckets] = texts[low : low + len(some)]
                for order in orders:
                    for bucket, owner in hashed_ngrams(points, offsets, order, buckets):
                        mine = of[owner] - low
                        inside = (mine >= 0) & (mine < len(some)) if len(some) < len(names) else slice(None)
                        sums[:, :buckets] += np.bincount(mine[inside] * buckets + bucket[inside], minlength=len(some) * buckets).reshape(len(some), buckets)
                for name, own in zip(some, sums, strict=True):
                    table[name] = table[name] + own if name in table else own
                if len(table) > HELD_LANGUAGES:
                    yield from told()
        yield from told()
        tx.give_back()

    counted = rows.mapInArrow(count, schema).groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    packed = counted.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("grams"))
    packed = packed.select("label", F.col("grams.bucket").alias("buckets"), F.col("grams.n").alias("counts"))
    table = number_rows(packed, [F.col("label")], "place").withColumn("part", F.expr(f"place div {PART_LANGUAGES}"))
    texts = F.when(F.element_at("buckets", -1) == buckets, F.element_at("counts", -1)).otherwise(0)  # the last count is that of texts
    languages, total = table.agg(F.count("*"), F.sum(texts)).first()
    return LanguageModel(table, -(-languages // PART_LANGUAGES), (total or 0) + languages, buckets, orders, smoothing)


def _lettered(texts: list[str], points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; most are told by one from a to z."""
    ascii_letter = np.zeros(128, bool)
    ascii_letter[97:123] = True
    plain = np.concatenate([[0], np.cumsum(ascii_letter[np.minimum(points, 127)] & (points < 128))])
    found = plain[offsets[1:]] > plain[offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in texts[i])
    return found


def _score(docs: DataFrame, part: ModelPart, orders: tuple[int, ...], text: str, held: tuple[str, str, str], first: bool) -> DataFrame:
    """Add or bring up to date the likeliest language so far, its log-probability, and all others' sum as a share of it.

    A text without a letter has no likeliest language from the first part on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(part)

    def make():
        part = shared.value
        buckets = part.log_prob.shape[1]

        def step(rows: pa.RecordBatch) -> list[pa.Array]:
            n = rows.num_rows
            texts, points, offsets = _code_points(rows, text)
            total = np.repeat(part.log_prior[:, None], n, 1)
            for order in orders:
                for bucket, owner in hashed_ngrams(points, offsets, order, buckets):
                    for k in range(len(part.languages)):
                        total[k] += np.bincount(owner, weights=part.log_prob[k][bucket], minlength=n)
            best = total.argmax(0)
            top = total[best, np.arange(n)]
            share = np.exp(total - top).sum(0)
            names = [part.languages[b] for b in best]
            if first:
                names = [a if ok else None for a, ok in zip(names, _lettered(texts, points, offsets), strict=True)]
            else:
                name, was, rest = (rows.column(c) for c in held)
                was, rest = was.to_numpy(zero_copy_only=False), rest.to_numpy(zero_copy_only=False)
                new = top > was  # of equal ones the first by name stays
                share = np.where(new, share + rest * np.exp(np.minimum(was - top, 0)), rest + share * np.exp(np.minimum(top - was, 0)))
                names = [a if later and b is not None else b for a, b, later in zip(names, name.to_pylist(), new, strict=True)]
                top = np.maximum(top, was)
            return [pa.array(names, pa.string()), pa.array(top), pa.array(share)]

        return step

    fields = [T.StructField(held[0], T.StringType()), T.StructField(held[1], T.DoubleType()), T.StructField(held[2], T.DoubleType())]
    if first:
        return tx.append_columns(docs, fields, make, text)
    after = [T.StructField(f"{f.name}_", f.dataType) for f in fields]
    scored = tx.append_columns(docs, after, make, text)
    return scored.drop(*held).withColumnsRenamed({f"{c}_": c for c in held})


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the likeliest language and its posterior to every row.

    A null or empty text, one without a letter, and any text under a model without
    languages get ``und`` and 0.0. Equal posteriors go to the first name in order. Repeated
    rows are predicted one by one, an empty table gives an empty one. N-grams of a long text
    are summed block by block; it takes about ten bytes a character besides. With more than
    ``PART_LANGUAGES`` languages the rows are scored by each part of the model in turn, and written in between.
    Existing columns named like the new ones are replaced; others pass through.
    """
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in (pred, score)])
    held = tuple(tx.unused(kept, c) for c in ("language", "likely", "share"))
    scored = kept
    for k in range(model.parts):
        scored = _score(scored, model.part(k), model.orders, text, held, k == 0)
        if k < model.parts - 1:
            scored = durable(scored, "languages")
    if not model.parts:
        return kept.withColumns({pred: F.lit(UNDETERMINED), score: F.lit(0.0)})
    found = {pred: F.coalesce(held[0], F.lit(UNDETERMINED)), score: F.when(F.col(held[0]).isNotNull(), 1 / F.col(held[2])).otherwise(0.0)}
    return scored.withColumns(found).drop(*held)


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float = 0.5, text: str = "text") -> DataFrame:
    """Rows whose language is determined with a posterior of at least ``min_score``; columns stay as they are.

    Null, empty and letterless texts go, and of an empty table nothing stays.
    """
    lang, score = tx.unused(docs, "lang"), tx.unused(docs, "score")
    tagged = predict(docs, model, text, lang, score)
    return tagged.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= min_score)).drop(lang, score)


def fold(doc_id: str = "doc_id"):
    """crc32 of the id written as text, modulo 5; 0 is the held-out fold. A null id is in none."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5
