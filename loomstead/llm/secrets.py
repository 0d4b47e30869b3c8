"""Secret scanning: fixed patterns, and character Markov models of random and ordinary strings."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstead.llm import text as tx
from loomstead.llm.storage import durable

KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: One of these stands in every text that the assignment pattern matches.
_ASSIGN_STEMS = ("passw", "secret", "token", "apikey", "api_key")
#: A run of the class takes all that follows, so a length in the pattern drops the same matches.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX_MIN = 16
_ASSIGN_MIN = 12

_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.zeros(256, np.int64)
_CODE[list(_ALPHABET)] = np.arange(1, len(_ALPHABET) + 1)
_STATES = len(_ALPHABET) + 1  # 0 stands before the first character
_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True


@dataclass
class MarkovRatio:
    """``log P(next | previous)`` of random strings less that of ordinary ones; 68 x 68 floats.

    A string counts as random whose sum over its transitions exceeds ``log_odds``.
    """

    table: np.ndarray
    log_odds: float = 14.0

    def scores(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of each span of the alphabet's characters."""
        first, _ = tx.runs(_CODE[data] > 0, np.array([0, len(data)]))
        first = np.union1d(first, start)
        sums = np.concatenate([[0.0], np.cumsum(np.where(_CODE[data] > 0, self.table.ravel()[_transitions(data, first)], 0.0))])
        return sums[end] - sums[start]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Assignments and access keys in a text as (start, end, kind), in code points."""
    found = []
    low = text.lower()
    if any(stem in low for stem in _ASSIGN_STEMS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_MIN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    return found


def _candidates(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    start, end = tx.runs(_CODE[data] > 0, offsets)
    long = end - start >= least
    return start[long], end[long]


def _transitions(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Index of the transition into each byte; a run's first byte comes from state 0."""
    code = _CODE[data]
    before = np.zeros(len(code), np.int64)
    before[1:] = code[:-1]
    before[start] = 0
    return before * _STATES + code


def labelled_tokens(docs: DataFrame, max_docs: int = 20_000, least: int = 8, text: str = "text") -> DataFrame:
    """Labelled samples (token, is_secret) from about ``max_docs`` documents and a seeded generator.

    Values that the fixed patterns find are secrets, other runs of letters, digits and
    ``+/_=-`` of ``least`` characters or more are ordinary. Generated hexadecimal and base64
    strings stand for random ones in a corpus without secrets. Documents are picked by the
    hash of their text, so the sample doesn't depend on partitions; rows of one text are
    all picked or none. The sample is written once, to be counted and scored from there.
    """
    total = docs.count()
    share = min(1.0, max_docs / max(total, 1))
    part = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).where((F.pmod(F.xxhash64("t", F.lit(4)), F.lit(1 << 30)) / F.lit(float(1 << 30))) < share)

    def tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tx.slices(batches, "t"):
            secret, plain = [], []
            for t in piece.column("t").to_pylist():
                rest, done = [], 0
                for s, e, kind in sorted(base_spans(t)):
                    secret.append(_ASSIGN.match(t, s)[2] if kind == "assign" else t[s:e])
                    if e > done:  # an access key may stand inside an assignment
                        rest.append(t[done : max(s, done)])
                        done = e
                raw = np.frombuffer(" ".join([*rest, t[done:]]).encode(), np.uint8)
                start, end = _candidates(raw, np.array([0, len(raw)]), least)
                body = raw.tobytes()
                for s, e in zip(start.tolist(), end.tolist(), strict=True):
                    (secret if e - s >= _HEX_MIN and _IS_HEX[raw[s:e]].all() else plain).append(body[s:e].decode())
            yield pa.RecordBatch.from_arrays([pa.array(secret + plain, pa.string()), pa.array([True] * len(secret) + [False] * len(plain))], ["token", "is_secret"])

    spark = docs.sparkSession
    made = spark.range(2000).select(F.sha2(F.concat(F.lit("sample"), "id"), 256).alias("h"))
    made = made.select(F.explode(F.array(F.substring("h", 1, 40), F.regexp_replace(F.base64(F.unhex("h")), "=", ""))).alias("token"), F.lit(True).alias("is_secret"))
    return durable(part.mapInArrow(tokens, "token string, is_secret boolean").unionByName(made), "samples")


def _counted(samples: DataFrame) -> DataFrame:
    """How often each label has each transition: label, i, n."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, _STATES * _STATES), np.int64)
        for part in tx.slices(batches, "token"):
            data, offsets = tx.utf8(part.column("token"))
            owner = np.repeat(np.arange(part.num_rows), np.diff(offsets))
            secret = part.column("is_secret").to_numpy(zero_copy_only=False).astype(bool)[owner]
            index = _transitions(data, offsets[:-1][np.diff(offsets) > 0])
            ok = _CODE[data] > 0
            for label in (0, 1):
                sums[label] += np.bincount(index[ok & (secret == bool(label))], minlength=_STATES * _STATES)
        label, index = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(index.astype(np.int32)), pa.array(sums[label, index])], ["label", "i", "n"])

    return samples.mapInArrow(count, "label int, i int, n long").groupBy("label", "i").agg(F.sum("n").alias("n"))


def choose_log_odds(samples: DataFrame, model: MarkovRatio, least: int = 16, false_alarms: float = 1e-4, floor: float = 7.0) -> float:
    """Least cutoff above which at most ``false_alarms`` of the ordinary samples of ``least`` characters or more score.

    Scores are counted in steps of one half, so a bounded table reaches the driver. The
    cutoff isn't below ``floor``, odds of a thousand to one, however few the samples are.
    """
    spark = samples.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "token"):
            data, offsets = tx.utf8(part.column("token"))
            size = np.diff(offsets)
            odd = np.concatenate([[0], np.cumsum(_CODE[data] == 0)])
            ok = np.flatnonzero((size >= least) & (odd[offsets[1:]] == odd[offsets[:-1]]))
            ratio = shared.value.scores(data, offsets[:-1][ok], offsets[1:][ok])
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.ceil(2 * ratio), -2000, 2000).astype(np.int32))], ["step"])

    rows = samples.where("not is_secret and token is not null").select("token").mapInArrow(score, "step int").groupBy("step").agg(F.count("*").alias("n")).collect()
    allowed, above = int(false_alarms * sum(r["n"] for r in rows)), 0
    for r in sorted(rows, key=lambda r: -r["step"]):
        above += r["n"]
        if above > allowed:
            return max(floor, r["step"] / 2)
    return floor


def fit(samples: DataFrame, smoothing: float = 0.5, false_alarms: float = 1e-4) -> MarkovRatio:
    """Train both first-order models from labelled samples (token, is_secret); nulls are left out.

    Four fifths of the samples, by hash of the token, train the models, the others choose the
    cutoff as :func:`choose_log_odds` tells; a token is never on both sides.
    """
    known = samples.where("token is not null and is_secret is not null")
    held = F.pmod(F.xxhash64("token", F.lit(9)), F.lit(5)) == 0
    rows = _counted(known.where(~held)).toPandas()
    sums = np.full((2, _STATES * _STATES), smoothing)
    sums[rows["label"].to_numpy(int), rows["i"].to_numpy(int)] += rows["n"].to_numpy(float)
    logs = np.log(sums.reshape(2, _STATES, _STATES))
    logs -= np.log(np.exp(logs).sum(2, keepdims=True))
    model = MarkovRatio(logs[1] - logs[0])
    model.log_odds = choose_log_odds(known.where(held), model, false_alarms=false_alarms)
    return model


def scan(docs: DataFrame, model: MarkovRatio, text: str = "text", least: int = 16, spans: str = "secrets") -> DataFrame:
    """Add ``spans``: every span as an array of (start, end, kind), by start, then kind.

    Positions are code points, the end exclusive. Runs of at least ``least`` characters that
    share nothing with a fixed pattern's span count as ``random`` where their log-likelihood
    ratio exceeds the model's ``log_odds``. Null and empty texts have no spans, repeated rows
    are scanned one by one, an empty table gives an empty one. A text takes about forty bytes
    a character while it is scanned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    rank = {k: i for i, k in enumerate(KINDS)}

    def make():
        model = shared.value

        def step(part: pa.RecordBatch) -> list[pa.Array]:
            data, offsets = tx.utf8(part.column(text))
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
            found: list[list[tuple[int, int, str]]] = [base_spans(t or "") for t in part.column(text).to_pylist()]

            def place(start, end, kind):
                owner = np.searchsorted(offsets, start, "right") - 1
                first = points[offsets[owner]]
                for d, s, e in zip(owner.tolist(), (points[start] - first).tolist(), (points[end] - first).tolist(), strict=True):
                    found[d].append((s, e, kind))

            start, end = tx.runs(_IS_HEX[data], offsets)
            long = end - start >= _HEX_MIN
            place(start[long], end[long], "hex")
            start, end = _candidates(data, offsets, least)
            if len(start):
                high = model.scores(data, start, end) > model.log_odds
                start, end = start[high], end[high]
            if len(start):
                # a span's places in the joined texts; how many spans begin before an end, and end before a start
                place_of = points[offsets]
                taken = np.array([(place_of[d] + s, place_of[d] + e) for d, x in enumerate(found) for s, e, _ in x], np.int64).reshape(-1, 2)
                clear = np.searchsorted(np.sort(taken[:, 0]), points[end], "left") == np.searchsorted(np.sort(taken[:, 1]), points[start], "right")
                place(start[clear], end[clear], "random")
            rows = [[{"start": s, "end": e, "kind": k} for s, e, k in sorted(x, key=lambda x: (x[0], rank[x[2]]))] for x in found]
            return [pa.array(rows, arrow)]

        return step

    return tx.append_columns(docs, [T.StructField(spans, span)], make, text)


def redact(docs: DataFrame, model: MarkovRatio, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """Replace every found span (overlapping ones as one) by ``mask``; columns stay as they are.

    Null and empty texts stay as they are, and so does an empty table; repeated rows are masked alike.
    """
    columns = docs.columns
    spans = tx.unused(docs, "secrets")
    found = scan(docs, model, text, spans=spans)

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, text):
            texts = []
            for t, own in zip(part.column(text).to_pylist(), part.column(spans).to_pylist(), strict=True):
                if t is not None and own:
                    out, done = [], 0
                    for s in own:
                        if s["start"] >= done:
                            out += [t[done : s["start"]], mask]
                        done = max(done, s["end"])
                    t = "".join(out) + t[done:]
                texts.append(t)
            i = part.schema.get_field_index(text)
            part = part.set_column(i, text, pa.array(texts, part.schema.field(i).type))
            yield part.select(columns)
        tx.give_back()

    return found.mapInArrow(step, docs.schema)
