"""Target resampling against plain Python, on the driver's documents and on awkward ones."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from loomstead.llm import target_resampling
from loomstead.llm.text import slices

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def expected(docs, target, percent=25, least=20):
    """Rows of (id, features, weight, score, rank), by id and score."""
    found = [(i, *features(t)) for i, t in docs]
    raw, wanted = Counter(b for _, _, f in found for b in f), Counter(b for t in target for b in features(t)[1])
    s, t = sum(raw.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10_000) / ((raw[b] + 1) * (t + 10_000))))
    rows = []
    for i, n, f in found:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able):
        r[4] = place + 1 if place < percent * len(able) // 100 else None
    for r in rows:
        if not any(r is a for a in able):
            r[4] = None
    return rows


def test_on_the_drivers_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = target_resampling.resample(docs, target).drop("n_words").collect()
    want = expected([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert sum(r.rank is not None for r in got) > 20


def test_on_awkward_documents(spark, clashing, sf_dir):
    """Nulls, ties, repeated rows and clashing names; rows of one id share its ranks in any order."""
    target = spark.createDataFrame([("alpha beta gamma",), (None,), ("",), ("größe 日本語 12 a-b",)], "text string")
    got = target_resampling.resample(clashing, target, percent=50).drop("n_words").collect()
    want = expected([(r.doc_id, r.text) for r in clashing.collect()], ["alpha beta gamma", None, "", "größe 日本語 12 a-b"], percent=50)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert sorted(r[4] for r in got if r[4]) == sorted(r[4] for r in want if r[4])
    assert sorted(r[3] for r in got if r[4]) == sorted(r[3] for r in want if r[4])


def test_empty_tables(spark, empty):
    target = empty.select("text")
    assert target_resampling.resample(empty, target).collect() == []
    docs = spark.createDataFrame([(1, "one two " * 30), (2, None)], "doc_id long, text string")
    got = sorted(map(tuple, target_resampling.resample(docs, target, percent=100).drop("n_words").collect()))
    assert got == sorted(map(tuple, expected([(1, "one two " * 30), (2, None)], [], percent=100)))


@pytest.mark.parametrize("limit", [1, 7, 64, 1 << 18])
def test_blocks_lose_and_repeat_nothing(limit):
    texts = ["", None, "one", "Ab-c,d  é 日本語 x" * 5, "w" * 200, "a b " * 40, ",;: !", "x1 y2 z3" * 30]
    table = target_resampling.blocks(pa.array(texts, pa.string()), limit)
    found: dict[int, list[str]] = {}
    for k, _, led, body in sorted(zip(*[table[c].to_pylist() for c in ("text_no", "block", "led", "body")])):
        words = WORD.findall((body or "").translate(LOWER))
        if led:
            assert found[k][-1] == words[0]
        found[k] = found.get(k, []) + words[1 if led else 0 :]
    assert [found.get(k, []) for k in range(len(texts))] == [WORD.findall((t or "").translate(LOWER)) for t in texts]


def test_a_long_text_counts_whole():
    text = " ".join(f"w{i % 977}x{i % 13}" for i in range(120_000))
    batch = pa.record_batch([pa.array(["short one", text, None])], ["text"])
    assert len(text) > 3 * target_resampling.BLOCK_BYTES
    count = target_resampling._counter(10_000)
    rows = [r for part in slices([batch], "text") for r in pa.table(count(part.column(0))).to_pylist()]
    n, buckets = features(text)
    assert rows[1]["n_words"] == n and {c["bucket"]: c["n"] for c in rows[1]["counts"]} == Counter(buckets)
    assert rows[0]["n_features"] == 3 and rows[2]["n_words"] is None


def test_texts_counted_a_few_blocks_at_a_time(monkeypatch):
    monkeypatch.setattr(target_resampling, "QUERY_BYTES", 50)
    monkeypatch.setattr(target_resampling, "blocks", lambda texts, cut=target_resampling.blocks: cut(texts, 20))
    texts = [None, "", "Ab-c,d  é 日本語 x " * 30, ";;;" * 40, "same words " * 50, "w" * 300, "one"]
    count = target_resampling._counter(10_000)
    rows = pa.table(count(pa.array(texts))).to_pylist()
    for text, r in zip(texts, rows, strict=True):
        n, buckets = features(text)
        assert (r["n_words"] or 0, r["n_features"] or 0) == (n, len(buckets))
        assert {c["bucket"]: c["n"] for c in r["counts"] or []} == Counter(buckets)
    assert pa.table(count(pa.array([None, "", "; ;"]))).to_pylist() == [{"n_words": None, "n_features": None, "counts": None}] * 3
