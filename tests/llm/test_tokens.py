"""Encoding, packing and token counts against the tokenizers library and brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomstead.llm import bpe, packing, tokenscan
from loomstead.llm.queries import BYTE_BPE, WORD_BPE
from loomstead.llm.storage import new_path


def hard_texts(n=1500):
    rng = random.Random(0)
    pool = "aebc's  \n1é日 't'ReL!?<|>́ "
    fixed = ["", "  a  b\n\n c ' 's 'so it's IT'S don'T we'll'll \t\t x", "''s \"'s", "\n's", "a \n b", "<|endoftext|>x <|startoftext|> y<|endoftext|>", "É́ ΣΑΣ İ ſ   x　日本語 😀", "!" * 300, "x" * 3000, "foo'restaurant 'llama", "   ", "\x85 \x1c\x1d a", "ban" * 40]
    return fixed + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_ids_equal_the_library(path):
    texts = hard_texts()
    ids, at = bpe.TextEncoder(path)(texts)
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [w.ids for w in want]


def test_small_tables_give_the_same_ids():
    texts = hard_texts(200)
    encoder = bpe.TextEncoder(WORD_BPE)
    want = encoder(texts)[0].tolist()
    encoder.words.limit = 10
    assert [i for t in texts for i in encoder([t])[0].tolist()] == want


def test_pair_checks_agree_with_merging():
    model = bpe.SpeculativeBPE(WORD_BPE)
    rng = random.Random(4)
    words = [bytes(rng.choice(b"abcdehinorst") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    exact = [model.merge(w) for w in words]
    together, count = model.merge_many(words)
    assert together.tolist() == [i for x in exact for i in x] and count.tolist() == [len(x) for x in exact]
    ids, size = model.encode_words([w.decode() for w in words])
    assert ids.tolist() == together.tolist() and size.tolist() == count.tolist()
    pairs = np.array([p for x in exact for p in zip(x, x[1:], strict=False)])
    assert model.compatible(pairs[:, 0], pairs[:, 1]).all()


def test_round_trip_through_spark(awkward, clashing, empty):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    rows = bpe.decode(bpe.encode(clashing, WORD_BPE), WORD_BPE).collect()
    for r in rows:
        want = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == tokenizer.decode(want, skip_special_tokens=False)
    assert len(rows) == awkward.count()
    assert bpe.encode(empty, WORD_BPE).count() == 0
    byte = bpe.decode(bpe.encode(awkward, BYTE_BPE), BYTE_BPE).collect()
    assert all(r.decoded == (r.text or "") for r in byte)


def test_cut_keeps_full_pieces_behind_the_first():
    for size in (1, 9, 10, 11, 20, 31):
        parts = packing.cut(size, 10)
        assert parts[0][0] == 0 and sum(n for _, n in parts) == size
        assert all(n == 10 for _, n in parts[1:]) and all(s == sum(n for _, n in parts[:i]) for i, (s, _) in enumerate(parts))


def check_layout(lengths, capacity):
    counts = Counter(lengths)
    layout = packing.plan(dict(counts), capacity)
    fill = defaultdict(list)
    for length, n in counts.items():
        sequence, offset = layout.place(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            fill[s].append((o, length))
    assert len(fill) == layout.sequences
    for items in fill.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in items) <= 2
    return layout.sequences


def test_layouts_are_gapless_and_tight():
    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.choice([10, 31, 100, 1024])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 400))]
        used = check_layout(lengths, capacity)
        assert used <= 11 / 9 * max(-(-sum(lengths) // capacity), sum(2 * n > capacity for n in lengths)) + 1
    assert check_layout([600, 424, 600, 424, 512, 512], 1024) == 3
    assert packing.plan({}, 1024).sequences == 0


@pytest.mark.parametrize("frame", ["clashing", "documents"])
def test_packing_keeps_every_token(frame, request, spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if frame == "documents" else request.getfixturevalue(frame).where("doc_id is not null and doc_id <> 7")
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    rows = packing.pack(packing.pieces(docs, BYTE_BPE, 2, 1024), 1024).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert set(by_doc) == set(texts)
    for i, parts in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        parts.sort(key=lambda r: r.piece)
        assert [(r.start, r.length) for r in parts] == packing.cut(len(ids), 1024)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length]) for r in parts)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_packing_empty_table(empty):
    assert packing.pack(packing.pieces(empty, BYTE_BPE, 2, 1024), 1024).count() == 0


def test_separator_scan_equals_plain_python(spark, tmp_path):
    rng = random.Random(1)
    files, want = [], set()
    for k in range(16):
        ids = np.array([rng.choice([7, 7, 1, 2, 9]) for _ in range(rng.randint(0, 90))], "<u2")
        if k < 2:
            ids = np.full(40, [7, 1][k], "<u2")
        path = tmp_path / f"{k}.bin"
        path.write_bytes(ids.tobytes() + b"\x01" * (k % 2))  # an odd byte fills no token
        files += [(f"file://{path}",)] * (1 + k % 2)
        start = ordinal = 0
        for i in np.flatnonzero(ids == 7).tolist():
            want.add((f"file://{path}", ordinal, start, i - start, True))
            start, ordinal = i + 1, ordinal + 1
        if start < len(ids):
            want.add((f"file://{path}", ordinal, start, len(ids) - start, False))
    frame = spark.createDataFrame(files, "file string")
    for block in (8, 1000):
        got = [tuple(r) for r in tokenscan.count_tokens(spark, frame, 7, "<u2", block).collect()]
        assert len(got) == len(want) and set(got) == want
    assert tokenscan.count_tokens(spark, frame.limit(0), 7).count() == 0


def test_counts_of_written_documents(spark, clashing):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    tokenizer.encode_special_tokens = True
    docs = clashing.where("doc_id is null or doc_id <> 7")
    manifest = tokenscan.write_token_files(docs, new_path(spark, "tokens"), BYTE_BPE, 50256)
    counts = tokenscan.count_tokens(spark, manifest.select("file"), 50256, block_tokens=64)
    got = {r.doc_id: r.n_tokens for r in manifest.join(counts, ["file", "ordinal"]).collect()}
    assert got == {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
