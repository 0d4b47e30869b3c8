"""The registered queries against plain Python over whole tables, and structured texts that weak hashes confuse."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomstead.llm import bpe, langid, lattice, ngramjoin, risk_rules, secrets, suffix
from loomstead.llm import text as tx
from loomstead.llm.queries import BYTE_BPE, WORD_BPE, queries
from tests.llm.test_duplicates import brute_components, check_components
from tests.llm.test_text_rules import brute_base, metrics

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def removed(texts, length):
    """Bytes, removed bytes, spans and what is left of each text, by a table of all strings' hashes."""
    where = defaultdict(int)
    for t in texts:
        for k in range(len(t) - length + 1):
            where[hash(t[k : k + length])] += 1
    for t in texts:
        hit = np.zeros(len(t) + 1, int)
        for k in range(len(t) - length + 1):
            if where[hash(t[k : k + length])] > 1:
                hit[k] += 1
                hit[k + length] -= 1
        gone = np.cumsum(hit)[: len(t)] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone]) if t else b""
        yield len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) > 0).sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")


def test_op1_keeps_the_largest_keys(spark):
    rows = queries()["op1_importance_resampling"](spark, SF).collect()
    kept = [r for r in rows if r.kept]
    assert 0 < len(kept) < len(rows)
    assert {r.doc_id for r in kept} == {r.doc_id for r in sorted(rows, key=lambda r: -r.sample_key)[: len(kept)]}


def test_op2_base(spark, texts):
    for r in queries()["op2_risk_controlled_rules"](spark, SF).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == metrics(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_op4_base_and_spans(spark, texts):
    for r in queries()["op4_secret_scan"](spark, SF).collect():
        base = brute_base(texts[r.doc_id])
        named = [f"{k}:{s}:{e}" for s, e, k in base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, _, k in base) for x in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("random")] == named


def test_op5_digest(spark, texts):
    want = dict(zip(texts, removed([(t or "").encode() for t in texts.values()], 400), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.text) for r in queries()["op5_suffix_dedup"](spark, SF).collect()}
    assert got == want
    assert any(x[1] for x in want.values())


def test_op5_tells_passages_of_over_fifty_words(spark, texts):
    """The query finds repeats of 256 bytes besides those of 400 that its contract removes."""
    bodies = [(t or "").encode() for t in texts.values()]
    want = {i: (cut[1], short[1], short[2]) for i, cut, short in zip(texts, removed(bodies, 400), removed(bodies, 256), strict=True)}
    got = {r.doc_id: (r.n_removed, r.n_passage_bytes, r.n_passages) for r in queries()["op5_suffix_dedup"](spark, SF).collect()}
    assert got == want
    assert any(b and not a for a, b, _ in want.values())


def test_op6_ids_and_text(spark, texts):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    for r in queries()["op6_speculative_bpe"](spark, SF).collect():
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op8_equals_plain_naive_bayes(spark, awkward):
    rows = [(r.text, r.lang) for r in awkward.collect()]
    model = langid.fit(awkward, buckets=512)

    def grams(text):
        points = np.array([ord(c) for c in (text or "").lower()], np.uint32)
        return [b for order in (2, 3) for bucket, _ in langid.hashed_ngrams(points, np.array([0, len(points)]), order, 512, limit=7) for b in bucket.tolist()]

    known = [(t, x) for t, x in rows if t is not None and x is not None]
    names = sorted({x for _, x in known})
    counts = {n: Counter(g for t, x in known if x == n for g in grams(t)) for n in names}
    prior = {n: sum(x == n for _, x in known) + 1 for n in names}
    for r in langid.predict(awkward, model).collect():
        if r.lang_pred == langid.UNDETERMINED:
            continue
        score = {n: math.log(prior[n] / sum(prior.values())) + sum(math.log((counts[n][g] + 0.1) / (sum(counts[n].values()) + 51.2)) for g in grams(r.text)) for n in names}
        best = max(score.values())
        assert score[r.lang_pred] == pytest.approx(best, abs=1e-2)
        assert r.score == pytest.approx(1 / sum(math.exp(s - best) for s in score.values()), abs=1e-2)


def test_hundreds_of_languages_are_learned_in_parts(spark, monkeypatch):
    """300 languages in parts of 64: the same predictions, to the digit that sums allow, as with one part."""
    rng = np.random.default_rng(5)
    letters = [chr(0x61 + k) for k in range(26)] + [chr(0x430 + k) for k in range(32)]
    rows = []
    for i in range(300):
        own = rng.choice(letters, 6, replace=False)
        rows += [(i * 4 + k, " ".join("".join(rng.choice(own, 5)) for _ in range(40)), f"l{i:03}") for k in range(4)]
    rows += [(5000, None, "l000"), (5001, "123 !", "l001"), (5002, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    monkeypatch.setattr(langid, "PART_LANGUAGES", 1000)
    whole = langid.fit(docs, buckets=1024)
    assert whole.parts == 1 and len(whole.languages) == 301 - 1
    want = {r.doc_id: r for r in langid.predict(docs, whole).collect()}
    monkeypatch.setattr(langid, "PART_LANGUAGES", 64)
    model = langid.fit(docs, buckets=1024)
    assert model.parts == 5 and model.languages == sorted({x for _, t, x in rows if t is not None and x})
    got = {r.doc_id: r for r in langid.predict(docs.withColumn("__language", F.lit("x")), model).collect()}
    for k, r in want.items():
        assert got[k].lang_pred == r.lang_pred and got[k].score == pytest.approx(r.score, abs=1e-9)
    assert sum(want[k].lang_pred == x for k, t, x in rows if t and x and k < 5000) > 1150
    assert {want[k].lang_pred for k in (5000, 5001, 5002)} == {"und"}


def test_op10_components(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries()["op10_ngram_jaccard_join"](spark, SF).collect()}
    assert got == brute_components(texts.items())


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.fixture(scope="module")
def structured():
    """Words, lines and passages that follow the Thue-Morse sequence, and their complements."""
    out = []
    for n in (512, 2048, 4096):
        a, b = thue_morse(n), thue_morse(n, "ba")
        out += [a, b, f"x {a}\nx {b}\nx {a}", f"{a} {b} {a}", " ".join(thue_morse(n // 4)), " ".join(thue_morse(n // 4, "ba")), a + "tail", "head" + b]
    return out


def test_structured_words_are_told_apart(structured):
    column = pa.array(structured)
    found = risk_rules.measure_slice(column)
    for i, t in enumerate(structured):
        assert tuple(int(found[m][i]) for m in risk_rules.METRICS[:5]) == metrics(t)
    assert len(set(ngramjoin.shingle_sets(column, 5).sid.tolist())) == len({frozenset(x) for x in map(_shingles, structured)})
    for path in (WORD_BPE, BYTE_BPE):
        ids, at = bpe.TextEncoder(path)(structured)
        want = Tokenizer.from_file(path).encode_batch(structured, add_special_tokens=False)
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(structured))] == [w.ids for w in want]


def _shingles(text):
    words = text.split()
    return [tuple(words[k : k + 5]) for k in range(len(words) - 4)] or [tuple(words)]


def test_structured_texts_are_joined_and_cut_rightly(spark, structured):
    frame = spark.createDataFrame(list(enumerate(structured)), "doc_id long, text string")
    check_components(frame)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.text) for r in suffix.digest_removed(frame).collect()}
    assert got == dict(enumerate(removed([t.encode() for t in structured], 400)))


def test_hashes_in_blocks_equal_hashes_at_once():
    data = np.frombuffer(("word " * 50 + "x" * 3000 + " é tail").encode(), np.uint8)
    start, end, _ = tx.words(data, np.array([0, len(data)]))
    assert (tx.span_hashes(data, start, end, limit=37) == tx.span_hashes(data, start, end)).all()


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_long_texts_are_encoded_in_parts(path, monkeypatch):
    monkeypatch.setattr(bpe, "PART_CHARS", 40)
    long = ["it's the  words of\n a long text <|endoftext|> 12 été ΣΑΣ " * 40, "x" * 500, ""]
    ids, at = bpe.TextEncoder(path)(long)
    want = Tokenizer.from_file(path).encode_batch(long, add_special_tokens=False)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(3)] == [w.ids for w in want]


def test_markov_part_on_real_texts(spark):
    """Recall on keys planted in real texts, and false alarms on the texts without them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("doc_id", "text")
    model = secrets.fit(secrets.labelled_tokens(docs))
    before = {r.doc_id: sum(s.kind == "random" for s in r.secrets) for r in secrets.scan(docs, model).collect()}
    planted = docs.selectExpr("doc_id", "concat(text, ' key ', regexp_replace(substring(base64(unhex(sha2(cast(doc_id as string), 256))), 1, 24), '[^A-Za-z0-9]', 'Q'), ' end') as text")
    after = {r.doc_id: sum(s.kind == "random" for s in r.secrets) for r in secrets.scan(planted, model).collect()}
    assert sum(before.values()) <= 0.002 * len(before)
    assert np.mean([after[i] > before[i] for i in before]) > 0.95


@pytest.mark.parametrize("cosine", [0.93, 0.95])
def test_cells_bring_near_vectors_together(cosine):
    rng = np.random.default_rng(6)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    b = cosine * a + math.sqrt(1 - cosine**2) * side
    met = np.zeros(len(a), bool)
    for (row_a, key_a, own_a), (row_b, key_b, own_b) in zip(lattice.cells(a, lattice.LatticeSpec()), lattice.cells(b, lattice.LatticeSpec()), strict=True):
        held = set(zip(row_a[own_a].tolist(), key_a[own_a].tolist(), strict=True))
        met[[i for i, k in zip(row_b.tolist(), key_b.tolist(), strict=True) if (i, k) in held]] = True
        held = set(zip(row_b[own_b].tolist(), key_b[own_b].tolist(), strict=True))
        met[[i for i, k in zip(row_a.tolist(), key_a.tolist(), strict=True) if (i, k) in held]] = True
    assert met.mean() >= 0.999
