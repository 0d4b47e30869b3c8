"""The pipeline's stages, one after the other, on awkward documents with clashing columns."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from loomstead.llm import ngramjoin
from loomstead.llm.storage import durable


def test_stages_on_awkward_documents(spark, clashing):
    docs = clashing.where("doc_id is not null and doc_id <> 7")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, "unused"), name)
        seen[name] = docs
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    lettered = seen["language_id"].select("text").collect()
    assert lettered and all(any(c.isalpha() for c in r.text) for r in lettered)
    kept = {r.doc_id for r in seen["ngram_jaccard_join"].collect()}
    assert 4 in kept and 5 not in kept  # the smaller id of two equal texts
    assert {r.doc_id for r in seen["secret_scan"].collect()} == kept
    assert not any(re.search("AKIA[A-Z0-9]{14}", r.text) for r in seen["secret_scan"].collect())
    packed = seen["best_fit_packing"]
    assert {r.doc_id for r in packed.collect()} == kept
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_stages_on_repeated_and_missing_ids(spark, clashing):
    """One row of each group stays, and with it its text, though rows and ids repeat or ids are null."""
    base = " ".join(f"word{i}" for i in range(150))
    twice = clashing.where("doc_id = 7 and text <> 'another text under a used id'").withColumns({"doc_id": F.lit(90).cast("long"), "text": F.lit(base)})
    seen, docs = {}, clashing.unionByName(twice)
    assert twice.count() == 2
    for name, stage in corpus_pipeline.STAGES:
        docs = seen[name] = durable(stage(spark, docs, "unused"), name)
    identified = seen["language_id"]
    groups = {r.component_id for r in ngramjoin.connect(identified.where("doc_id is not null and text <> 'another text under a used id'")).collect()}
    kept = seen["ngram_jaccard_join"].collect()
    found = [r.text for r in identified.collect()]
    assert len({r.text for r in kept}) == len(kept)
    for own in ("no id at all here", "another text under a used id"):
        assert [r.text for r in kept].count(own) == (own in found)
    assert len(kept) == len(groups) + ("no id at all here" in found) + ("another text under a used id" in found)
    assert found.count(base) == 2
    assert [r.text for r in seen["suffix_dedup"].where("doc_id = 90").collect()] == [base]


def test_one_row_of_each_group_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(9)) for x in "abc")
    rows = [(1, a, "x"), (1, a, "x"), (1, a, "y"), (2, a, "x"), (2, b, "x"), (None, b, "x"), (None, c, "x"), (None, c, "x"), (None, None, "x"), (None, None, "x"), (None, "", "x"), (3, " ", "x"), (3, " ", "x")]
    kept = ngramjoin.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4))
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, a), (2, b), (None, c), (None, None), (None, None), (None, ""), (3, " "), (3, " ")], key=str)


def test_stages_on_an_empty_table(spark, empty):
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, "unused"), name)
    assert docs.count() == 0


def test_masked_texts_come_back_from_the_packed_table(spark, clashing):
    """Token ids of all pieces, put together by row, are the texts of the stage before."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = durable(clashing, "docs")
    for name, stage in corpus_pipeline.STAGES[2:]:
        before, docs = docs, durable(stage(spark, docs, "unused"), name)
    rows = {}
    for r in docs.collect():
        rows.setdefault((r.doc_id, r.row_id), []).append(r)
        assert len(r.ids) == r.length <= 1024 and r.offset + r.length <= 1024
    texts = []
    for (doc_id, _), pieces in rows.items():
        ids = [i for r in sorted(pieces, key=lambda r: r.piece) for i in r.ids]
        assert ids[-1] == corpus_pipeline.END_ID and [r.piece for r in sorted(pieces, key=lambda r: r.piece)] == list(range(len(pieces)))
        texts.append((str(doc_id), library.decode(ids[:-1], skip_special_tokens=False)))
    assert sorted(texts) == sorted((str(r.doc_id), r.text or "") for r in before.collect())


def test_passages_of_over_fifty_words_are_cut(spark):
    """Passages that two otherwise different documents share go, though they are shorter than the 400 bytes of op5's contract."""
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(n))
    shared = [words(54) for _ in range(20)]
    assert all(256 + 8 < len(p) < 400 for p in shared)
    rows = [(i, f"{words(80)} {shared[i % 20]} {words(80)}") for i in range(40)] + [(100 + i, words(200)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.text for r in corpus_pipeline.repeat_stage(spark, docs, "unused").collect()}
    assert all(got[i] == text for i, text in rows if i >= 100)
    assert all(shared[i % 20][:40] not in got[i] and len(got[i]) <= len(text) - len(shared[i % 20]) for i, text in rows if i < 100)
