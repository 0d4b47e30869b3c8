"""Shards along the Hilbert curve: neighbours, laws, files and pruning."""

import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from loomstead.llm import queries, shards


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_the_curve_meets_every_cell_by_single_steps(spark, dims, bits):
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    frame = spark.createDataFrame(cells, ", ".join(f"d{i} int" for i in range(dims)))
    rows = frame.withColumn("at", shards.curve_index([F.col(f"d{i}") for i in range(dims)], bits)).collect()
    walk = [tuple(r)[:dims] for r in sorted(rows, key=lambda r: r["at"])]
    assert sorted(r["at"] for r in rows) == list(range(len(cells)))
    assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for a, b in zip(walk, walk[1:]))


def test_refused_shapes(spark):
    with pytest.raises(ValueError):
        shards.curve_index([F.lit(1)], 4)
    with pytest.raises(ValueError):
        shards.assign(spark.range(1), ["id", "id"], 4, "bytes")


def slots(rows):
    held = {}
    for r in rows:
        held.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in held.values())
    return {k: len(v) for k, v in held.items()}


def test_both_laws_on_awkward_documents(spark, clashing):
    docs = clashing.withColumns({"n": F.octet_length("text").cast("long"), "shard": F.lit("x"), "Slot": F.lit("x"), "bin0": F.lit("x"), "__tie": F.lit(1)})
    total = docs.count()
    found = shards.assign(docs, ["lang", "n", "doc_id"], 7)
    rows = found.collect()
    sizes = slots(rows)
    assert len(rows) == total and sum(sizes.values()) == total and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    assert sorted(str(r.text) for r in rows) == sorted(str(r.text) for r in docs.collect())
    by_bytes = shards.assign(docs, ["lang", "n", "doc_id"], 7, "bytes", size="n").collect()
    slots(by_bytes)
    sums = [sum(r.n or 0 for r in by_bytes if r.shard == k) for k in range(7)]
    longest = max(r.n or 0 for r in by_bytes)
    assert all(abs(s - sum(sums) / 7) <= longest for s in sums)


def test_few_repeated_and_no_rows(spark):
    few = spark.createDataFrame([(1, "a"), (None, None)], "i long, s string")
    assert sorted((r.shard, r.slot) for r in shards.assign(few, ["i", "s"], 40).collect()) == [(0, 0), (20, 0)]
    same = spark.range(2000).select(F.lit(5).cast("long").alias("i"), F.lit("x").alias("s"))
    assert set(slots(shards.assign(same, ["i", "s"], 10).collect()).values()) == {200}
    for law in ("rows", "bytes"):
        assert shards.assign(few.limit(0), ["i", "s"], 4, law, size="i").collect() == []
    extremes = spark.createDataFrame([(-(2**63), "a"), (2**63 - 1, "b"), (-1, "c"), (0, "d")], "i long, s string")
    assert [r.i for r in sorted(shards.assign(extremes, ["i", "i"], 4).collect(), key=lambda r: r.shard)] == [-(2**63), -1, 0, 2**63 - 1]


def test_files_hold_their_rows_and_most_are_pruned(spark, sf_dir, tmp_path):
    """A box in two dimensions meets far fewer shards than shards sorted by the other dimension."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("size", F.octet_length("text").cast("long"))
    dims = ["size", "doc_id"]
    path = str(tmp_path / "shards")
    ranges = shards.write_shards(docs, path, dims, 36, bits=8)
    back = spark.read.parquet(path)
    assert sorted((r.doc_id, zlib.crc32(r.text.encode())) for r in back.select("doc_id", "text").collect()) == sorted((r.doc_id, zlib.crc32(r.text.encode())) for r in docs.select("doc_id", "text").collect())
    held = {r.shard: r for r in back.groupBy("shard").agg(F.count("*").alias("rows"), F.min("size").alias("least"), F.max("size").alias("largest")).collect()}
    rows = ranges.collect()
    assert {r.shard: (r.rows, r.least_size, r.largest_size) for r in rows} == {k: (r.rows, r.least, r.largest) for k, r in held.items()}
    low, high = docs.selectExpr("percentile(size, 0.8)", "percentile(size, 0.9)").first()
    assert sum(r.least_size <= high and r.largest_size >= low for r in rows) <= 18
    assert sum(r.least_doc_id <= 450 and r.largest_doc_id >= 400 for r in rows) <= 18
    order = [tuple(r) for r in back.where("shard = 3").select("slot", "curve").collect()]
    assert order == sorted(order)


def test_op13_contract(spark, sf_dir):
    rows = queries.op13_hilbert_sharding(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {k: (len(t.encode()) + 16, zlib.crc32(t.encode())) for k, t in docs.items()}
    assert set(slots(rows).values()) <= {len(docs) // 40, -(-len(docs) // 40)}
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
