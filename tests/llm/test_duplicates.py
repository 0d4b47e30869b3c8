"""Near-duplicate and repeat removal against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstead.llm import lattice, ngramjoin, suffix
from loomstead.llm import text as tx
from loomstead.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def root(self, a):
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(zip(*[words[k:] for k in range(5)])) if len(words) >= 5 else frozenset([tuple(words)])


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    union = Union(sets)
    items = list(sets.items())
    for k, (a, x) in enumerate(items):
        for b, y in items[k + 1 :]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                union.join(a, b)
    return {i: (len(sets[i]), union.root(i)) for i in sets}


def check_components(frame):
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    want = brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.connect(frame).collect()}
    assert got == want


def near_copies(seed, groups, copies, words=120):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(6, words))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = f"z{rng.randint(0, 30)}"
            texts.append(" ".join(text))
    rng.shuffle(texts)
    return texts


def test_join_equals_brute_force_on_documents(spark, sf_dir):
    check_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@pytest.mark.parametrize("frequent", [False, True])
def test_join_equals_brute_force_on_near_copies(spark, frequent, monkeypatch):
    """Also with every token class frequent, so that only token combinations are indexed."""
    if frequent:
        monkeypatch.setattr(ngramjoin, "_frequent_classes", lambda survey: np.ones(1 << ngramjoin.CLASS_BITS, np.int64))
    texts = near_copies(3, 12, 14) + near_copies(4, 30, 2, 12)
    check_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6))


def test_join_compares_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK", 4)
    check_components(spark.createDataFrame(list(enumerate(near_copies(8, 2, 25))), "doc_id long, text string"))


def test_join_ends_when_token_hashes_collide(spark, monkeypatch):
    """Two shingles with one 32-bit hash, which sketches don't tell apart: the sets look alike but aren't."""
    lead = [f"lead{i}" for i in range(9)]
    ends = [f"end{i}" for i in range(300_000)]
    token, owner, _ = ngramjoin._shingles(pa.array([" ".join([*lead[5:], e]) for e in ends]), 5)
    hashed = spark.createDataFrame(pa.table({"i": owner, "t": token.view(np.int64)})).groupBy(F.hash("t")).agg(F.collect_list("i").alias("i")).where("size(i) > 1").first()
    one, other = (ends[i] for i in hashed.i[:2])
    monkeypatch.setattr(ngramjoin, "parity_sketches", lambda sets, chosen: [bytes(32)] * len(chosen))
    rounds, rest = [], ngramjoin._rest

    def counted(*args):
        rounds.append(args[-1])
        assert len(rounds) < 4, "no end of rounds"
        return rest(*args)

    monkeypatch.setattr(ngramjoin, "_rest", counted)
    texts = [" ".join([*lead, one]), " ".join([*lead, other]), " ".join([*lead, one, "more"]), " ".join([*lead, other, "less"])]
    check_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert rounds == [False, True]


def test_join_edge_cases(awkward, clashing, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    simple = awkward.where("doc_id is not null and doc_id <> 7")
    check_components(simple)
    out = ngramjoin.connect(clashing).collect()
    assert len(out) == len(rows)
    assert all(r.component_id == r.doc_id for r in out if r.n_shingles == 0)
    assert ngramjoin.connect(empty).count() == 0
    kept = ngramjoin.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert {r.doc_id for r in kept.where("text = 'one'").collect()} == {4}
    with pytest.raises(ValueError):
        ngramjoin.JoinSpec(percent=60)


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(500, 500), (None, 3), (7, None)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    union = Union({n for e in edges for n in e if n is not None})
    for a, b in edges:
        if a is not None and b is not None:
            union.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: union.root(n) for a, b in edges if a is not None and b is not None and a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removed(texts, length):
    where = defaultdict(int)
    for t in texts:
        for k in range(len(t) - length + 1):
            where[t[k : k + length]] += 1
    out = []
    for t in texts:
        hit = np.zeros(len(t) + 1, int)
        for k in range(len(t) - length + 1):
            if where[t[k : k + length]] > 1:
                hit[k] += 1
                hit[k + length] -= 1
        gone = np.cumsum(hit)[: len(t)] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone]) if t else b""
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) > 0).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [noise(rng.randint(380, 900)) for _ in range(8)]
    texts = []
    for _ in range(80):
        text = noise(rng.randint(0, 400))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            text += p[rng.randint(0, 60) : len(p) - rng.randint(0, 60)] + noise(rng.randint(0, 200))
        texts.append(text)
    return [*texts, "a" * 399, "a" * 400, "b" * 401, "c" * 1000, "", "ab" * 700, texts[3], texts[3], texts[5] + "q" * 500]


def test_repeats_equal_brute_force(spark):
    texts = passages(3)
    want = dict(enumerate(brute_removed([t.encode() for t in texts], 400)))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digest_removed(frame).collect()}
    assert got == want


def test_passages_shorter_than_what_is_removed_equal_brute_force(spark):
    """Two lengths over one ranking: facts of 400-byte repeats, and how much repeats of 256 bytes cover."""
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(n))
    shared = [words(54) for _ in range(12)]
    assert all(256 <= len(p) < 400 for p in shared)
    texts = [*passages(7), *(f"{words(20)} {shared[i % 12]} {words(30)}" for i in range(24)), *([words(52)[:300]] * 2), "d" * 255, "d" * 256, "ef" * 160, *[words(90) for _ in range(6)]]
    bodies = [t.encode() for t in texts]
    want = {i: (*cut, *short[1:3]) for i, (cut, short) in enumerate(zip(brute_removed(bodies, 400), brute_removed(bodies, 256), strict=True))}
    frame = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "doc_id long, text string").repartition(5)
    want[len(texts)] = (0, 0, 0, hashlib.sha256(b"").hexdigest(), 0, 0)
    rows = suffix.digest_removed(frame, passage=suffix.PASSAGE).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_bytes, r.n_passages) for r in rows} == want
    assert sum(not x[1] and x[4] >= 256 for x in want.values()) >= 24
    assert {r.doc_id: r.text for r in rows if not want[r.doc_id][1]} == {i: t for i, t in [*enumerate(texts), (len(texts), None)] if not want[i][1]}
    with pytest.raises(ValueError):
        suffix.digest_removed(frame, passage=suffix.RepeatSpec(400))


def test_repeats_leave_no_table_and_no_bodies(spark):
    """Texts in between lie in shared storage, not in the warehouse, and go when the result is made."""
    from pathlib import Path

    from loomstead.llm.storage import shared_dir

    body = "".join(random.Random(8).choice("abcdefgh ") for _ in range(900))
    docs = spark.createDataFrame([(1, body), (2, "head " + body), (3, None)], "doc_id long, text string")
    rows = suffix.digest_removed(docs).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, 900), (2, 900), (3, 0)]
    assert not [t for t in spark.catalog.listTables() if "repeats" in t.name]
    assert not list(Path(shared_dir(spark).removeprefix("file://"), "loomstead").glob("bodies-*"))
    assert not list(Path(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")).glob("loomstead_repeats*"))


def test_sampled_positions_follow_content():
    rng = np.random.default_rng(4)
    spec = suffix.RepeatSpec()
    core = rng.integers(97, 105, 900, dtype=np.uint8)
    places = []
    for lead in (3, 57, 400):
        data = np.concatenate([rng.integers(97, 105, lead, dtype=np.uint8), core, rng.integers(97, 105, 300, dtype=np.uint8)])
        row, where, low, high = suffix.sample(tx.gram_names(data, 1)[1], np.array([0, len(data)]), spec)
        owner = {}
        for p, a, b in zip(where.tolist(), low.tolist(), high.tolist(), strict=True):
            for d in range(a, b + 1):
                assert p - d not in owner
                owner[p - d] = p
        assert sorted(owner) == list(range(len(data) - spec.length + 1))
        places.append([owner[lead + s] - lead for s in range(len(core) - spec.length + 1)])
    assert places[0] == places[1] == places[2]


def test_repeats_edge_cases(awkward, clashing, empty):
    out = suffix.digest_removed(clashing).collect()
    rows = awkward.collect()
    assert len(out) == len(rows)
    assert suffix.digest_removed(empty).count() == 0
    cut = suffix.remove_repeats(clashing)
    assert cut.columns == clashing.columns
    texts = {r.doc_id: r.text for r in cut.where("doc_id in (0, 1, 16, 17)").collect()}
    assert texts == {0: None, 1: "", 16: "a" * 399, 17: "b" * 400}


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for label in range(3):
        for _ in range(12):
            centre = rng.standard_normal(64)
            for _ in range(int(rng.integers(1, 7))):
                rows.append((len(rows), (centre + rng.standard_normal(64) * rng.uniform(0, 0.3)).astype(np.float32).tolist(), label))
    return rows


def test_lattice_links_equal_brute_force(spark, monkeypatch):
    rows = vectors(11)
    rows += [(len(rows) + k, rows[k][1], rows[k][2]) for k in range(5)]  # copies
    unit = np.array([r[1] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    union = Union(range(len(rows)))
    for a, b in zip(*np.nonzero(linked), strict=True):
        union.join(int(a), int(b))
    want = {i: (int(linked[i].sum()), union.root(i)) for i in range(len(rows))}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    for block in (lattice.BLOCK, 3):
        monkeypatch.setattr(lattice, "BLOCK", block)
        assert {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicates(frame).collect()} == want


def test_lattice_edge_cases(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, None), (3, None, 0), (4, [], 0), (5, [0.0, 0.0, 0.0], 0), (6, [1.0, None, 3.0], 0), (7, [1.0, float("nan"), 3.0], 0), (8, [1.0, float("inf"), 3.0], 0), (9, [2.0, 4.0, 6.0], 0), (10, [1.0, 2.0], 0), (11, v, 1), (None, v, 0), (1, v, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"node": F.lit("x"), "cell": F.lit(1), "n_links": F.lit(0)})
    got = lattice.near_duplicates(frame).collect()
    assert len(got) == len(rows)
    linked = {(r.vec_id, r.n_links, r.component_id) for r in got if r.n_links}
    assert linked == {(1, 3, 1), (9, 3, 1), (None, 3, 1)}
    assert all(r.component_id == r.vec_id and r.kept for r in got if not r.n_links)
    assert lattice.near_duplicates(frame.limit(0)).count() == 0


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8)) * 2
    point = lattice.nearest(x)
    around = lattice.neighbours()
    assert len(around) == 240 and np.allclose((around**2).sum(1), 2)
    assert (((2 * point) % 2).std(1) == 0).all() and (point.sum(1) % 2 == 0).all()
    best = ((x - point) ** 2).sum(1)
    assert (best[:, None] <= ((x[:, None] - point[:, None] - around) ** 2).sum(2) + 1e-9).all()
