"""Operators that judge or label one text at a time, against plain Python."""

import hashlib
import math
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomstead.llm import importance, langid, risk_rules, secrets
from loomstead.llm import text as tx
from loomstead.llm.queries import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def metrics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@pytest.mark.parametrize("frame", ["awkward", "clashing"])
def test_metrics_equal_plain_python(frame, request):
    rows = risk_rules.measure(request.getfixturevalue(frame).select("*")).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == metrics(r.text), r.doc_id


def test_metrics_on_documents(spark, sf_dir):
    rows = risk_rules.measure(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == metrics(r.text) for r in rows)


def test_binomial_bounds_are_exact():
    for n in (1, 7, 40):
        for p in (0.01, 0.3, 0.97):
            for k in range(-1, n + 1):
                want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
                assert risk_rules.binomial_cdf(k, n, p) == pytest.approx(want, abs=1e-12)
    high = risk_rules.upper_bound(3, 50, 0.05)
    assert risk_rules.binomial_cdf(3, 50, high) == pytest.approx(0.05, abs=1e-9)
    assert risk_rules.upper_bound(5, 5, 0.1) == 1.0


def test_cutoffs_keep_their_guarantee(spark):
    rows = [("a", i, 100, 500, 0 if i % 400 else 200, 0, 0, 5, 10) for i in range(4000)] + [("b", i, 100, 500, 0, 0, 0, 5, 10) for i in range(20)]
    good = spark.createDataFrame(rows, "stratum string, doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long")
    chosen = risk_rules.select_cutoffs(good, "stratum", risk=0.05)
    found = chosen.collect()
    assert {c.stratum for c in found} == {"a"}  # too few rows in b for any certainty
    assert all(c.bound <= 0.05 / len(risk_rules.rules()) for c in found)
    symbols = next(c for c in found if c.rule == "symbols")
    assert symbols.n_rejected / symbols.n_good <= 0.01
    judged = risk_rules.apply_cutoffs(good, chosen, "stratum")
    assert judged.where("stratum = 'b' and not kept").count() == 0


def test_small_strata_get_cutoffs(spark):
    sizes = {"en": 2076, "de": 507, "fr": 505, "es": 321, "it": 100}
    rows = [(lang, 100, 500, 0, 0, 0, 5, 10) for lang, n in sizes.items() for _ in range(n)]
    good = spark.createDataFrame(rows, "stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long")
    found = risk_rules.select_cutoffs(good, "stratum").collect()
    assert {c.stratum for c in found} == {"en", "de", "fr", "es"}
    assert all(c.bound <= 0.02 for c in found)
    assert {(c.stratum, c.rule) for c in found} >= {(lang, rule) for lang in ("en", "de", "fr", "es") for rule in ("symbols", "capitals")}


def test_thousands_of_strata(spark):
    """Every stratum of 3,000 is tested; cutoffs and verdicts are those of a walk in plain Python."""
    names = [None, *(f"s{i}" for i in range(2999))]
    rows = [(x, 100, 500, (i * 37 + k) % 400 if k % 97 == 0 else 0, k % 11 == 0, 0, 5, 10) for i, x in enumerate(names) for k in range(420 if i % 300 == 0 else 200)]
    rows = [(s, *map(int, r)) for s, *r in rows]
    good = spark.createDataFrame(rows, "stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long")
    good = good.withColumns({"__of": F.lit("x"), "of": F.lit("x"), "kept": F.lit("x")})
    chosen = risk_rules.select_cutoffs(good, "stratum", risk=0.08)
    got = {}
    for c in chosen.collect():
        got.setdefault(c.stratum, {})[c.rule] = (c.cutoff, c.n_rejected, c.bound)
        assert c.bound <= 0.08
    family = risk_rules.rules()
    for i in (0, 1, 299, 300, 2999):
        mine = [r for r in rows if r[0] == names[i]]
        scores = [[s / c, d / n, p / w, u / c, c / w] for _, w, c, s, d, p, n, u in mine]
        steps = np.array([[len(grid) + 1 - sum(x > g for g in grid) for x, (_, grid) in zip(own, family.values(), strict=True)] for own in scores], np.int64)
        want = risk_rules._tighten(steps, np.ones(len(steps), np.int64), 0.08, 0.05 / len(names))
        assert got.get(names[i], {}) == {k: (c, n, pytest.approx(b)) for k, (c, n, b) in want.items()}
    assert len(got) > 5 and None in got
    judged = risk_rules.apply_cutoffs(good, chosen, "stratum").where("stratum is null").collect()
    limit = {rule: c for rule, (c, _, _) in got[None].items()}
    for r in judged:
        own = dict(zip(family, [r.n_symbols / r.word_chars, r.n_dup_lines / r.n_lines, r.n_repeat_words / r.n_words, r.n_upper / r.word_chars, r.word_chars / r.n_words], strict=True))
        assert r.kept == (not any(own[rule] > c for rule, c in limit.items())) and r["of"] == r["__of"] == "x"


def test_figures_of_the_readme_and_verdicts_on_a_table(spark):
    """Cutoffs and rejections at sf0.01 as the README states them; ``kept`` recomputed from the metrics and cutoffs."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged, cutoffs = risk_rules.judge(docs, labels)
    rows, limits = judged.collect(), {}
    for c in cutoffs.collect():
        limits.setdefault(c.stratum, {})[c.rule] = c.cutoff
        assert c.bound <= 0.02 and c.n_good == 219
    assert {k: len(v) for k, v in limits.items()} == {"en": 5}
    by_rules = 0
    for r in rows:
        own = {"symbols": r.n_symbols / max(r.word_chars, 1), "dup_lines": r.n_dup_lines / max(r.n_lines, 1), "repeats": r.n_repeat_words / max(r.n_words, 1), "capitals": r.n_upper / max(r.word_chars, 1), "long_words": r.word_chars / max(r.n_words, 1)}
        fails = any(own[rule] > c for rule, c in limits.get(r.stratum, {}).items())
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and not fails)
        by_rules += fails and not r.base_failed
    assert by_rules == 32


def test_all_rules_together_keep_the_risk():
    """Over many samples, cutoffs whose true risk is too high are chosen as rarely as promised."""
    rng = np.random.default_rng(3)
    grids = [grid for _, grid in risk_rules.rules().values()]
    wrong, used = 0, 0
    for _ in range(300):
        rates = [0.0004, 0.0002, 0.0003, 0.0005, 0.0006]  # of each rule and step
        steps = np.stack([np.ceil(rng.random(1500) / p) for p in rates], axis=1).astype(np.int64)
        found = risk_rules._tighten(np.minimum(steps, [len(g) + 1 for g in grids]), np.ones(1500, np.int64), 0.02, 0.2)
        now = {name: len(grid) - grid.index(found[name][0]) for name, grid in zip(risk_rules.rules(), grids, strict=True) if name in found}
        good = math.prod(1 - p * now.get(name, 0) for p, name in zip(rates, risk_rules.rules(), strict=True))
        wrong += 1 - good > 0.02
        used += bool(found)
    assert used > 200 and wrong <= 0.2 * 300


def test_rules_on_edge_tables(awkward, empty, clashing, spark):
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    judged, _ = risk_rules.judge(clashing, labels)
    rows = judged.collect()
    assert len(rows) == awkward.count()
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in rows)
    assert risk_rules.judge(empty, labels)[0].count() == 0
    assert risk_rules.judge(awkward, labels.limit(0))[0].where("not base_failed and not kept").count() == 0


def test_language_accuracy_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = queries()["op8_language_id"](spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = out.join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 100
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(awkward, clashing, empty):
    model = langid.fit(awkward)
    assert model.languages == ["en", "fr"]
    rows = langid.predict(clashing, model).collect()
    for r in rows:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not lettered)
        assert 0 <= r.score <= 1 and r.kept == "x"
    kept = langid.keep_identified(awkward, model)
    assert kept.columns == awkward.columns
    assert langid.predict(empty, model).count() == 0
    blank = langid.fit(empty)
    assert {r.lang_pred for r in langid.predict(awkward, blank).collect()} == {"und"}


def brute_base(text):
    text = text or ""
    assign = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    access = [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    hexes = [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    rank = {"assign": 0, "access": 1, "hex": 2}
    return sorted(assign + access + hexes, key=lambda x: (x[0], rank[x[2]]))


def test_secret_base_equals_plain_python(spark, awkward, clashing, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = secrets.fit(secrets.labelled_tokens(docs))
    for frame in (docs, clashing):
        for r in secrets.scan(frame, model).collect():
            found = [(s.start, s.end, s.kind) for s in r.secrets]
            assert [s for s in found if s[2] != "random"] == brute_base(r.text)
    assert secrets.scan(empty, model).count() == 0
    assert secrets.redact(awkward, model).columns == awkward.columns
    masked = [r.text for r in secrets.redact(awkward, model).where("doc_id = 21").collect()]
    assert masked == ["[secret]' end"]


def test_markov_tells_random_from_ordinary(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = secrets.fit(secrets.labelled_tokens(docs))
    keys = [hashlib.sha256(bytes([i])).hexdigest().upper()[:30] + "xQ7z" for i in range(40)]
    plain = docs.select(F.explode(F.split("text", "[^A-Za-z]+")).alias("w")).where("length(w) >= 16 and w = lower(w)").distinct().limit(400)
    rows = spark.createDataFrame([(f"see {k} here",) for k in keys], "text string")
    caught = secrets.scan(rows, model).where("exists(secrets, s -> s.kind = 'random')").count()
    assert caught >= 38
    assert secrets.scan(plain.withColumnRenamed("w", "text"), model).where("exists(secrets, s -> s.kind = 'random')").count() <= 2


def test_kth_largest_is_exact(spark):
    values = [float(x) for x in np.random.default_rng(1).normal(size=500)] + [0.0, -0.0, 3.5, 3.5, 3.5, 1e300, -1e300]
    frame = spark.createDataFrame([(v,) for v in values], "x double").repartition(6)
    order = sorted(values, reverse=True)
    for k in (1, 2, 5, 250, len(values)):
        assert importance.kth_largest(frame, "x", k) == order[k - 1]
    assert importance.kth_largest(frame, "x", 0) is None
    assert importance.kth_largest(frame, "x", len(values) + 1) is None


def test_importance_ranks_good_text_first(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    marked, share = importance.mark_target(docs, labels)
    out = importance.resample(docs, importance.fit(marked, "target"), share)
    assert out.where("kept").count() == round(share * docs.count())
    rows = out.join(labels, "doc_id").collect()
    good = np.array([r.quality == 1 and r.toxic == 0 for r in rows])
    rank = np.argsort(np.argsort([r.log_weight for r in rows])) + 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.97


def test_importance_equals_plain_python(spark):
    """Share, target flags, models, weights, keys and the rows kept, recomputed; the noise decides more than a few."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    by_id = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        by_id.setdefault(r.doc_id, []).append(r.quality == 1 and r.toxic == 0)
    good = {i for i, x in by_id.items() if all(x)}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(text):
        words = WORD.findall((text or "").translate(lower))
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        size = np.array([len(w.encode()) for w in words], np.int64)
        start = np.cumsum(size + 1) - size - 1
        one = tx.span_hashes(data, start, start + size)  # the library's names of words and pairs
        two, _ = tx.windows(one, np.zeros(len(one), np.int64), 2)
        return (np.concatenate([one, two]) >> np.uint64(20)).astype(np.int64) % (1 << 16)

    own = {i: features(t) for i, t in docs.items()}
    raw = np.ones(1 << 16) + np.bincount(np.concatenate(list(own.values())), minlength=1 << 16)
    wanted = np.ones(1 << 16) + np.bincount(np.concatenate([f for i, f in own.items() if i in good]), minlength=1 << 16)
    ratio = np.log(wanted / wanted.sum()) - np.log(raw / raw.sum())
    weight = {i: 8.0 * math.fsum(ratio[f]) / math.sqrt(max(len(f), 1)) for i, f in own.items()}
    key = {}
    for i, w in weight.items():
        h = xxhash.xxh64_intdigest(struct.pack("<q", i), seed=xxhash.xxh64_intdigest(struct.pack("<i", 17), seed=42))
        key[i] = w - math.log(-math.log(((h >> 11) + 0.5) / 2**53))
    k = round(len(good) / len(by_id) * len(docs))
    kept = set(sorted(key, key=lambda i: -key[i])[:k])

    got = {r.doc_id: r for r in queries()["op1_importance_resampling"](spark, sf).collect()}
    assert got.keys() == docs.keys()
    assert all(r.log_weight == pytest.approx(weight[i], abs=1e-9) and r.sample_key == pytest.approx(key[i], abs=1e-9) for i, r in got.items())
    assert {i for i, r in got.items() if r.kept} == kept
    assert len(kept - set(sorted(weight, key=lambda i: -weight[i])[:k])) > 3


def test_importance_edge_cases(spark, awkward, clashing, empty):
    labels = spark.createDataFrame([(7, 1, 0), (None, 1, 0), (11, None, 0)], "doc_id long, quality int, toxic int")
    marked, share = importance.mark_target(clashing.drop("target"), labels)
    model = importance.fit(marked, "target")
    out = importance.resample(clashing, model, share).collect()
    assert len(out) == awkward.count()
    weights = importance.weigh(awkward.where("text is null or trim(text) = ''"), model).collect()
    assert all(r.log_weight == 0 for r in weights if not WORD.search(r.text or ""))
    assert importance.resample(empty, model, 0.5).count() == 0
    assert importance.mark_target(awkward, labels.limit(0))[1] == 0.0
