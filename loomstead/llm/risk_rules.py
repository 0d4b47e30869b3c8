"""Quality rules whose cutoffs carry a guarantee on falsely rejected good documents."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstead.llm import text as tx
from loomstead.llm.storage import durable

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
REPEAT_WINDOW = 8


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs twice or more, and whether it stands for an earlier equal one."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice, again


def measure_slice(column: pa.Array) -> dict[str, np.ndarray]:
    """The METRICS of each text."""
    data, offsets = tx.utf8(column)
    n = len(offsets) - 1
    per_text = lambda flags: tx.per_text(flags, offsets)
    salt = lambda owner: tx.mix(owner.astype(np.uint64) + np.uint64(1))
    is_word = tx.IS_WORD[data]
    start, end, owner = tx.words(data, offsets)
    window, first = tx.windows(tx.span_hashes(data, start, end), owner, REPEAT_WINDOW)
    twice, _ = _repeated(window ^ salt(owner[first]))
    cover = np.zeros(len(start) + 1, np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + REPEAT_WINDOW, -1)
    covered = np.cumsum(cover)[:-1] > 0

    line_start, line_end = tx.runs(data != 10, offsets)  # empty lines have no word
    line_of = np.searchsorted(offsets, line_start, "right") - 1
    next_word = np.append(start, len(data))[np.searchsorted(end, line_start, "right")]
    worded = next_word < line_end
    line_start, line_end, line_of = line_start[worded], line_end[worded], line_of[worded]
    _, again = _repeated(tx.span_hashes(data, line_start, line_end) ^ salt(line_of))
    return {
        "n_words": np.bincount(owner, minlength=n),
        "word_chars": per_text(is_word & ((data & 0xC0) != 0x80)),
        "n_symbols": per_text(_SYMBOL[data]),
        "n_dup_lines": np.bincount(line_of[again], minlength=n),
        "n_repeat_words": np.bincount(owner[covered], minlength=n),
        "n_lines": np.bincount(line_of, minlength=n),
        "n_upper": per_text(_UPPER[data]),
    }


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the METRICS as long columns. A null or empty text has zero of everything."""
    fields = [T.StructField(m, T.LongType()) for m in METRICS]

    def make():
        def step(part: pa.RecordBatch) -> list[pa.Array]:
            found = measure_slice(part.column(text))
            return [pa.array(found[m].astype(np.int64)) for m in METRICS]

        return step

    return tx.append_columns(docs, fields, make, text)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _ratio(over: Column, under: str) -> Column:
    return F.when(F.col(under) > 0, over / F.col(under)).otherwise(0.0)


_SHARES = [round(0.005 * 1.35**i, 6) for i in range(18)]
#: Candidate cutoffs of each rule, from strict to lenient; fixed before any label is seen, as the correction needs.
GRIDS = {"symbols": _SHARES, "dup_lines": _SHARES, "repeats": _SHARES, "capitals": _SHARES, "long_words": [float(x) for x in range(5, 20)]}


def rules() -> dict[str, tuple[Column, list[float]]]:
    """Rule name: a score that is high for bad text, and its candidate cutoffs."""
    scores = {
        "symbols": _ratio(F.col("n_symbols").cast("double"), "word_chars"),
        "dup_lines": _ratio(F.col("n_dup_lines").cast("double"), "n_lines"),
        "repeats": _ratio(F.col("n_repeat_words").cast("double"), "n_words"),
        "capitals": _ratio(F.col("n_upper").cast("double"), "word_chars"),
        "long_words": _ratio(F.col("word_chars").cast("double"), "n_words"),
    }
    return {name: (score, GRIDS[name]) for name, score in scores.items()}


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials, by the regularised incomplete beta function."""
    if k >= n or p <= 0:
        return 1.0
    if k < 0 or p >= 1:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact (Clopper-Pearson) upper confidence bound of a rate at level ``1 - delta``."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_cdf(k, n, mid) > delta else (low, mid)
    return high


def _tighten(steps: np.ndarray, count: np.ndarray, risk: float, delta: float) -> dict[str, tuple[float, int, float]]:
    """Cutoff, rejected documents and bound of each rule that is used in one stratum.

    A row of ``steps`` holds, by rule, the number of tightenings from which it is rejected;
    ``count`` documents share it. Rules are tightened in turn, a step at a time, and each
    proposal is tested on what all rules together reject. A rule whose proposal isn't
    certain stays as it was from then on. Until the first failure this is one fixed
    sequence, in which only the first wrong proposal can do harm; after m failures it
    is one of at most C(proposals, m) fixed sequences, by where the failures were. Each of
    those is tested at ``delta / 2**(m + 1) / C(proposals, m)``, which adds up to less than ``delta``.
    """
    n = int(count.sum())
    proposals = sum(map(len, GRIDS.values()))
    level = lambda m: delta / 2 ** (m + 1) / math.comb(proposals, m)
    now = np.zeros(len(GRIDS), np.int64)
    stopped: list[int] = []
    for step in range(1, 1 + max(map(len, GRIDS.values()))):
        for r, grid in enumerate(GRIDS.values()):
            if r in stopped or step > len(grid):
                continue
            tried = now.copy()
            tried[r] = step
            k = int(count[(steps <= tried).any(1)].sum())
            if k <= risk * n and binomial_cdf(k, n, risk) <= level(len(stopped)):
                now, passed = tried, (k, n, level(len(stopped)))
            else:
                stopped.append(r)
    bound = upper_bound(*passed) if now.any() else 1.0
    return {name: (grid[-now[r]], int(count[steps[:, r] <= now[r]].sum()), bound) for r, (name, grid) in enumerate(GRIDS.items()) if now[r]}


def select_cutoffs(labelled: DataFrame, stratum: str, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Strict cutoffs of the rules in each stratum with a guaranteed false rejection rate.

    ``labelled`` holds good held-out documents with METRICS. With probability ``1 - delta``
    the chosen cutoffs of every stratum together reject at most ``risk`` of its good
    documents: each stratum is tested at ``delta`` over the number of strata, as
    :func:`_tighten` tells. A stratum with too few good documents for any cutoff gets none,
    isn't counted among the strata, and so keeps everything. Returns stratum, rule, cutoff, n_good, n_rejected
    (good documents that fail this rule alone) and bound (of all the stratum's rules together).

    Strata are tested in tasks of their own, each on one count of every met combination of grid places: no more than the
    grids' product, however many documents a stratum has. The driver only gets the number of strata.
    """
    family = rules()
    least = math.ceil(math.log(delta) / math.log1p(-risk))  # with fewer, not even a single stratum could be certain of anything
    # tightenings from which a score is rejected: cutoffs are tried from the last of the grid to the first
    place = [(F.lit(len(grid) + 1) - sum((F.when(score > c, 1).otherwise(0) for c in grid), F.lit(0))).alias(f"r{i}") for i, (score, grid) in enumerate(family.values())]
    steps = [f"r{i}" for i in range(len(family))]
    cells = durable(labelled.select(F.col(stratum).cast("string").alias("stratum"), *place).groupBy("stratum", *steps).agg(F.count("*").alias("n")), "cells")
    able = cells.groupBy("stratum").agg(F.sum("n").alias("good")).where(F.col("good") >= least).select(F.col("stratum").alias("able"))
    strata = max(able.count(), 1)

    def choose(found: pd.DataFrame) -> pd.DataFrame:
        chosen = _tighten(found[steps].to_numpy(np.int64), found["n"].to_numpy(np.int64), risk, delta / strata)
        rows = [(found["stratum"].iloc[0], name, c, int(found["n"].sum()), k, bound) for name, (c, k, bound) in chosen.items()]
        return pd.DataFrame(rows, columns=["stratum", "rule", "cutoff", "n_good", "n_rejected", "bound"])

    mine = cells.join(able, F.col("stratum").eqNullSafe(F.col("able")), "left_semi")
    return durable(mine.groupBy("stratum").applyInPandas(choose, "stratum string, rule string, cutoff double, n_good long, n_rejected long, bound double"), "cutoffs")


def apply_cutoffs(measured: DataFrame, cutoffs: DataFrame, stratum: str, flag: str = "kept") -> DataFrame:
    """Add ``flag``: true unless the base rules or a chosen cutoff of the row's stratum reject it. A column of that name is replaced."""
    family = rules()
    of, *limits = (tx.unused(measured, c) for c in ("of", *family))
    wide = cutoffs.groupBy(F.col("stratum").alias(of)).agg(*[F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(c) for rule, c in zip(family, limits, strict=True)])
    rejected = F.lit(False)
    for (score, _), limit in zip(family.values(), limits, strict=True):
        rejected |= F.coalesce(score > F.col(limit), F.lit(False))
    joined = measured.join(wide, F.col(f"`{stratum}`").cast("string").eqNullSafe(F.col(of)), "left")
    return joined.withColumn(flag, ~base_failed() & ~rejected).drop(of, *limits)


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, delta: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Measure every document once, choose cutoffs on the labelled good ones, and apply them.

    A document labelled twice is good only if each label says so; null labels aren't good.
    Documents repeated under one id are measured and judged one by one; null and empty texts
    fail the base rules; an empty table gives an empty one. A long text takes about ten bytes
    a byte, and eighty a word.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("__good")).where("__good").select("doc_id")
    measured = durable(measure(docs.select("doc_id", "text", F.col(stratum).cast("string").alias("stratum"))).drop("text"), "rules")
    cutoffs = select_cutoffs(measured.join(good, "doc_id", "left_semi").where(~base_failed()), "stratum", risk, delta)
    return apply_cutoffs(measured.withColumn("base_failed", base_failed()), cutoffs, "stratum"), cutoffs
