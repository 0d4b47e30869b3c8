"""Conversation repair against SQL and a plain search over all edits."""

import hashlib
import re
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from loomstead.llm import conversations

NEXT = {"e": "su", "s": "u", "u": "a", "a": "u"}
WORD = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        found = WORD.findall(text)
        out.append("blank" if not found else "duplicate" if (role, text) in seen else "" if found[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Cost, initials and turns of the best edits, searched from the end."""
    found = faults(rows)

    @lru_cache(None)
    def best(i, state, inserted):
        ways = []
        if i == len(rows):
            if state in "ea":
                ways.append((0, "", ()))
        else:
            cost, audit, turns = best(i + 1, state, 0)
            ways.append((cost + 4, "D" + audit, turns))
            _, role, text = rows[i]
            if found[i] not in ("blank", "duplicate"):
                more = 3 * (found[i] == "truncated")
                if role[:1] and role[:1] in NEXT[state]:
                    cost, audit, turns = best(i + 1, role[:1], 0)
                    ways.append((cost + more, "K" + audit, ((role, text), *turns)))
                for new in ("user", "assistant"):
                    if new[0] in NEXT[state]:
                        cost, audit, turns = best(i + 1, new[0], 0)
                        ways.append((cost + more + 3, "R" + audit, ((new, text), *turns)))
        if inserted < 3:
            for new in ("user", "assistant"):
                if new[0] in NEXT[state]:
                    cost, audit, turns = best(i, new[0], inserted + 1)
                    ways.append((cost + 3, "I" + audit, ((new, ""), *turns)))
        return min(ways) if ways else (10**9, "", ())

    return best(0, "e", 0)


def expected(rows):
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    kinds, first = faults(rows), [r[:1] for _, r, _ in rows]
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    cost, audit, turns = cheapest(rows)
    return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, turns


def made_rows():
    import random

    rng = random.Random(9)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    texts = ["Yes.", "No!", "cut off", " ", "", None, "A stop.  \n", "¿Sí?", "same.", "same."]
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn + 2, None]), rng.choice(roles), rng.choice(texts) if turn % 2 else f"own text {turn}."))
    rows += [(None, 0, "user", "no id."), (None, 1, "assistant", "yes."), (99, None, "user", "x."), (99, None, "user", "x.")]
    rows += [(98, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(40) if t != 17]
    return rows + rows[:5]  # repeated rows


@pytest.mark.parametrize("part_rows", [1, 3, 512])
def test_repair_is_the_cheapest(spark, monkeypatch, part_rows):
    monkeypatch.setattr(conversations, "PART_ROWS", part_rows)
    rows = made_rows()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("x") for c in ("place", "initial", "fault", "audit", "cost", "turns", "nth", "part", "kind")})
    got = {r.conv_id: r for r in conversations.repair(frame).collect()}
    assert got.keys() == {r[0] for r in rows}
    for conv, r in got.items():
        want = expected([x[1:] for x in rows if x[0] == conv])
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == want[:-1], conv
        assert tuple((t.role, t.text) for t in r.turns) == want[-1], conv
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in r.turns))


def test_damage_of_nulls_and_empty_tables(spark):
    frame = spark.createDataFrame([(None, None, None, None), (1, 2, "user", None)], SCHEMA)
    assert {(r.role, r.text) for r in conversations.damage(frame).collect()} <= {("user", " "), (" ", " "), ("user", ""), (" ", "")}
    none = frame.limit(0)
    assert conversations.damage(none).count() == 0
    assert conversations.repair(none).collect() == []


def test_a_long_conversation_and_a_long_text(spark):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(3000)] + [(2, 0, "user", "word " * 300_000 + "end."), (2, 1, "assistant", "Yes.")]
    got = {r.conv_id: r for r in conversations.repair(spark.createDataFrame(turns, SCHEMA)).collect()}
    assert got[1].audit == "K" * 3000 and got[1].cost == 0 and len(got[1].turns) == 3000
    assert got[2].audit == "KK" and len(got[2].turns[0].text) == 1_500_004
    assert hashlib.sha256(got[2].turns[0].text.encode()).hexdigest() == hashlib.sha256(turns[-2][3].encode()).hexdigest()
