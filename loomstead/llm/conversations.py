"""Repair of conversations so that roles alternate: the cheapest edits, found by folds of Spark's own functions.

A repaired conversation has role initials ``(s?(ua)+)?``. Rows may be kept (K, cost 0), get the
other role (R, 3) or go (D, 4), and rows of empty text may be put in anywhere (I, 3); a row that
is kept or gets another role although its text ends without ``.!?`` costs 3 more, and blank
and repeated rows have to go. Of the cheapest edits those whose initials come first in ASCII are
taken. Equally cheap edits of the same rows never begin with one another, as a longer one has
a dearer insertion more, so the better of two beginnings stays better whatever follows: the
fold may keep one (cost, audit) for each of four states, and parts of a conversation may be
folded apart and then joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.llm.text import unused
from loomstead.operators.running import number_rows

#: Nothing written yet; a system turn; last a user's; last an assistant's.
STATES = "esua"
#: Turns of one conversation that are folded as one part.
PART_ROWS = 512
#: More than any edits cost.
_NEVER = 1 << 50

_WORD = r"[^\x20\x09-\x0D]"


def damage(turns: DataFrame) -> DataFrame:
    """The contract's damage, by the CRC of ``conv_id:turn``: drop, empty, cut stops, repeat, make a user's.

    Nulls in role and text are one space, in the checked text too. Other columns go.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def flag(turns: DataFrame) -> DataFrame:
    """Number the turns and name each one's first fault (``place``, ``initial``, ``fault``).

    Turns of a conversation stand by ``turn`` (nulls first), then by role and text. A fault is blank
    (no character but white space), duplicate (role and text stood earlier in the conversation) or truncated
    (the last such character is none of ``.!?``), else null. ``initial`` is the role's first letter if it is one of s, u, a,
    else ``-``. Windows are by conversation, role and text, so a long conversation isn't one task.
    Nulls in role or text count as one space.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn")))
    first = F.substring("role", 1, 1)
    kind = F.when(~F.col("text").rlike(_WORD), "blank").when(nth > 1, "duplicate").when(~F.col("text").rlike(rf"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    flagged = rows.select("*", kind.alias("fault"), F.when(first.isin("s", "u", "a"), first).otherwise("-").alias("initial"), nth.alias("nth"))
    return number_rows(flagged, [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text"), F.col("nth")]).drop("nth")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _plus(path: Column, cost: int | Column, letter: str | Column) -> Column:
    letter = F.lit(letter) if isinstance(letter, str) else letter
    return F.struct((path["cost"] + F.lit(cost) if isinstance(cost, int) else path["cost"] + cost).alias("cost"), F.concat(path["audit"], letter).alias("audit"))


def _start(at: str) -> Column:
    own = lambda s: F.struct(F.lit(0 if s == at else _NEVER).cast("long").alias("cost"), F.lit("").alias("audit"))
    return F.struct(*[own(s).alias(s) for s in STATES])


def _inserted(held: Column) -> Column:
    """The states that rows put in here lead to, too: one more row, or two from nothing or a system turn."""
    u = lambda h: F.least(h["u"], _plus(F.least(h["e"], h["s"], h["a"]), 3, "I"))
    after = _let(held, lambda h: F.struct(h["e"].alias("e"), h["s"].alias("s"), u(h).alias("u"), h["a"].alias("a")))
    return _let(after, lambda h: F.struct(h["e"].alias("e"), h["s"].alias("s"), h["u"].alias("u"), F.least(h["a"], _plus(h["u"], 3, "I")).alias("a")))


def _turn(held: Column, turn: Column) -> Column:
    """One turn further, and what may be put in after it. ``turn`` has the initial and the fault."""
    must_go = turn["fault"].isin("blank", "duplicate")
    more = F.when(must_go, F.lit(_NEVER)).when(turn["fault"] == "truncated", F.lit(3)).otherwise(F.lit(0)).cast("long")
    is_ = lambda s: turn["initial"] == s

    def to(path: Column, initial: str) -> Column:
        return _plus(path, more + F.when(is_(initial), F.lit(0)).otherwise(F.lit(3)), F.when(is_(initial), F.lit("K")).otherwise(F.lit("R")))

    system = _plus(held["e"], more + F.when(is_("s"), F.lit(0)).otherwise(F.lit(_NEVER)), "K")
    gone = {s: _plus(held[s], 4, "D") for s in STATES}
    after = {"e": gone["e"], "s": F.least(gone["s"], system), "u": F.least(gone["u"], to(F.least(held["e"], held["s"], held["a"]), "u")), "a": F.least(gone["a"], to(held["u"], "a"))}
    return _inserted(F.struct(*[after[s].alias(s) for s in STATES]))


def _fold(turns: Column, start: str) -> Column:
    """The four states after a part's turns, begun in ``start``."""
    return F.aggregate(turns, _start(start), _turn)


def _joined(parts: Column) -> Column:
    """The four states after all parts: each part has, by the state it began in, the states it ends in."""

    def further(held: Column, part: Column) -> Column:
        ways = {end: F.least(*[_plus(held[s], part[s][end]["cost"], part[s][end]["audit"]) for s in STATES]) for end in STATES}
        return F.struct(*[ways[s].alias(s) for s in STATES])

    return F.aggregate(parts, _inserted(_start("e")), further)


def audit(flagged: DataFrame) -> DataFrame:
    """Each conversation's faults and cheapest edits, from the turns that :func:`flag` numbered.

    Columns: ``conv_id``, ``gaps`` (turn numbers missing between the least and the largest), ``blank``,
    ``duplicate``, ``truncated``, ``illegal`` (neighbours whose initials are not su, ua, au), ``cost`` and ``audit``.
    A conversation is folded in parts of at most ``PART_ROWS`` turns so one that
    holds a third of all turns is dealt out; what meets in one row is a letter or two a turn.
    """
    dealt = flagged.select("conv_id", "place", "initial", "fault", F.expr(f"place div {PART_ROWS}").alias("part"))
    tasks = int(flagged.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes but much work, so not to be put together by size
    grouped = dealt.repartition(tasks, "conv_id", "part").groupBy("conv_id", "part")
    count = lambda kind: F.count_if(F.col("fault") == kind).alias(kind)
    parts = grouped.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "initial", F.coalesce("fault", F.lit("")).alias("fault")))), lambda t: F.struct(t["initial"].alias("initial"), t["fault"].alias("fault"))).alias("turns"), count("blank"), count("duplicate"), count("truncated"))
    folded = parts.select("conv_id", "part", "blank", "duplicate", "truncated", F.array_join(F.transform("turns", lambda t: t["initial"]), "").alias("initials"), F.struct(*[_fold(F.col("turns"), s).alias(s) for s in STATES]).alias("ways"))
    in_order = folded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "initials", "ways"))).alias("parts"), *[F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated")])
    ends = in_order.select("conv_id", "blank", "duplicate", "truncated", F.array_join(F.transform("parts", lambda p: p["initials"]), "").alias("initials"), _joined(F.transform("parts", lambda p: p["ways"])).alias("end"))
    best = ends.select("*", F.least("end.e", "end.a").alias("best"))
    legal = F.regexp_count("initials", F.lit("(?=su|ua|au)"))
    numbers = flagged.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    found = best.join(numbers.select(F.col("conv_id").alias("__conv"), "gaps"), F.col("conv_id").eqNullSafe(F.col("__conv")))
    return found.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", (F.length("initials") - 1 - legal).cast("long").alias("illegal"), F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"))


def _repaired(turns: Column, edits: Column) -> Column:
    """The turns (role, text) that the edits' initials make of a conversation's, in order."""
    ends = F.sequence(F.lit(1), F.length(edits))

    def made(p: Column) -> Column:
        before = F.substring(edits, F.lit(1), p)
        letter = F.right(before, F.lit(1))
        row = F.get(turns, F.length(F.translate(before, "I", "")) - 1)
        written = F.length(F.translate(before, "D", ""))
        return F.struct(letter.alias("letter"), row.alias("row"), written.alias("written"))

    steps = F.filter(F.transform(ends, made), lambda x: x["letter"] != "D")

    def turn(steps: Column) -> Column:
        top = F.get(steps, F.lit(0))
        system = F.when((top["letter"] == "K") & top["row"]["role"].startswith("s"), 1).otherwise(0)

        def role(x: Column) -> Column:
            return F.when(x["letter"] == "K", x["row"]["role"]).when((x["written"] - system) % 2 == 1, "user").otherwise("assistant")

        return F.transform(steps, lambda x: F.struct(role(x).alias("role"), F.when(x["letter"] == "I", "").otherwise(x["row"]["text"]).alias("text")))

    empty = F.array().cast("array<struct<role:string,text:string>>")
    return F.when(F.length(edits) > 0, _let(steps, turn)).otherwise(empty)


def repair(turns: DataFrame) -> DataFrame:
    """Every conversation with its faults, its cheapest edits and the turns these leave (``turns``: role, text).

    ``turns`` of the input has conv_id, turn (a whole number), role and text; other columns go. A null ``conv_id`` is a conversation like
    others; nulls in role and text are one space. Repeated rows are duplicates. A conversation of which
    all turns go has empty ``turns`` and an audit of D's; an empty table gives none. A repaired
    conversation is one row and so holds its texts together, up to Spark's limit of a row (2 GB);
    faults and edits are found without that.
    """
    flagged = flag(turns)
    name = unused(flagged, "conv")
    found = audit(flagged)
    texts = flagged.groupBy(F.col("conv_id").alias(name)).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    both = found.join(texts, F.col("conv_id").eqNullSafe(F.col(name)))
    return both.select(*found.columns, _repaired(F.col("turns"), F.col("audit")).alias("turns"))
