"""Shards cut from a Hilbert curve through several metadata columns, by DataFrame functions alone.

Each dimension is quantised into ``2 ** bits`` bins of near equal counts, the cells' indices along the
curve order all rows, and shards are runs of that order. Rows near each other in every
dimension share a shard, so a reader that knows each shard's ranges (:func:`shard_ranges`) skips
most of them for a filter on any dimension, not only on the first one sorted by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstead.llm.storage import durable
from loomstead.llm.text import unused
from loomstead.operators.running import number_rows, running_sum

#: Bits that hold the state of the walk along the curve.
_STATE = 12
#: Leading bits of a whole number that decide its bin.
_FINE = 6
#: Characters of a string that decide its bin.
_PREFIX = 64


def _rotate(bits: int, by: int, n: int) -> int:
    """``bits`` of ``n`` rotated to the left."""
    by %= n
    return ((bits << by) | (bits >> (n - by))) & ((1 << n) - 1)


def curve_table(n: int) -> list[int]:
    """Steps of a Hilbert walk in ``n`` dimensions: at ``state << n | corner`` the corner's rank and the next state.

    A state is the corner at which the walk enters a cube and the axis along which it leaves.
    Of a cube's corners the one of rank w is the w-th Gray code, turned into that frame.
    """
    ranks = {w ^ (w >> 1): w for w in range(1 << n)}
    ones = lambda w: (~w & (w + 1)).bit_length() - 1  # noqa: E731  trailing ones
    table = []
    for state in range(n << n):
        enter, axis = divmod(state, n)
        for corner in range(1 << n):
            w = ranks[_rotate(corner ^ enter, -(axis + 1), n)]
            first = (w - 1) & ~1 if w else 0
            inner = first ^ (first >> 1)
            turn = ones(w - 1 if w % 2 == 0 else w) if w else 0
            after = (enter ^ _rotate(inner, axis + 1, n)) * n + (axis + turn + 1) % n
            table.append(w << _STATE | after)
    return table


def _literal(values: list[int]) -> Column:
    """A constant array, which the optimizer folds."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def curve_index(bins: list[Column], bits: int) -> Column:
    """Index along the Hilbert curve of the cell with these bins, each from 0 to ``2 ** bits - 1``."""
    n = len(bins)
    if not 2 <= n <= 8 or n * bits + _STATE > 62:
        raise ValueError("two to eight dimensions, of at most 50 bits together")
    steps, mask = _literal(curve_table(n)), (1 << _STATE) - 1

    def corner(level: int) -> Column:
        found = F.lit(0).cast("long")
        for axis, b in enumerate(bins):
            found = found.bitwiseOR(F.shiftleft(F.shiftright(b.cast("long"), level).bitwiseAND(1), axis))
        return found

    def step(walked: Column, at: Column) -> Column:
        found = F.get(steps, F.shiftleft(walked.bitwiseAND(mask), n).bitwiseOR(at).cast("int"))
        return F.shiftleft(F.shiftright(walked, _STATE), n + _STATE).bitwiseOR(found)

    walk = F.aggregate(F.array(*[corner(level) for level in reversed(range(bits))]), F.lit(0).cast("long"), step)
    return F.shiftright(walk, _STATE)


def _coarse(df: DataFrame, column: str) -> tuple[Column, Column]:
    """An order-preserving key of a column with few distinct values, as number and string of which one is null.

    A string's is its start. A whole number's is its leading bits with their count.
    """
    value = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.lit(None).cast("long"), F.substring(value, 1, _PREFIX)
    value = value.cast("long")
    size = F.abs(F.greatest(value, F.lit(1 - 2**63)))
    exponent = (F.length(F.bin(size)) - 1).cast("long")
    key = exponent * (4 << _FINE) + F.call_function("shiftright", size, F.greatest(exponent - _FINE, F.lit(0)).cast("int"))
    return F.when(value < 0, -key).otherwise(key), F.lit(None).cast("string")


def _bins(keyed: DataFrame, keys: list[tuple[str, str]], bits: int) -> list[Column]:
    """For each dimension, of which the columns of number and string are given, the bin of its value.

    Bins hold nearly as many rows each, as far as equal keys allow; a null is in bin 0 with
    the smallest values. Counts of all rows decide: they are added up by value before the
    shuffle and summed along all values by range. The driver gets the least value of each bin only.
    """
    each = [F.struct(F.lit(i).alias("dim"), F.col(number).alias("number"), F.col(string).alias("string")) for i, (number, string) in enumerate(keys)]
    values = keyed.select(F.explode(F.array(*each)).alias("k")).where("k.number is not null or k.string is not null")
    counts = values.groupBy("k.dim", "k.number", "k.string").agg(F.count("*").alias("n"))
    summed = running_sum(counts, [F.col("dim"), F.col("number"), F.col("string")], "n", "through")
    ends = {r.dim: r.through for r in summed.groupBy("dim").agg(F.max("through").alias("through")).collect()}
    starts, totals = [], []
    for i in range(len(keys)):
        starts.append(starts[-1] + totals[-1] if i else 0)
        totals.append(ends.get(i, starts[-1]) - starts[-1])
    at = F.col("dim") + 1
    placed = summed.select("dim", "number", "string", (F.col("through") - F.col("n") - F.element_at(_literal(starts), at)).alias("before"), F.element_at(_literal(totals), at).alias("total"))
    least = placed.groupBy("dim", F.expr(f"shiftleft(before, {bits}) div total").alias("bin")).agg(F.min("number").alias("number"), F.min("string").alias("string")).collect()
    found = []
    for i, (number, string) in enumerate(keys):
        edges = sorted((r.bin, r.number if r.string is None else r.string) for r in least if r.dim == i)
        found.append(_search(F.col(string if edges and isinstance(edges[0][1], str) else number), edges or [(0, None)]))
    return found


def _search(key: Column, edges: list[tuple[int, object]]) -> Column:
    """The bin of the last edge that is not above the key, by halving; the first one for nulls."""
    if len(edges) == 1:
        return F.lit(edges[0][0])
    middle = len(edges) // 2
    return F.when(key >= F.lit(edges[middle][1]), _search(key, edges[middle:])).otherwise(_search(key, edges[:middle]))


def assign(df: DataFrame, dims: list[str], shards: int, law: str = "rows", bits: int = 6, size: str | None = None, ties: list[str] | None = None) -> DataFrame:
    """Give every row a shard and a place in it (``shard``, ``slot``), and its cell's index (``curve``).

    Under the law ``rows`` counts of rows differ by one at most; under ``bytes`` each shard gets
    the rows of which the sizes before them (whole numbers in the column ``size``) fill the shards
    before it, so that sums differ by one row at most. Rows of one cell are ordered by the
    columns ``ties`` (without them by the hash of all columns), then by a number, so that repeated
    rows and a hot cell are dealt out over ranges and shards like others. Nulls count as smallest values. With fewer rows than shards some stay
    empty, as all do of an empty table. Columns named shard, slot and curve are replaced.
    """
    if law not in ("rows", "bytes") or (law == "bytes" and size is None):
        raise ValueError("the law is rows, or bytes with a column of sizes")
    tie, row, place, through = (unused(df, name) for name in ("tie", "row", "place", "through"))
    keys = [(unused(df, f"number{i}"), unused(df, f"string{i}")) for i in range(len(dims))]
    bins = [unused(df, f"bin{i}") for i in range(len(dims))]
    parts = [part for pair, c in zip(keys, dims, strict=True) for part in zip(pair, _coarse(df, c), strict=True)]
    inner = [c for c in df.columns if c.lower() not in ("shard", "slot", "curve")]
    columns = [f"`{c}`" for c in inner]
    told = F.struct(*[f"`{c}`" for c in ties]) if ties else F.xxhash64(*columns)
    kept = df.select(*columns, told.alias(tie), *[value.alias(name) for name, value in parts])
    kept = durable(kept.withColumn(row, F.monotonically_increasing_id()), "rows")  # bins are told by it, and rows that tie
    binned = kept.withColumns(dict(zip(bins, _bins(kept, keys, bits), strict=True)))
    indexed = binned.select(*columns, tie, row, curve_index([F.col(b) for b in bins], bits).alias("curve"))
    placed = number_rows(indexed, [F.col("curve"), F.col(tie), F.col(row)], place)
    if law == "rows":
        n = placed.count()
        cut = placed.withColumn("shard", F.expr(f"cast(`{place}` * {shards} div {max(n, 1)} as int)"))
        cut = cut.withColumn("slot", F.expr(f"`{place}` - (shard * {n}L + {shards - 1}) div {shards}"))
    else:
        summed = running_sum(placed, [F.col(place)], size, through)
        total = summed.agg(F.max(through)).first()[0] or 1
        cut = summed.withColumn("shard", F.least(F.expr(f"cast((`{through}` - coalesce(`{size}`, 0)) * {shards} div {total} as int)"), F.lit(shards - 1)))
        first = {r.shard: r.place for r in cut.groupBy("shard").agg(F.min(place).alias("place")).collect()}
        cut = cut.withColumn("slot", F.col(place) - F.element_at(_literal([first.get(i, 0) for i in range(shards)]), F.col("shard") + 1))
    return cut.drop(tie, row, place, through)


def write_shards(df: DataFrame, path: str, dims: list[str], shards: int, law: str = "rows", bits: int = 6, size: str | None = None) -> DataFrame:
    """Write the rows as Parquet by shard below ``path`` (folders ``shard=N``, rows in order) and return each shard's ranges.

    Whole rows, long texts with them, are sorted once by range and each range is one or two shards,
    so that writing needs no further shuffle. An empty table writes no shard.
    """
    found = assign(df, dims, shards, law, bits, size)
    found.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return shard_ranges(found, dims)


def shard_ranges(assigned: DataFrame, dims: list[str]) -> DataFrame:
    """Of each shard the rows and every dimension's least and largest value (``least_c``, ``largest_c``), nulls aside.

    A reader keeps the shards whose ranges meet its filter.
    """
    ranges = [f(f"`{c}`").alias(f"{name}_{c}") for c in dims for f, name in ((F.min, "least"), (F.max, "largest"))]
    return assigned.groupBy("shard").agg(F.count("*").alias("rows"), *ranges)
