"""Order without a single-task sort: exact ranks, running totals and key cut-offs.

Rows have no order in Spark, so every ordered operator names a total key. A window without ``partitionBy`` (or with one
hot group) would pull that whole group into one task. The helpers here range-partition the *keys*, write them to
reliable storage once (a second sampling could choose other ranges), and combine per-range totals, of which there are
at most as many as ranges. There is one way for all sizes. Nulls come first, as in Spark's own ascending sort.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from pairloom.session import materialize

_CHUNK = "_chunk"


def _ranged(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return materialize(df.repartitionByRange(*keys).withColumn(_CHUNK, F.spark_partition_id()))


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Add ``out`` = sum of ``value`` over the rows strictly before this one in its group.

    ``group + order`` must be a total key. A hot group is spread over many ranges; a range is the largest unit one task
    ever holds.
    """
    group, order = list(group), list(order)
    zero = F.lit(0).cast("long")
    rows = _ranged(df.withColumn("_value", value.cast("long")), group + order)
    totals = rows.groupBy(*group, _CHUNK).agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*group).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    # A group has an earlier range only if it is the first group of its own range: at most one row per range, so the
    # broadcast is bounded by the number of ranges.
    offsets = (
        totals.withColumn("_offset", F.sum("_total").over(before))
        .where(F.col("_offset").isNotNull())
        .select(*[F.col(c).alias(f"_of_{c}") for c in (*group, _CHUNK)], "_offset")
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*group, _CHUNK)])
    inside = Window.partitionBy(*group, _CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(F.broadcast(offsets), same, "left")
        .withColumn(out, F.coalesce("_offset", zero) + F.coalesce(F.sum("_value").over(inside), zero))
        .drop("_value", "_offset", _CHUNK, *[f"_of_{c}" for c in (*group, _CHUNK)])
    )


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Add the 0-based position of each row within its group."""
    return running_total(df, group, order, F.lit(1), out)


def with_place(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Add each row's 0-based position in the given order. Rows with equal keys are numbered by their content, copies in
    any order; the number goes with the row, and copies may be spread over ranges."""
    names = [f"_k{i}" for i in range(len(order))]
    keyed = df.select("*", *[c.alias(n) for c, n in zip(order, names)], content_hash(df).alias("_tie"))
    # Copies of a row differ in this number only.
    spread = keyed.withColumn("_copy", F.monotonically_increasing_id())
    return numbered(spread, [], [*names, "_tie", "_copy"], out).drop(*names, "_tie", "_copy")


@dataclass(frozen=True)
class Cut:
    """A place in an order: the key of the row at ``position``, how many rows have smaller keys, how many this one."""

    position: int
    key: Row
    before: int
    equal: int


def cuts(df: DataFrame, order: Sequence[Column], places: Callable[[int], Sequence[int]]) -> list[Cut | None]:
    """The cuts at the 0-based positions that ``places`` names for the number of rows; ``None`` past the end.

    Only keys are read and shuffled. The driver gets one count per range and one row per position.
    """
    names = [f"_k{i}" for i in range(len(order))]
    rows = _ranged(df.select(*[c.alias(n) for c, n in zip(order, names)]), names)
    starts: dict[int, int] = {}
    total = 0
    for chunk, n in sorted((r[_CHUNK], r["n"]) for r in rows.groupBy(_CHUNK).agg(F.count("*").alias("n")).collect()):
        starts[chunk] = total
        total += n
    positions = list(places(total))
    # A key lies in one range. Its chunk and its place there, for every position that is in the set:
    local = {p: max((start, chunk) for chunk, start in starts.items() if start <= p) for p in positions if 0 <= p < total}
    if not local:
        return [None] * len(positions)
    inside = Window.partitionBy(_CHUNK).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    here = reduce(lambda a, b: a | b, [
        (F.col(_CHUNK) == chunk) & (F.col("_before") <= p - start) & (F.col("_before") + F.col("_equal") > p - start)
        for p, (start, chunk) in local.items()])
    found = (
        rows.where(F.col(_CHUNK).isin(sorted({chunk for _, chunk in local.values()})))
        .groupBy(_CHUNK, *names).agg(F.count("*").alias("_equal"))
        .withColumn("_before", F.coalesce(F.sum("_equal").over(inside), F.lit(0))).where(here).collect()
    )

    def cut(p: int) -> Cut | None:
        if p not in local:
            return None
        start, chunk = local[p]
        row = next(r for r in found if r[_CHUNK] == chunk and r["_before"] <= p - start < r["_before"] + r["_equal"])
        return Cut(p, Row(*[row[n] for n in names]), start + row["_before"], row["_equal"])

    return [cut(p) for p in positions]


def keys_at(df: DataFrame, order: Sequence[Column], positions: Sequence[int]) -> list[Row | None]:
    """The order keys at the given 0-based positions (``None`` past the end)."""
    return [cut and cut.key for cut in cuts(df, order, lambda _: positions)]


def precedes(order: Sequence[Column], key: Row) -> Column:
    """True for rows whose order key is strictly smaller than ``key``, false for all others, nulls first.

    A plain predicate that scans can push down.
    """
    def less(column: Column, value) -> Column:
        return F.lit(False) if value is None else column.isNull() | (column < F.lit(value))

    terms = []
    for i, column in enumerate(order):
        equal = [c.eqNullSafe(F.lit(v)) for c, v in zip(order[:i], key)]
        terms.append(reduce(lambda a, b: a & b, [*equal, less(column, key[i])]))
    exact = F.coalesce(reduce(lambda a, b: a | b, terms), F.lit(False))
    if len(order) == 1 or key[0] is None:
        return exact
    return (order[0].isNull() | (order[0] <= F.lit(key[0]))) & exact


def equals(order: Sequence[Column], key: Row) -> Column:
    """True for rows with this order key; nulls are equal."""
    return reduce(lambda a, b: a & b, [c.eqNullSafe(F.lit(v)) for c, v in zip(order, key)])


def content_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns; a null differs from a missing value."""
    columns = [df[f"`{c}`"] for c in df.columns]
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


class Edge:
    """A cut as predicates: the rows ``before`` it, and the equal rows that it divides, if it does.

    Rows with the cut's key are told apart by a hash of all their columns, read for those rows only. What is still equal
    are copies of one row, of which ``inside`` lie before the cut and ``copies - inside`` after it.
    """

    def __init__(self, df: DataFrame, order: Sequence[Column], cut: Cut):
        self.before, self.divided, self.same = precedes(order, cut.key), None, None
        self.inside = self.copies = 0
        left = cut.position - cut.before
        if not left:
            return
        equal, tie = equals(order, cut.key), content_hash(df)
        [at] = cuts(df.where(equal), [tie], lambda _: [left])
        self.before = self.before | (equal & (tie < F.lit(at.key[0])))
        self.inside = left - at.before
        if self.inside:
            self.copies, self.same = at.equal, (cut.key, at.key[0])
            self.divided = equal & (tie == F.lit(at.key[0]))


def _copied(df: DataFrame, edge: Edge, n: int) -> DataFrame:
    """So many copies of the row that an edge divides; they are made where they are needed, not moved."""
    one = F.broadcast(df.where(edge.divided).limit(1))
    return df.sparkSession.range(n).crossJoin(one).select(*[f"`{c}`" for c in df.columns])


def between(df: DataFrame, low: Edge | None, high: Edge | None) -> DataFrame:
    """The rows from one edge on and before another; ``None`` is the set's own end."""
    if low and high and low.same and low.same == high.same:
        return _copied(df, low, high.inside - low.inside)
    out = df
    if low:
        out = out.where(~(low.before if low.divided is None else low.before | low.divided))
    if high:
        out = out.where(high.before)
    for edge, n in ((low, low.copies - low.inside if low else 0), (high, high.inside if high else 0)):
        if n:
            out = out.unionByName(_copied(df, edge, n))
    return out


def ordered_slice(df: DataFrame, order: Sequence[Column], skip: int, count: int | None) -> DataFrame:
    """Rows ``[skip, skip + count)`` in the given order, as a filter between two keys.

    Rows with equal keys are put in the order of their content, so a cut among them takes the same ones every time.
    """
    if skip < 0 or (count is not None and count < 0):
        raise ValueError("skip and count must not be negative")
    if count == 0:
        return df.limit(0)
    positions = ([skip] if skip else []) + ([skip + count] if count is not None else [])
    if not positions:
        return df
    found = cuts(df, order, lambda _: positions)
    if skip and found[0] is None:
        return df.limit(0)
    low = Edge(df, order, found[0]) if skip else None
    high = Edge(df, order, found[-1]) if count is not None and found[-1] is not None else None
    return between(df, low, high)


def ordered_split(df: DataFrame, order: Sequence[Column], ratio: float) -> tuple[DataFrame, DataFrame]:
    """The first ``int(n * ratio)`` rows in the given order, and all others. Count and cut come from one table of keys."""
    [cut] = cuts(df, order, lambda n: [int(n * ratio)])
    if cut is None:
        return (df, df.limit(0)) if ratio > 0 else (df.limit(0), df)
    if cut.position == 0:
        return df.limit(0), df
    edge = Edge(df, order, cut)
    return between(df, None, edge), between(df, edge, None)
