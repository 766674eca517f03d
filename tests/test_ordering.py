import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from pairloom.operators import ordering as O

random.seed(5)
# Group "hot" holds most rows.
DATA = [("hot" if i % 4 else f"g{i % 7}", f"k{i * 37 % 1000:04d}", i % 5) for i in range(1000)]


@pytest.fixture
def data(spark):
    return spark.createDataFrame(DATA, "g string, k string, v int").repartition(6)


def test_running_total(data, rows):
    got = rows(O.running_total(data, ["g"], ["k"], F.col("v"), "before"), "g", "k", "before")
    want = []
    for group in {g for g, _, _ in DATA}:
        members = sorted((k, v) for g, k, v in DATA if g == group)
        sums = [0, *accumulate(v for _, v in members)]
        want += [(group, k, s) for (k, _), s in zip(members, sums)]
    assert got == sorted(want, key=repr)


def test_numbered_whole_set(data, rows):
    got = rows(O.numbered(data, [], ["k"], "idx"), "k", "idx")
    assert got == sorted(((k, i) for i, k in enumerate(sorted(k for _, k, _ in DATA))), key=repr)


def test_keys_at(data):
    order = [F.col("v"), F.col("k")]
    ranked = sorted((v, k) for _, k, v in DATA)
    found = O.keys_at(data, order, [0, 1, 500, 999, 1000])
    assert [None if f is None else tuple(f) for f in found] == [ranked[0], ranked[1], ranked[500], ranked[999], None]


@pytest.mark.parametrize("skip, count", [(0, 10), (3, 0), (990, 100), (2000, 5), (5, None), (0, None), (0, 1000)])
def test_ordered_slice(data, rows, skip, count):
    order = [F.col("v"), F.col("k")]
    ranked = sorted((v, k) for _, k, v in DATA)
    end = None if count is None else skip + count
    assert rows(O.ordered_slice(data, order, skip, count), "v", "k") == sorted(ranked[skip:end], key=repr)


# Nulls in every part of the key, and repeated values.
NULLS = [(None if i % 5 == 0 else i % 3, None if i % 7 == 0 else f"k{i % 40:02d}", i) for i in range(200)]


def nulls_first(row):
    return [(x is not None, x if x is not None else 0) for x in row]


@pytest.mark.parametrize("skip, count", [(0, 8), (0, 60), (35, 20), (100, None), (199, 5), (0, 200)])
def test_slices_with_null_keys(spark, rows, skip, count):
    df = spark.createDataFrame(NULLS, "a int, b string, c int").repartition(5)
    order = [F.col("a"), F.col("b"), F.col("c")]
    end = None if count is None else skip + count
    got = rows(O.ordered_slice(df, order, skip, count), "a", "b", "c")
    assert got == sorted(sorted(NULLS, key=nulls_first)[skip:end], key=repr)


@pytest.mark.parametrize("at", [0, 3, 30, 50, 111, 199])
def test_precedes_cuts_the_set_in_two_whole_parts(spark, at):
    df = spark.createDataFrame(NULLS, "a int, b string, c int")
    order = [F.col("a"), F.col("b"), F.col("c")]
    key = O.keys_at(df, order, [at])[0]
    assert df.where(O.precedes(order, key)).count() == at
    assert df.where(~O.precedes(order, key)).count() == len(NULLS) - at


def test_running_total_with_null_groups(spark, rows):
    df = spark.createDataFrame(NULLS, "a int, b string, c int").repartition(5)
    got = {c: n for _, _, c, n in rows(O.numbered(df, ["a"], ["b", "c"], "n"), "a", "b", "c", "n")}
    for group in (None, 0, 1, 2):
        members = sorted((r for r in NULLS if r[0] == group), key=nulls_first)
        assert [got[c] for _, _, c in members] == list(range(len(members)))


# Equal keys with other content, and copies of whole rows.
REPEATS = [(i % 3, f"c{i % 4}") for i in range(60)] + [(1, "c9")] * 25 + [(None, None)] * 7


@pytest.mark.parametrize("skip, count", [(0, 1), (0, 2), (5, 1), (3, 40), (30, 3), (0, 92), (50, None), (91, 9), (92, 1)])
def test_slices_among_equal_keys(spark, skip, count):
    df = spark.createDataFrame(REPEATS, "a int, b string").repartition(4)
    order = [F.col("a")]
    end = len(REPEATS) if count is None else min(skip + count, len(REPEATS))
    part = [tuple(r) for r in O.ordered_slice(df, order, skip, count).collect()]
    ranked = sorted((a for a, _ in REPEATS), key=lambda a: (a is not None, a))
    assert sorted((a for a, _ in part), key=repr) == sorted(ranked[skip:end], key=repr)
    # With what is before and after it, the set is whole.
    before = O.ordered_slice(df, order, 0, skip).collect()
    after = [] if count is None else O.ordered_slice(df, order, skip + count, None).collect()
    assert sorted([*part, *map(tuple, before), *map(tuple, after)], key=repr) == sorted(REPEATS, key=repr)


@pytest.mark.parametrize("ratio", [0.0, 0.1, 0.5, 0.77, 1.0, 2.0])
def test_split_parts_are_complete(spark, ratio):
    df = spark.createDataFrame(REPEATS, "a int, b string").repartition(4)
    left, right = (list(map(tuple, part.collect())) for part in O.ordered_split(df, [F.col("a")], ratio))
    assert len(left) == min(len(REPEATS), int(len(REPEATS) * ratio))
    assert sorted(left + right, key=repr) == sorted(REPEATS, key=repr)


def test_empty_set_is_split_and_cut(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert [p.count() for p in O.ordered_split(df, [F.col("a")], 0.5)] == [0, 0]
    assert O.ordered_slice(df, [F.col("a")], 0, 3).count() == 0


def test_places_of_equal_rows(spark):
    df = spark.createDataFrame(REPEATS, "a int, b string").repartition(4)
    got = sorted((r.n, r.a) for r in O.with_place(df, [F.col("a")], "n").collect() if r.a is not None)
    assert [n for n, _ in got] == list(range(7, len(REPEATS))) and [a for _, a in got] == sorted(a for _, a in got)
