import random

import pytest
from pyspark.sql import functions as F

from pairloom import schemas
from pairloom.operators import pairing as P
from pairloom.plans.build import build_examples, match_sides, read_functions

random.seed(11)
# One id holds a third of all functions of its artifact.
FUNCTIONS = [
    (f"art{i % 3}", random.choice(["c", "cpp"]), random.choice(["source", "decompiled"]), f"p{random.randrange(40):02d}", i,
     "hot::main" if i % 3 == 0 else f"f::n{random.randrange(60)}", random.choice(["", "  ", f"body {i}"]))
    for i in range(900)
]


@pytest.fixture(scope="module")
def functions(spark):
    df = spark.createDataFrame(
        FUNCTIONS, "artifact string, code_type string, side string, path string, pos int, function_id string, body string"
    )
    return df.repartition(5).persist()


@pytest.fixture
def sides(functions):
    return (P.dedupe_source(functions.where("side = 'source'")),
            P.dedupe_decompiled(functions.where("side = 'decompiled'")))


def expected(side):
    first, last = {}, {}
    for artifact, ct, s, path, pos, fid, body in sorted(FUNCTIONS, key=lambda f: (f[3], f[4])):
        if s == side:
            first.setdefault((artifact, ct, fid), (path, pos))
            last[artifact, ct, fid] = body
    return {k: (last[k], first[k]) for k in last}


def test_last_body_first_position(sides):
    for df, side in zip(sides, ("source", "decompiled")):
        got = {(r.artifact, r.code_type, r.function_id): (r.body, tuple(r.seq)) for r in df.collect()}
        assert got == expected(side)


def test_pairs_and_missing_add_up(sides, rows):
    source, decompiled = sides
    s, d = expected("source"), expected("decompiled")
    pairs = P.pair_examples(source, decompiled)
    assert rows(pairs, "artifact", "code_type", "ident", "source", "decompiled") == sorted(
        ((*k, s[k][0], d[k][0]) for k in s.keys() & d.keys()), key=repr)
    assert rows(P.missing_sources(source, decompiled)) == sorted(d.keys() - s.keys(), key=repr)
    assert rows(P.missing_decompileds(source, decompiled)) == sorted(s.keys() - d.keys(), key=repr)
    kept, dropped = P.drop_half_blank(pairs).count(), P.half_blank_report(pairs).count()
    assert kept + dropped == pairs.count() and dropped > 0
    assert P.drop_half_blank(pairs).where(F.trim("source") == "").count() > 0  # both blank stays


def test_one_grouping_equals_separate_operators(functions, sides, rows):
    fused = match_sides(functions)
    both = fused.where(F.col("source").isNotNull() & F.col("decompiled").isNotNull())
    assert rows(both, "artifact", "code_type", "function_id", "source", "decompiled", "seq") == rows(
        P.pair_examples(*sides), "artifact", "code_type", "ident", "source", "decompiled", "seq")
    assert fused.where(F.col("source").isNull()).count() == P.missing_sources(*sides).count()


def test_missing_report(sides, rows):
    report = P.missing_report(*sides, sample=2)
    missing = {}
    s, d = expected("source"), expected("decompiled")
    for side, keys in (("source", d.keys() - s.keys()), ("decompiled", s.keys() - d.keys())):
        for artifact, ct, fid in keys:
            missing.setdefault((artifact, ct, side), []).append(fid)
    assert rows(report) == sorted(((*k, len(v), sorted(v)[:2]) for k, v in missing.items()), key=repr)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # the sample is cut before the shuffle


def test_new_ids_and_rollup(functions, rows):
    seen, new = set(), {}
    for artifact, ct, side, path, pos, fid, _ in sorted(FUNCTIONS, key=lambda f: (f[3], f[4])):
        key = (artifact, ct, side, path)
        new[key] = new.get(key, 0) + ((artifact, ct, side, fid) not in seen)
        seen.add((artifact, ct, side, fid))
    assert rows(P.new_ids_per_file(functions)) == sorted(((*k, v) for k, v in new.items()), key=repr)
    totals = {(r.artifact, r.code_type): r.n for r in P.examples_per_artifact(functions).collect()}
    assert totals[None, None] == len(FUNCTIONS)
    assert totals["art0", None] == sum(1 for f in FUNCTIONS if f[0] == "art0")


FILES = {
    "a/x.c": b"int f(void) { one(); }\nint only(void) { }",
    "a/x.o.c": b"junk\n// FUNCTION f\n\nint f(void)\n{ uno(); }\n// FUNCTION gone\n;\n// FUNCTION other\n{ }",
    "a/y.cpp": b"int &A::g() { two(); \xff}",
    "a/y.o.cpp": b"// FUNCTION g<int>\n{ dos(); }",
    "a/z.o.c": b"",
    "top.c": b"int f(void) { }",
    "b/x.o.c": b"// FUNCTION f\n{ elsewhere }",
}


@pytest.fixture
def files(spark):
    data = [("r", p.split("/")[0], p, p, p.split("/")[-1], len(b), b) for p, b in FILES.items() if "/" in p]
    return spark.createDataFrame(data, schemas.FILES)


def test_build_examples(files, rows):
    got = build_examples(files, "c,cpp")
    assert rows(got, "artifact", "code_type", "ident", "source", "decompiled") == [
        ("a", "c", "x::f", " one(); ", " uno(); "),
        ("a", "cpp", "x::f", " one(); ", " uno(); "),
        ("a", "cpp", "y::g", " two(); ", " dos(); "),
    ]


def test_files_are_read_and_shuffled_once(files):
    plan = build_examples(files, "cpp")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("ArrowEvalPython") == 1


def test_same_result_for_any_partitioning(spark, files, rows):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in (1, 4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(rows(build_examples(files.repartition(n), "c,cpp")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]


def test_read_functions_positions(files, rows):
    got = read_functions(files, "cpp").where("path = 'a/x.o.c'")
    assert rows(got, "pos", "name", "function_id") == [(0, "f", "x::f"), (2, "other", "x::other")]
