import tracemalloc

import pytest
from pyspark.sql import functions as F

from pairloom.operators import transform as X
from pairloom.operators.extract import _RESULT, built
from pairloom.sources.tree import write_tree, write_tree_files


def upper(texts):
    return texts.str.replace(" ", "_", regex=False)


def load_model():
    return upper


MARKED = "// FUNCTION f\nint f(void) { a b }\n// FUNCTION g\nint g(void) { c }\n"
FILES = {
    "x/a.o.c": MARKED.encode(),
    "x/a.c": b"old",
    "x/b.o.cpp": b"nothing here",
    "x/c.o": b"\x7fELF",
    "x/sub/d.o.c": b"int d() { \xff1 2 }",
    "readme.md": b"text \xff",
}


@pytest.fixture
def files(spark):
    return spark.createDataFrame(list(FILES.items()), "rel_path string, content binary")


def test_segments(spark, rows):
    functions = spark.createDataFrame([("p", 0, "f", "int f() { a }"), ("p", 1, "g", "S() = default;")],
                                      "rel_path string, pos int, name string, text string")
    assert rows(X.segment_files(functions)) == [
        ("p", 0, 1, "int f() {"), ("p", 1, 0, " a "), ("p", 2, 1, "}"), ("p", 3, 1, "S() = default;")]


@pytest.mark.parametrize("how", [{"fn": upper}, {"loader": load_model}])
def test_model_sees_regular_segments_only(spark, rows, how):
    segments = spark.createDataFrame([("p", i, i % 2, f"t {i}") for i in range(50)],
                                     "rel_path string, pos int, kind tinyint, text string")
    got = X.apply_model(segments, **how)
    assert rows(got) == sorted((("p", i, i % 2, f"t {i}" if i % 2 else f"t_{i}") for i in range(50)), key=repr)
    with pytest.raises(ValueError):
        X.apply_model(segments)


def test_reassemble_in_parts(spark):
    segments = spark.createDataFrame([("p", i, 0, f"s{i}") for i in range(10)],
                                     "rel_path string, pos int, kind tinyint, text string").repartition(4)
    whole = X.reassemble(segments).first()
    assert whole.content == "\n\n".join(f"s{i}" for i in range(10)) and whole.part == 0
    parts = X.reassemble(segments, part_pieces=3).orderBy("part").collect()
    assert len(parts) == 4 and "".join(p.content for p in parts) == whole.content
    from pairloom.sources.tree import join_parts
    assert join_parts(X.reassemble(segments, part_pieces=3)).collect() == [whole]
    late = X.reassemble(segments.where("pos >= 7"), part_pieces=3).orderBy("part").collect()
    assert "".join(p.content for p in late) == "s7\n\ns8\n\ns9"


def test_plan(files, rows):
    plan = rows(X.plan_tree(files, "c,cpp", count=2))
    assert plan == sorted([
        ("readme.md", "readme.md", "copy", None), ("x/a.c", "x/a.c", "copy", None),
        ("x/a.o.c", "x/a.c", "transform", "c"), ("x/b.o.cpp", "x/b.c", "transform", "cpp"),
        ("x/c.o", "x/c.c", "unsupported", "c"), ("x/sub/d.o.c", "x/sub/d.c", "copy_over_count", "c"),
    ], key=repr)
    raw = {r.rel_path: r.action for r in X.plan_tree(files, "cpp", bytecode=True).collect()}
    assert raw["x/c.o"] == "transform"


def contents(df):
    return {r.rel_path: bytes(r.content) for r in df.collect()}


def test_transform_tree(files):
    got = contents(X.transform_tree(files, upper, "c,cpp"))
    assert got == {
        "readme.md": b"text \xff",
        # The later input of the two that share this name.
        "x/a.c": b"int f(void) {\n\n_a_b_\n\n}\n\nint g(void) {\n\n_c_\n\n}",
        "x/b.c": b"",
        "x/sub/d.c": b"int d() {\n\n_1_2_\n\n}",
    }
    over = contents(X.transform_tree(files, upper, "c,cpp", count=0))
    assert over["x/a.c"] == FILES["x/a.o.c"] and over["x/sub/d.c"] == FILES["x/sub/d.o.c"]


def test_transform_raw(files):
    got = contents(X.transform_raw(files, upper, code_types="c"))
    assert got["x/sub/d.c"] == b"int_d()_{_1_2_}" and got["readme.md"] == b"text \xff"
    assert got["x/b.o.cpp"] == b"nothing here"
    assert got["x/a.c"] == MARKED.replace(" ", "_").encode()


def test_write_tree(spark, files, tmp_path, rows):
    tree = X.transform_tree(files, upper, "c,cpp")
    stored = str(tmp_path / "parquet")
    write_tree(tree, stored)
    assert rows(spark.read.parquet(stored)) == rows(tree)
    with pytest.raises(Exception, match="already exists"):
        write_tree(tree, stored)
    target = tmp_path / "files"
    parts = tree.unionByName(spark.createDataFrame([("readme.md", 1, b" more")], tree.schema))
    write_tree_files(parts, str(target))
    assert (target / "readme.md").read_bytes() == b"text \xff more"
    assert (target / "x/sub/d.c").read_bytes() == b"int d() {\n\n_1_2_\n\n}"
    assert {str(p.relative_to(target)) for p in target.rglob("*") if p.is_file()} == {
        "readme.md", "x/a.c", "x/b.c", "x/sub/d.c"}
    with pytest.raises(ValueError, match="is there already"):
        write_tree_files(tree, str(target))
    write_tree_files(tree, str(target), force=True)
    assert (target / "readme.md").read_bytes() == b"text \xff"
    bad = spark.createDataFrame([("../out", 0, b"x")], tree.schema)
    with pytest.raises(Exception, match="leads out"):
        write_tree_files(bad.withColumn("content", F.col("content")), str(tmp_path / "bad"))


WHOLE = ["int f(void) { a; }\n", "// only a comment\n", "", "\n\nint f(void)\n{\n}\n  \n/* between { } */\nint g(int x) { if (x) { y; } }\ntail",
         "int f(void) { a; } int f(void) { a; }", "struct s { int x; };\nint h(void) {\r\n b;\r\n}\r\n", "int broken(void) { {"]


def test_segments_with_gaps_are_the_file(spark):
    files = spark.createDataFrame([(f"f{i}", "cpp", t) for i, t in enumerate(WHOLE)], "rel_path string, code_type string, text string")
    got = {}
    for r in X.segment_whole_files(files).orderBy("rel_path", "pos").collect():
        got.setdefault(r.rel_path, []).append((r.kind, r.text))
    for i, text in enumerate(WHOLE):
        assert "".join(t for _, t in got.get(f"f{i}", [])) == text
    assert [t for k, t in got["f4"] if k == 0] == [" a; ", " a; "]
    assert [t for k, t in got["f3"] if k == 0] == ["\n", " if (x) { y; } "]


def test_a_model_sees_a_stored_text_once_and_goes_on_after_a_stop(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    texts = ["a", "b", "a", "c", None, "d"]
    segments = spark.createDataFrame([("f", i, 0, t) for i, t in enumerate(texts)] + [("f", 9, 1, "a")],
                                     "rel_path string, pos int, kind int, text string")

    def counting(batch):
        calls.add(len(batch))
        return batch.str.upper()

    def failing(batch):
        raise RuntimeError("stopped")

    def run(part, fn, model="m/1", slices=1):
        return [(r.pos, r.text) for r in X.apply_model_once(part, str(tmp_path), model, fn, slices=slices).orderBy("pos").collect()]

    assert run(segments.where("pos < 3"), counting, slices=3) == [(0, "A"), (1, "B"), (2, "A")]
    assert calls.value == 2
    with pytest.raises(Exception, match="stopped"):
        run(segments, failing)
    want = [(0, "A"), (1, "B"), (2, "A"), (3, "C"), (4, None), (5, "D"), (9, "a")]
    assert run(segments, counting) == want and calls.value == 4
    assert run(segments, failing) == want  # nothing is new
    assert run(segments, counting, "m/2") == want and calls.value == 8


def test_own_rules_for_marked_files(spark):
    from pairloom.code_types import CodeType
    from pairloom.plans.build import build

    own = CodeType("own", "Own", (".src",), (), (".out",), extract=lambda t: ([(x[0], x) for x in t.split("\n")], None),
                   split=lambda t: ([(x[0], x) for x in t.split(";") if x], None), parts=lambda t: ("", t[1:], "") if t[1:] else None)
    rows = [("r", "a", "a/x.src", "a/x.src", "x.src", 9, b"f one\ng two\nh"), ("r", "a", "a/x.out", "a/x.out", "x.out", 9, b"f 1;h 3;k 4")]
    files = spark.createDataFrame(rows, "repo string, artifact string, path string, rel_path string, file_name string, length long, content binary")
    built = build(files, [own])
    assert [(r.ident, r.source, r.decompiled) for r in built.examples.collect()] == [("x::f", " one", " 1")]
    assert [(r.reason, r.detail) for r in built.rejects.collect()] == [("no_body", "h")]


def test_a_long_answer_does_not_widen_the_others():
    """An answer takes its own room, not that of the longest in its batch."""
    import tracemalloc

    import pandas as pd
    batch = pd.Series([None, *["short"] * 100, "x" * 500_000])
    tracemalloc.start()
    got = X._answers(batch, lambda texts: texts + "!")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == [None, *["short!"] * 100, "x" * 500_000 + "!"] and peak < 20_000_000


def test_parser_is_called_once(spark, files):
    """The rows of a file's functions come from one call; no filter before the explode repeats it."""
    from pairloom.operators.extract import extract_functions
    text = files.selectExpr("rel_path", "'c' code_type", "string(content) text")
    plan = extract_functions(text)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_results_become_arrow_piece_by_piece():
    one = {"functions": [{"name": "f", "text": "x" * 90 + str(k)} for k in range(3)], "problem": None}
    assert built(iter([(None, 0), (one, 10**9), (one, 5), (None, 0)]), _RESULT).to_pylist() == [None, one, one, None]
    assert len(built(iter([]), _RESULT)) == 0
    values = (({"functions": [{"name": "f", "text": "x" * 90 + str(k)} for k in range(40)], "problem": None}, 4_000)
              for _ in range(2_000))
    tracemalloc.start()
    try:
        assert len(built(values, _RESULT)) == 2_000
        assert tracemalloc.get_traced_memory()[1] < 4_000_000
    finally:
        tracemalloc.stop()
