import pytest
from pyspark.sql import functions as F

from pairloom.operators import includes as I

TEXT = '''/* #include <commented.h> */
#include <stdio.h>
  #  include "a/b.h"
// #include "no.h"
char *s = "/*"; /* still
#include "inside.h" */
#include "c.h" // why
int x = 'c';
#include MACRO
'''


def test_extract(spark, rows):
    df = spark.createDataFrame([("p.c", TEXT)], "path string, text string")
    assert rows(I.extract_includes(df)) == [
        ("p.c", 0, "stdio.h", True), ("p.c", 1, "a/b.h", False), ("p.c", 2, "c.h", False)
    ]


def test_extract_survives_long_literals(spark):
    text = '#include "x.h"\nchar *s = "' + "ab\\n" * 50_000 + '";\n/*' + "x*" * 50_000 + "*/\n#include <y.h>\n"
    df = spark.createDataFrame([("p.c", text)], "path string, text string")
    assert I.extract_includes(df).count() == 2


FILES = ["/r/a/src/f.c", "/r/a/src/near.h", "/r/a/near.h", "/r/a/up.h", "/usr/include/stdio.h", "/lib2/stdio.h",
         "/r/a/other/deep/cousin.h", "/r/a/src/sub/cousin.h", "/root.h", "/r/a/src/stdio.h"]
INCLUDES = [
    ("near.h", False, "/r/a/src/near.h"),        # nearest ancestor first
    ("up.h", False, "/r/a/up.h"),                # further up
    ("../up.h", False, "/r/a/up.h"),             # leads upwards
    ("stdio.h", True, "/usr/include/stdio.h"),   # system includes skip local files
    ("stdio.h", False, "/r/a/src/stdio.h"),
    ("root.h", False, None),                     # the file system root is not searched
    ("/r/a/up.h", False, "/r/a/up.h"),           # absolute
    ("missing.h", True, None),
]


def resolve(spark, wanted, **options):
    data = [("/r/a/src/f.c", i, t, s) for i, (t, s, _) in enumerate(wanted)]
    includes = spark.createDataFrame(data, "path string, pos int, target string, is_system boolean")
    files = spark.createDataFrame([(f,) for f in FILES], "path string")
    got = I.resolve_includes(includes, files, ["/none", "/usr/include", "/lib2"], **options)
    return [r.resolved_path for r in got.orderBy("pos").collect()]


def test_resolution_order(spark):
    assert resolve(spark, INCLUDES) == [w for _, _, w in INCLUDES]


def test_children_of_ancestors(spark):
    wanted = [("cousin.h", False, "/r/a/src/sub/cousin.h"), ("deep/cousin.h", False, "/r/a/other/deep/cousin.h"),
              ("cousin.h", True, None)]
    assert resolve(spark, wanted) == [None, None, None]
    assert resolve(spark, wanted, child_depth=1) == [w for _, _, w in wanted]


def brute_closure(edges, roots):
    out = set()
    for root in roots:
        todo, seen = [root], {root}
        while todo:
            for a, b in edges:
                if a == todo[0] and b not in seen:
                    seen.add(b)
                    todo.append(b)
            todo.pop(0)
        out |= {(root, node) for node in seen}
    return out


EDGES = [(f"n{i}", f"n{(i * 7 + 3) % 60}") for i in range(60)] + [(f"n{i}", "hub") for i in range(0, 60, 2)] + [
    ("hub", "n1"), ("hub", "end"), ("self", "self")]


def test_closure_by_hops(spark):
    includes = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(20)], "path string, resolved_path string")
    root = spark.createDataFrame([("n0",)], "path string")
    for hops in (0, 1, 3, 50):
        assert I.include_closure(includes, root, max_hops=hops).count() == min(hops, 20) + 1
    assert I.include_closure(includes, root).count() == 21


def test_children_meet_requests_once(spark):
    files = spark.createDataFrame([(f"r/d{i:03d}/config.h",) for i in range(200)], "path string")
    includes = spark.createDataFrame([(f"r/s{i:03d}.c", 0, "config.h", False) for i in range(200)],
                                     "path string, pos int, target string, is_system boolean")
    got = I.resolve_includes(includes, files, child_depth=1)
    assert {r.resolved_path for r in got.collect()} == {"r/d000/config.h"} and got.count() == 200


def test_closure_with_cycles(spark):
    includes = spark.createDataFrame([*EDGES, ("n5", None)], "path string, resolved_path string")
    roots = [f"n{i}" for i in range(60)] + ["self", "alone"]
    df = spark.createDataFrame([(r,) for r in roots], "path string")
    closure = I.include_closure(includes, df)
    assert {tuple(r) for r in closure.collect()} == brute_closure(EDGES, roots)
    assert closure.count() == len(brute_closure(EDGES, roots))


def test_functions_with_imports(spark, rows):
    functions = spark.createDataFrame(
        [("a.c", 0, "f", "1"), ("h.h", 0, "g", "2"), ("h.h", 1, "f", "3")], "path string, pos int, name string, text string"
    )
    closure = spark.createDataFrame([("a.c", "a.c"), ("a.c", "h.h"), ("b.c", "h.h")], "root string, path string")
    got = I.functions_with_imports(functions, closure)
    assert rows(got, "path", "def_path", "name", "imported") == [
        ("a.c", "a.c", "f", False), ("a.c", "h.h", "f", True), ("a.c", "h.h", "g", True),
        ("b.c", "h.h", "f", True), ("b.c", "h.h", "g", True),
    ]
    wanted = spark.createDataFrame([("a.c", "g"), ("b.c", "f"), ("b.c", "none")], "path string, name string")
    assert rows(I.functions_with_imports(functions, closure, wanted), "path", "def_path", "name", "imported") == [
        ("a.c", "h.h", "g", True), ("b.c", "h.h", "f", True)]
    from pairloom.functions.text import function_id
    from pairloom.operators.pairing import dedupe_source

    keyed = got.select("*", F.lit("x").alias("artifact"), F.lit("c").alias("code_type"),
                       function_id("path", "name").alias("function_id"), F.col("text").alias("body"))
    # An included definition comes after the file's own, so it is the last one.
    assert rows(dedupe_source(keyed), "function_id", "body") == [("a::f", "3"), ("a::g", "2"), ("b::f", "3"), ("b::g", "2")]


def test_wanted_names_by_kind_of_root(spark, rows):
    """Roots of one kind want the same names; these are met where they are defined, not spread over all roots first."""
    functions = spark.createDataFrame(
        [("h.h", 0, "f", "1"), ("h.h", 1, "g", "2"), ("h.h", 1, "g", "2"), ("i.h", 0, "f", "3")],
        "path string, pos int, name string, text string")
    closure = spark.createDataFrame(
        [("a.c", "h.h", "x"), ("b.c", "h.h", "x"), ("b.c", "i.h", "x"), ("c.c", "h.h", "y"), ("d.c", "h.h", None)],
        "root string, path string, kind string")
    wanted = spark.createDataFrame([("x", "f"), ("y", "g"), ("y", "none"), (None, "f")], "kind string, name string")
    got = I.functions_with_imports(functions, closure, wanted)
    assert rows(got, "path", "def_path", "name", "text", "imported") == [
        ("a.c", "h.h", "f", "1", True), ("b.c", "h.h", "f", "1", True), ("b.c", "i.h", "f", "3", True),
        ("c.c", "h.h", "g", "2", True), ("c.c", "h.h", "g", "2", True)]


def test_names_of_a_kind_are_not_multiplied_by_its_roots(spark):
    """300 roots that share 300 wanted names and reach one function each make rows by the hundred, not 90,000."""
    functions = spark.range(300).selectExpr("concat('h', id) path", "cast(0 as int) pos", "concat('n', id) name", "'t' text")
    closure = spark.range(300).selectExpr("concat('r', id) root", "concat('h', id) path", "'x' kind")
    wanted = spark.range(300).selectExpr("'x' kind", "concat('n', id) name")
    got = I.functions_with_imports(functions, closure, wanted)
    assert got.count() == 300
    joins = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in joins
