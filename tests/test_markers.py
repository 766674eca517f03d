from pyspark.sql import functions as F

from pairloom.operators import markers
from pairloom.sources.tree import build_marked_files

# Text and its (name, text) pairs, written out by hand.
CUTS = [
    ("", []),
    ("no marker", []),
    ("pre\n// FUNCTION a\n{1}\n// FUNCTION b\n{2}", [("a", "\n{1}\n"), ("b", "\n{2}")]),
    ("// FUNCTION a\r\n{1}\r\n", [("a\r", "\n{1}\r\n")]),
    ("x\u0085// FUNCTION not at line start\n// FUNCTION yes\n{}", [("yes", "\n{}")]),
    ("// FUNCTION na me\n{}", [("na me", "\n{}")]),
    ("// FUNCTION u\u2028v\n{}", [("u\u2028v", "\n{}")]),
    ("// FUNCTION last", [("last", "")]),
    ("lone\r// FUNCTION no\n// FUNCTION \n// FUNCTION  two\n{}", [(" two", "\n{}")]),
    (" // FUNCTION indented\n", []),
]


def test_split_marked_functions(spark):
    df = spark.createDataFrame([(str(i), t) for i, (t, _) in enumerate(CUTS)], "path string, text string")
    got = {}
    for r in markers.split_marked_functions(df).orderBy("path", "pos").collect():
        got.setdefault(r.path, []).append((r.name, r.text))
    assert got == {str(i): pairs for i, (_, pairs) in enumerate(CUTS) if pairs}


def test_bodiless_chunk_is_rejected_alone(spark, rows):
    df = spark.createDataFrame([("p.o.c", "// FUNCTION a\nnothing\n// FUNCTION b<T>\nint b() { x }\n")],
                               "path string, text string")
    kept, rejects = markers.with_parts(markers.split_marked_functions(df))
    assert rows(kept, "name", "head", "body", "tail", "function_id") == [
        ("b<T>", "\nint b() {", " x ", "}\n", "p::b")
    ]
    assert rows(rejects) == [(None, "p.o.c", 0, "no_body", "a")]


def test_drop_truncated(spark, rows):
    df = spark.createDataFrame(
        [("p", 0, "a", "{ Truncating control flow here }"), ("p", 1, "b", "{}")],
        "path string, pos int, name string, text string",
    )
    kept, rejects = markers.drop_truncated(df)
    assert rows(kept, "name") == [("b",)]
    assert rows(rejects, "reason", "detail") == [("truncated", "a")]


def test_build_then_split_is_identity_and_parts_concatenate(spark, rows):
    data = [("f.o.c", i, f"n{i}", f"\nint n{i}() {{ {i} }}\n") for i in range(7)]
    functions = spark.createDataFrame(data, "path string, pos int, name string, text string").repartition(3)
    whole = build_marked_files(functions)
    text = whole.first().content
    parts = build_marked_files(functions, part_pieces=2)
    assert parts.count() == 4
    assert "".join(r.content for r in parts.orderBy("part").collect()) == text
    again = markers.split_marked_functions(whole.select("path", F.col("content").alias("text")))
    assert rows(again, "pos", "name", "text") == sorted(((p, n, "\n" + t) for _, p, n, t in data), key=repr)
