import posixpath

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.functions import text as T


def apply(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


# Text and its head, body and tail, written out by hand.
SPLITS = [
    ("", None),
    ("no braces", None),
    ("int f() {}", ("int f() {", "", "}")),
    ("int f() { a { b } c } tail", ("int f() {", " a { b } c ", "} tail")),
    ("int f() { open", ("int f() {", " open", "")),
    ("} before {", ("} before {", "", "")),
    ("a } { b", ("a } {", " b", "")),
    ("{", ("{", "", "")),
    ("{}", ("{", "", "}")),
    ("é { ü } ß", ("é {", " ü ", "} ß")),
    ("{{}}", ("{", "{}", "}")),
    ("x{\n}\n", ("x{", "\n", "}\n")),
    ("}{}", ("}{", "", "}")),
    ("{}}", ("{", "}", "}")),
]
SHAPES = [text for text, _ in SPLITS]


def test_split_function(spark):
    got = apply(spark, SHAPES, T.split_function)
    assert [None if g is None else tuple(g) for g in got] == [parts for _, parts in SPLITS]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text("{}ab\n", max_size=12), min_size=20, max_size=40))
def test_split_parts_make_up_the_text(spark, values):
    for text, parts in zip(values, apply(spark, values, T.split_function)):
        assert (parts is None) == ("{" not in text)
        if parts is not None:
            assert parts.head + parts.body + parts.tail == text
            assert parts.head.count("{") == 1 and parts.tail.count("}") == min(1, len(parts.tail))


def test_has_body(spark):
    assert apply(spark, SHAPES, T.has_body) == ["{" in s for s in SHAPES]


def test_is_blank_agrees_with_strip_on_every_character(spark):
    chars = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c <= 0xDFFF]
    values = chars + ["", " \t\r\n", " x ", "​", "\u001c\u001f  "]
    assert apply(spark, values, T.is_blank) == [v.strip() == "" for v in values]


def test_function_id(spark):
    df = spark.createDataFrame(
        [("a/b/f.o.c", "go<int>"), ("f", "go"), ("x/.hidden.c", "a<b<c>>"), ("a.b/c", "operator<")], "p string, n string"
    )
    got = [r[0] for r in df.select(T.function_id("p", "n")).collect()]
    assert got == ["f::go", "f::go", "::a", "c::operator"]


BYTES = [b"", b"plain", b"a\xffb", "é�ß".encode(), b"cut \xe2\x82", b"\xe2\x28\xa1", "�".encode() + b"\xff",
         b"\xf0\x9f\x98", b"\xed\xa0\x80x", "\u00011\u00012".encode() + b"\xfe", b"\xc0\xaf", b"\xf4\x90\x80\x80"]


def test_decode_lossy(spark):
    got = apply(spark, BYTES, T.decode_lossy, "binary")
    assert got == [b.decode("utf-8", errors="ignore") for b in BYTES]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=20, max_size=40))
def test_decode_lossy_property(spark, values):
    assert apply(spark, values, T.decode_lossy, "binary") == [v.decode("utf-8", errors="ignore") for v in values]


def test_paths(spark):
    df = spark.createDataFrame([("d/a.o.cpp", ".o.cpp", ".c")], "p string, s string, t string")
    assert df.select(T.output_path("p", "s", "t")).first()[0] == "d/a.c"
    assert df.select(T.decompiled_path(F.lit("x/y.o"))).first()[0] == "x/y.o.c"
    paths = ["a/b/../c", "/a/./b//c", "a/../../b", "/x/y/../../z", "a/b/c"]
    want = [posixpath.normpath(p) for p in paths]
    assert apply(spark, paths, T.normalize_path) == want
