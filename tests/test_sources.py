import pytest
from pyspark.sql import functions as F

from pairloom import schemas
from pairloom.code_types import code_type_table, resolve
from pairloom.sources import files as S

TREE = {"a/x.c": b"int f() {}", "a/deep/er/y.o.c": b"", "b/z.o.c++": b"// FUNCTION q\n{}", "b/z.o": b"\x7f", "top.c": b"x",
        "b/notes.txt": b"hi", "b/_start.c": b"int s() {}", "b/.hidden/k.c": b"int k() {}"}


@pytest.fixture
def root(tmp_path):
    for rel, content in TREE.items():
        target = tmp_path / "repo" / rel
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)
    return str(tmp_path / "repo")


def by_repr(values):
    return sorted(values, key=repr)


def test_scan(spark, root, rows):
    files = S.scan_files(spark, root, "r")
    assert files.columns == schemas.FILES.names
    assert rows(files, "repo", "artifact", "rel_path", "file_name", "length", "content") == by_repr(
        ("r", rel.split("/")[0], rel, rel.split("/")[-1], len(c), c) for rel, c in TREE.items() if "/" in rel)
    assert rows(S.scan_files_depth(files, 2), "rel_path") == by_repr((r,) for r in TREE if r.count("/") == 1)
    with pytest.raises(ValueError, match="no folder"):
        S.scan_files(spark, root + "/none")


NAMES = ["a b.c", "a#b.c", "100%.c", "x%20y.c", "[k].c", "what?.c", "ümläut.c", "a+b&c.c", "q'\"q.c", "a"]


def test_names_of_any_characters(spark, tmp_path, rows):
    base = tmp_path / "re po#1%"
    for i, name in enumerate(NAMES):
        (base / "d [1]" / f"s{i}").mkdir(parents=True)
        (base / "d [1]" / name).write_bytes(f"content {i}".encode())
    files = S.scan_files(spark, str(base))
    assert rows(files, "rel_path", "content") == by_repr(
        (f"d [1]/{name}", f"content {i}".encode()) for i, name in enumerate(NAMES))


def test_links_and_unreadable_files(spark, root, rows):
    import os
    os.symlink(root, f"{root}/a/loop")
    os.symlink(f"{root}/a/x.c", f"{root}/a/link.c")
    os.symlink("nowhere", f"{root}/a/broken.c")
    listed = S.list_files(spark, root)
    assert rows(listed.where("artifact = 'a'"), "rel_path") == by_repr([("a/x.c",), ("a/deep/er/y.o.c",), ("a/link.c",)])
    os.remove(f"{root}/b/z.o")
    again = S.with_content(listed)
    assert rows(S.unreadable(again), "path", "reason") == [(f"file:{root}/b/z.o", "unreadable")]
    assert again.where("content is not null").count() == listed.count() - 1


def test_large_directories_come_in_batches(spark, root, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(S, "LISTING_BATCH", 2)
    sizes = [b.num_rows for b in S._entries([pa.RecordBatch.from_arrays([pa.array([f"file:{root}/b"])], names=["path"])])]
    assert sum(sizes) == 5 and max(sizes) == 2


def test_content_in_small_batches(spark, root, rows, monkeypatch):
    monkeypatch.setattr(S, "CONTENT_BATCH_BYTES", 1)
    got = S.with_content(S.list_files(spark, root).coalesce(1))
    assert rows(got, "rel_path", "content") == by_repr((r, c) for r, c in TREE.items() if "/" in r)


def test_binary_source_leaves_out_empty_and_hidden(spark, root, rows):
    files = S.scan_binary_files(spark, root, "r")
    assert rows(files, "rel_path") == by_repr([("a/x.c",), ("b/z.o.c++",), ("b/z.o",), ("b/notes.txt",)])
    plan = S.skip_empty_files(files).select("rel_path", "content")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(length,0)" in plan
    paths = files.select("rel_path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in paths.split("ReadSchema")[1]


def test_build_from_listing(spark, root, rows):
    from pairloom.plans.build import read_functions

    listed, scanned = S.list_files(spark, root), S.scan_files(spark, root)
    assert rows(read_functions(listed, "c,cpp")) == rows(read_functions(scanned, "c,cpp"))
    assert rows(read_functions(listed, "c"), "name") == [("f",), ("k",), ("s",)]


def test_lost_files_are_rejects_of_the_build(spark, root, rows):
    import os

    from pairloom.plans.build import build
    listed = S.list_files(spark, root, "r")
    os.remove(f"{root}/a/x.c")
    built = build(listed, "c")
    assert rows(built.rejects, "repo", "artifact", "path", "reason") == [("r", "a", f"file:{root}/a/x.c", "unreadable")]
    assert built.examples.count() == 0


def test_classify(spark, root, rows):
    got = S.classify_files(S.scan_binary_files(spark, root).unionByName(
        S.scan_files(spark, root).where("length = 0")), "c,cpp")
    assert rows(got, "rel_path", "code_type", "side", "suffix") == sorted([
        ("a/x.c", "c", "source", ".c"), ("a/x.c", "cpp", "source", ".c"),
        ("a/deep/er/y.o.c", "c", "decompiled", ".o.c"), ("a/deep/er/y.o.c", "cpp", "decompiled", ".o.c"),
        ("b/z.o.c++", "cpp", "decompiled", ".o.c++"),
    ], key=repr)


def test_registry(spark):
    assert [c.name for c in resolve(None)] == ["cpp"]
    table = code_type_table(spark)
    assert table.where("side = 'source'").count() == 6
    assert table.where(F.col("code_type") == "cpp").count() == 11
    with pytest.raises(ValueError):
        resolve("go")


def test_union_repos(spark, rows):
    one = spark.createDataFrame([("p",)], "package string")
    assert rows(S.union_repos({"a": one, "b": one}), "repo", "package") == [("a", "p"), ("b", "p")]
    with pytest.raises(ValueError):
        S.union_repos({})
