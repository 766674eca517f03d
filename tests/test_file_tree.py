"""The tree source with pushed filters, and the tree sink with its commit."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from pairloom.sources import file_tree as T
from pairloom.sources import files as S

FILES = {"top.c": 3, "a/x.c": 0, "a/y.o.c": 5, "a/.h": 1, "a/noext": 2, "b/1/2/3/deep.cc": 9, "b/1/k.c": 4, "b c#1/%.c": 7}


@pytest.fixture
def root(tmp_path):
    for rel, size in FILES.items():
        target = tmp_path / "t" / rel
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"x" * size)
    os.symlink(tmp_path / "t", tmp_path / "t" / "a" / "loop")
    return str(tmp_path / "t")


def found(df):
    return sorted(r.rel_path for r in df.collect())


def test_rows(spark, root):
    got = {r.rel_path: r for r in T.read_tree(spark, root, "r").collect()}
    assert {k: r.length for k, r in got.items()} == FILES
    assert got["top.c"].artifact is None and got["a/y.o.c"].artifact == "a"
    assert {k: (r.ending, r.depth) for k, r in got.items()} == {
        k: ("." + k.split("/")[-1].rpartition(".")[2] if "." in k.split("/")[-1] else "", k.count("/") + 1) for k in FILES}
    with pytest.raises(ValueError, match="no folder"):
        T.read_tree(spark, root + "/none")


@pytest.mark.parametrize("condition", [
    "depth <= 2", "depth < 2", "depth = 2", "depth > 2", "2 >= depth", "length > 0", "length >= 4 and length < 9", "ending in ('.cc', '.c')",
    "ending = ''", "artifact = 'b'", "artifact in ('a', 'b c#1')", "not (artifact = 'a')", "artifact is null", "artifact is not null",
    "endswith(file_name, '.o.c')", "startswith(file_name, '.')", "contains(file_name, '%')", "depth <= 2 or length = 9", "artifact <=> null",
    "artifact = null", "depth + 0 <= 2", "artifact = 'b' and depth <= 3 and ending = '.c'", "not (depth <= 2)", "problem is null",
])
def test_filters_give_the_same_rows(spark, root, condition):
    tree = T.read_tree(spark, root)
    want = spark.createDataFrame(tree.collect(), tree.schema).where(condition)
    assert found(tree.where(condition)) == found(want)


def test_filters_are_pushed(spark, root):
    tree = T.read_tree(spark, root).where("depth <= 2 and ending = '.c' and length > 0")
    plan = tree._jdf.queryExecution().executedPlan().toString()
    assert "(length" not in plan.split("BatchScan")[0].replace("isnotnull", "")  # nothing is left to filter
    reader = T.TreeReader({"path": f"file:{root}"})
    left = list(reader.pushFilters([T.LessThanOrEqual(("depth",), 1), T.EqualTo(("artifact",), "b"), T.EqualTo(("x", "y"), 1)]))
    assert len(left) == 1 and len(reader.conditions) == 2
    assert [u[0] for p in reader.partitions() for u in p.units] == [""]  # no folder below the root is looked at


def listed(reader):
    return sorted(r["rel_path"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist() if not r["problem"])


def test_a_big_folder_is_listed_in_parts(root, monkeypatch):
    monkeypatch.setattr(T, "PART_ENTRIES", 2)
    monkeypatch.setattr(T, "BATCH_ROWS", 1)
    reader = T.TreeReader({"path": f"file:{root}", "tasks": "50"})
    assert sum(u[0] == "a" for p in reader.partitions() for u in p.units) == 2
    assert listed(reader) == sorted(FILES)


def test_vanished_and_denied_folders_are_rejects(root, monkeypatch):
    reader = T.TreeReader({"path": f"file:{root}"})
    parts = reader.partitions()
    shutil.rmtree(f"{root}/b c#1")
    real = T.entries_of

    def denied(filesystem, plain, sizes=True):
        if plain.endswith("/b/1"):
            raise PermissionError(13, "Permission denied")
        return real(filesystem, plain, sizes)

    monkeypatch.setattr(T, "entries_of", denied)
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert {(r["rel_path"], r["artifact"]) for r in rows if r["problem"]} == {("b/1", "b"), ("b c#1", "b c#1")}
    assert sorted(r["rel_path"] for r in rows if not r["problem"]) == sorted(
        k for k in FILES if not k.startswith(("b c#1/", "b/1/")))


def test_listing_by_levels_goes_on_after_a_denied_folder(spark, root, monkeypatch, rows):
    import pyarrow as pa
    real = S.entries_of
    monkeypatch.setattr(S, "entries_of", lambda f, p: (_ for _ in ()).throw(PermissionError(13, "Permission denied"))
                        if p.endswith("/a") else real(f, p))
    batch = pa.RecordBatch.from_arrays([pa.array([f"file:{root}/a", f"file:{root}/none", f"file:{root}/b"])], names=["path"])
    got = [r for b in S._entries([batch]) for r in b.to_pylist()]
    assert [(r["path"].rsplit("/")[-1], r["problem"] and r["problem"].split(":")[0]) for r in got] == [
        ("a", "PermissionError"), ("none", "FileNotFoundError"), ("1", None)]
    files, rejects = S.list_tree(spark, root, "r")
    assert files.count() == len(FILES) - 1 and rejects.count() == 0


def tree_of(spark, rows):
    return spark.createDataFrame(rows, "rel_path string, part int, content binary")


def names(path):
    return sorted(os.path.relpath(os.path.join(d, n), path) for d, _, found in os.walk(path) for n in found)


def test_a_written_tree_is_whole_or_absent(spark, tmp_path):
    target = str(tmp_path / "out")
    T.write_tree_files(tree_of(spark, [("a/1.c", 1, b"two"), ("a/1.c", 0, b"one "), ("b", 0, None)]), target)
    assert names(target) == ["a/1.c", "b"] and open(f"{target}/a/1.c").read() == "one two"
    bad = tree_of(spark, [(f"a/{i}.c", 0, b"x") for i in range(40)] + [("../out2", 0, b"x")])
    with pytest.raises(Exception, match="leads out"):
        T.write_tree_files(bad, str(tmp_path / "none"))
    with pytest.raises(Exception, match="leads out"):
        T.write_tree_files(bad, target, force=True)
    assert names(target) == ["a/1.c", "b"]
    assert sorted(os.listdir(tmp_path)) == ["out"]  # nothing is left beside it
    with pytest.raises(ValueError, match="there already"):
        T.write_tree_files(tree_of(spark, [("c", 0, b"x")]), target)
    T.write_tree_files(tree_of(spark, [("c", 0, b"x")]), target, force=True)
    assert names(target) == ["c"] and sorted(os.listdir(tmp_path)) == ["out"]
    T.write_tree_files(tree_of(spark, []), str(tmp_path / "empty"))
    assert names(tmp_path / "empty") == []


def test_an_attempt_that_was_killed_leaves_no_target(tmp_path):
    from pyspark.sql import Row

    writer = T.TreeWriter({"path": f"file:{tmp_path}/out"}, False)

    def rows():
        yield Row(rel_path="a/1", part=0, content=b"x")
        yield Row(rel_path="a/2", part=0, content=b"x")
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writer.write(rows())
    assert not (tmp_path / "out").exists()
    # The repeated attempt writes the same files; the commit shows them at once.
    message = writer.write(iter([Row(rel_path="a/1", part=0, content=b"x"), Row(rel_path="a/2", part=0, content=b"y")]))
    assert message.files == 2 and not (tmp_path / "out").exists()
    writer.commit([message])
    assert open(tmp_path / "out" / "a" / "2").read() == "y"


def test_batches_are_written_as_rows_are(tmp_path):
    import pyarrow as pa

    def batch(*rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
            names=["rel_path", "part", "content"])

    writer = T.FileTree({"path": f"file:{tmp_path}/out"}).writer(None, False)
    # A file that goes on in the next batch, a null content, and a second file of a folder.
    message = writer.write(iter([batch(("a/b/1", 0, b"one ")), batch(("a/b/1", 1, b"two"), ("a/b/2", 0, None)), batch(("top", 0, b"x"))]))
    assert message.files == 3
    writer.commit([message])
    assert names(tmp_path / "out") == ["a/b/1", "a/b/2", "top"]
    assert [open(tmp_path / "out" / n).read() for n in names(tmp_path / "out")] == ["one two", "", "x"]


@pytest.fixture
def wide(tmp_path):
    for i in range(60):
        folder = tmp_path / "w" / "a" / f"d{i:02d}"
        folder.mkdir(parents=True)
        (folder / "x.c").write_bytes(b"x" * i)
        (tmp_path / "w" / "a" / f"f{i:02d}.h").write_bytes(b"y" * i)
    return str(tmp_path / "w")


def test_the_driver_does_not_name_every_folder(wide, monkeypatch):
    monkeypatch.setattr(T, "PLANNED_FOLDERS", 10, raising=False)
    monkeypatch.setattr(T, "PART_ENTRIES", 10)
    reader = T.TreeReader({"path": f"file:{wide}", "tasks": "8"})
    units = [u for p in reader.partitions() for u in p.units]
    assert len(units) <= 10 and sum(u[0] == "a" for u in units) == 8
    assert listed(reader) == sorted([f"a/d{i:02d}/x.c" for i in range(60)] + [f"a/f{i:02d}.h" for i in range(60)])


def test_a_folder_in_parts_asks_each_file_once_for_its_size(wide, monkeypatch):
    monkeypatch.setattr(T, "PART_ENTRIES", 10)
    asked, real = [], T.entries_of

    def seen(filesystem, plain, sizes=True):
        for entry in real(filesystem, plain, sizes):
            asked.extend([entry.name] * (entry.length is not None))
            yield entry

    monkeypatch.setattr(T, "entries_of", seen)
    monkeypatch.setattr(T, "size_of", lambda f, p, real=getattr(T, "size_of", None): (asked.append(p.split("/")[-1]), real(f, p))[1],
                        raising=False)
    reader = T.TreeReader({"path": f"file:{wide}", "tasks": "8"})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == 120 and sum(r["length"] for r in rows) == 2 * sum(range(60))
    assert len(asked) == 120
