"""Ledger snapshots, marker streams, and the example set that follows a ledger."""

import datetime as dt
import os

import pytest

from pairloom import schemas
from pairloom.plans import fixtures
from pairloom.sources import ledger as L
from pairloom.sources import status_markers as M
from pairloom.streaming import maintain
from pairloom.streaming.watch import watch_entries

T0 = dt.datetime(2024, 1, 1)
FILES = "repo string, artifact string, path string, rel_path string, file_name string, length long, content binary"


def files_of(spark, bodies):
    """A source and a marked file per artifact, with one function each."""
    rows = []
    for artifact, body in bodies.items():
        for name, text in (("x.c", f"int f(void) {{ {body} }}"), ("x.o.c", "// FUNCTION f\nint f(void)\n\n{ d(); }\n")):
            data = text.encode()
            rows.append(("r", artifact, f"{artifact}/{name}", f"{artifact}/{name}", name, len(data), data))
    return spark.createDataFrame(rows, FILES)


def stored(path):
    return {os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_only_changed_artifacts_are_written(spark, tmp_path, rows):
    path = str(tmp_path / "examples")
    changed = "repo string, artifact string"
    maintain.refresh_artifacts(files_of(spark, {"a": "one();", "b": "two();", "c": "three();"}),
                               spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "none")], changed), path)
    assert rows(maintain.read_maintained(spark, path), "artifact", "source") == [("a", " one(); "), ("b", " two(); ")]
    before = stored(path)
    process = maintain.example_keeper(lambda _: files_of(spark, {"a": "new();", "b": "not seen();"}), path)
    process(spark.createDataFrame([("r", "a", T0)], "repo string, package string, ts timestamp"), 0)
    assert rows(maintain.read_maintained(spark, path), "artifact", "source") == [("a", " new(); "), ("b", " two(); ")]
    after = stored(path)
    assert {p for p in before if "artifact=b" in p} <= after
    assert not {p for p in before if "artifact=a" in p} & after
    # An artifact that lost its files has no examples any more; nothing to do changes nothing.
    process(spark.createDataFrame([("r", "b", T0)], "repo string, package string, ts timestamp"), 1)
    process(spark.createDataFrame([], "repo string, package string, ts timestamp"), 2)
    assert rows(maintain.read_maintained(spark, path), "artifact", "ident") in (
        [("a", "x::f"), ("b", "x::f")], [("a", "x::f")])


def test_an_artifact_without_files_is_emptied(spark, tmp_path):
    path, one = str(tmp_path / "examples"), spark.createDataFrame([("r", "a")], "repo string, artifact string")
    maintain.refresh_artifacts(files_of(spark, {"a": "one();"}), one, path)
    maintain.refresh_artifacts(files_of(spark, {"b": "one();"}), one, path)
    assert maintain.read_maintained(spark, path).count() == 0


def entries(spark, *rows):
    return spark.createDataFrame([("r", p, s, T0 + dt.timedelta(hours=h)) for p, s, h in rows], schemas.LEDGER)


def newest(spark, root):
    return sorted((r.package, r.status) for r in L.newest_entries(spark, root).collect())


def test_snapshots_equal_the_whole_log(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "ledger")
    assert newest(spark, root) == [] and L.compact(spark, root) == 0
    L.append_entries(entries(spark, ("a", "failed", 1), ("b", "success", 5), ("c", None, 9)), root)
    assert newest(spark, root) == [("a", "failed"), ("b", "success")]
    assert L.compact(spark, root) == 1 and L.compact(spark, root) == 1
    L.append_entries(entries(spark, ("a", "success", 3), ("b", "failed", 2)), root)
    want = [("a", "success"), ("b", "success")]
    assert newest(spark, root) == want
    # Entries that arrive while the snapshot is written are in files that it does not name.
    real = L._newest

    def slow(*args):
        L.append_entries(entries(spark, ("d", "success", 7)), root)
        return real(*args)

    monkeypatch.setattr(L, "_newest", slow)
    assert L.compact(spark, root) == 2
    monkeypatch.setattr(L, "_newest", real)
    assert newest(spark, root) == [*want, ("d", "success")]
    # A compaction that was stopped does not count, and its number is not used again.
    os.makedirs(f"{root}/snapshots/3/newest")
    assert newest(spark, root) == [*want, ("d", "success")] and L.versions(spark, root) == [1, 2]
    assert L.compact(spark, root) == 4
    logged = len(L._log_files(spark, root))
    L.vacuum(spark, root)
    assert L.versions(spark, root) == [2, 4] and len(L._log_files(spark, root)) < logged
    assert newest(spark, root) == [*want, ("d", "success")]


def drain(spark, root, state):
    seen = []
    stream = M.marker_stream(spark, root, "r", lag=0)
    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(
        lambda b, _: seen.extend((r.repo, r.package, r.status) for r in b.collect())).start().awaitTermination()
    return sorted(seen)


def test_markers_are_read_once_over_restarts(spark, tmp_path):
    root, state = str(tmp_path / "stats"), str(tmp_path / "state")
    M.write_markers(entries(spark, ("a.b", "success", 0), ("c", "failed", 0), ("c", "failed", 1), ("e", None, 0)), root)
    open(f"{root}/notes.txt", "w").close()
    assert drain(spark, root, state) == [("r", "a.b", "success"), ("r", "c", "failed")]
    M.write_markers(entries(spark, ("d e#1", "success", 0)), root)
    assert drain(spark, root, state) == [("r", "d e#1", "success")]
    assert drain(spark, root, state) == []
    os.utime(f"{root}/c.failed")
    assert drain(spark, root, state) == [("r", "c", "failed")]


def test_markers_in_folders_of_packages_and_young_ones(tmp_path):
    for name in ("p/run.success", "q/deep/run.fail", "q/other.success", "run.txt"):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).touch()
    root = f"file:{tmp_path}/t"
    found = [(p, s) for _, p, s in M._markers(root, "run", (-1, ""), None, 0)]
    assert sorted(found) == [("deep", "failed"), ("p", "success")]
    assert list(M._markers(root, "run", (-1, ""), None, 3600)) == []
    assert list(M._markers(f"file:{tmp_path}/none", None, (-1, ""), None, 0)) == []


def test_names_that_leave_the_folder_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="not a name"):
        M.write_markers(entries(spark, ("../x", "success", 0)), str(tmp_path / "stats"))


def test_a_watch_over_markers(spark, tmp_path):
    root, seen = str(tmp_path / "stats"), []
    M.write_markers(entries(spark, ("a", "success", 0), ("b", "failed", 0)), root)
    for _ in range(2):
        watch_entries(M.marker_stream(spark, root, "r", lag=0), lambda p, _: seen.extend(r.package for r in p.collect()),
                      str(tmp_path / "state")).awaitTermination()
    assert seen == ["a"]


def test_files_of_changed_artifacts_are_chosen_before_texts_move(spark, tmp_path):
    docs = [(1, "one\ntwo", "src1"), (2, "three", "src2"), (3, "four", None), (2, "three", "src2"), (4, None, "src1")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    some = [("docs", "src2"), ("docs", None), ("other", "src1"), (None, "src1"), ("docs", "none"), ("docs", "src2")]
    changed = spark.createDataFrame(some, "repo string, artifact string")
    every = sorted(fixtures.code_files(spark, str(tmp_path)).collect(), key=str)
    got = sorted(fixtures.code_files(spark, str(tmp_path), changed).collect(), key=str)
    assert got == [r for r in every if r["artifact"] in ("src2", None)] and len(got) == 6
