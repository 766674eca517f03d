import datetime as dt

import pytest
from pyspark.sql import functions as F

from pairloom import schemas
from pairloom.operators import worklist as W


def lines(spark, texts, repo="apt"):
    return spark.createDataFrame([(repo, i, t) for i, t in enumerate(texts)], "repo string, line_no long, line string")


def test_listings(spark, rows):
    apt = lines(spark, ["a - first", "b", "c  two", "d x"])
    assert rows(W.list_packages(apt, 3), "line_no", "package") == [(0, "a"), (1, "b"), (2, "c")]
    assert rows(W.list_packages(apt), "package") == [("a",), ("b",), ("c",), ("d",)]
    assert rows(W.list_packages_drop_last(apt, 10), "package") == [("a",), ("b",), ("c",)]


def test_latest_per_package(spark, rows):
    listing = ["Existing packages:", "", "a/1", "b/1", "a/2", "c", "b/0", "a/2/extra"]
    got = W.latest_per_package(lines(spark, listing))
    assert rows(got, "line_no", "package", "version") == [(5, "c", None), (6, "b", "0"), (7, "a", "2/extra")]
    assert rows(W.latest_per_package(lines(spark, listing), n=2), "package") == [("b",), ("c",)]


def test_listings_of_two_repos(spark, rows):
    both = lines(spark, ["h", "", "a/1", "b/1", "end"]).unionByName(lines(spark, ["H", "", "a/2", "end"], "conan"))
    shifted = both.withColumn("line_no", F.when(F.col("repo") == "conan", F.col("line_no") + 100).otherwise(F.col("line_no")))
    assert rows(W.list_packages_drop_last(shifted, 3), "repo", "package") == [
        ("apt", ""), ("apt", "a/1"), ("apt", "h"), ("conan", ""), ("conan", "H"), ("conan", "a/2")]
    assert rows(W.latest_per_package(shifted), "repo", "package", "version") == [
        ("apt", "a", "1"), ("apt", "b", "1"), ("apt", "end", None), ("conan", "a", "2"), ("conan", "end", None)]


def test_cap_per_repo(spark, rows):
    data = [("big", i, f"p{i}", None) for i in range(50)] + [("small", 0, "q", None)]
    packages = spark.createDataFrame(data, schemas.PACKAGES).repartition(4)
    assert rows(W.cap_per_repo(packages, 2), "repo", "package") == [("big", "p0"), ("big", "p1"), ("small", "q")]


T0 = dt.datetime(2024, 1, 1)
LEDGER = [("r", "a", "failed", 0), ("r", "a", "success", 1), ("r", "b", "success", 0), ("r", "b", "failed", 2),
          ("other", "c", "success", 0)] + [("r", "hot", "success", i) for i in range(300)]


@pytest.fixture
def ledger(spark):
    return spark.createDataFrame([(r, p, s, T0 + dt.timedelta(hours=h)) for r, p, s, h in LEDGER], schemas.LEDGER)


@pytest.fixture
def packages(spark):
    data = [("r", i, p, None) for i, p in enumerate(["a", "b", "c", "hot"])]
    return spark.createDataFrame(data, schemas.PACKAGES)


def test_worklists(ledger, packages, rows):
    assert rows(W.resume_worklist(packages, ledger), "package") == [("c",)]
    artifacts = packages.select("repo", "package")
    assert rows(W.artifact_worklist(artifacts, ledger), "package") == [("b",), ("c",)]
    assert rows(W.artifact_worklist(artifacts, ledger, skip_failures=True), "package") == [("c",)]
    assert W.artifact_worklist(artifacts, ledger, skip_successes=False).count() == 4


@pytest.mark.parametrize("block", [1, 2, 65_536])
def test_success_counts(ledger, packages, rows, monkeypatch, block):
    monkeypatch.setattr(W, "_BLOCK", block)
    assert rows(W.ledger_success_count(packages, ledger)) == [("r", 2)]
    running = W.ledger_success_count(packages, ledger, running=True)
    assert rows(running, "line_no", "num_success") == [(0, 1), (1, 1), (2, 1), (3, 2)]


def test_outcomes_and_ledger_append(spark, rows, tmp_path):
    runs = spark.createDataFrame([("r", p, c, T0) for p, c in (("a", 0), ("b", 1), ("c", 127), ("d", 128))],
                                 "repo string, package string, exit_code int, ts timestamp")
    outcomes = W.classify_outcome(runs)
    assert rows(outcomes, "package", "status", "abort") == [
        ("a", "success", False), ("b", "failed", False), ("c", "failed", False), ("d", None, True)]
    target = str(tmp_path / "ledger")
    W.append_ledger(outcomes, target)
    W.append_ledger(outcomes, target)
    assert spark.read.parquet(target).count() == 6


def test_files(spark, rows):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    files, done = paths("x/a.o", "x/b.o", "y/c.o"), paths("x/a.o.c", "x/a.o.c", "z/c.o.c")
    assert rows(W.file_worklist(files, done)) == [("x/b.o",), ("y/c.o",)]
    assert W.file_worklist(files, done, force=True).count() == 3
    imported = paths("x/a.o", "y/c.o")
    assert rows(W.worklist_progress(files, imported, done)) == [("decompile", 2, 1), ("import", 1, 2)]
    assert rows(W.worklist_progress(files, imported, done, True, True)) == [("decompile", 3, 0), ("import", 3, 0)]
