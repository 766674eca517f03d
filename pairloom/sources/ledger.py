"""A ledger of package outcomes as a log of files with snapshots: readers need the newest snapshot and the files after it.

``<root>/log`` holds Parquet files of entries; entries are only ever added. ``<root>/snapshots/<n>`` holds the newest entry
per package over some of these files, and the names of the files. A snapshot counts once its ``done`` file is there, and is
never changed. A reader takes the last one, and of the log the files that it does not name, so it sees every entry once,
whatever is appended or compacted meanwhile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom import schemas
from pairloom.sources.files import hadoop_path

_NEWEST = "repo string, package string, ts timestamp, status string"


def append_entries(outcomes: DataFrame, root: str) -> None:
    """Add the outcomes that have a status as log files."""
    outcomes.where(F.col("status").isNotNull()).select(*schemas.LEDGER.names).write.mode("append").parquet(f"{root}/log")


def _names(spark: SparkSession, folder: str) -> list[str]:
    path, fs = hadoop_path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """The snapshots that count."""
    found = [int(name) for name in _names(spark, f"{root}/snapshots") if name.isdigit()]
    return sorted(n for n in found if "done" in _names(spark, f"{root}/snapshots/{n}"))


def _log_files(spark: SparkSession, root: str) -> list[str]:
    return [name for name in _names(spark, f"{root}/log") if name.endswith(".parquet")]


def _covered(spark: SparkSession, root: str, number: int) -> set[str]:
    return {r["name"] for r in spark.read.schema("name string").parquet(f"{root}/snapshots/{number}/files").collect()}


def _state(spark: SparkSession, root: str) -> tuple[int, DataFrame | None, list[str]]:
    """Number and newest entries of the last snapshot, and the log files that came after it."""
    done = versions(spark, root)
    # The log is listed after the snapshot was chosen: a file that both miss is not in the ledger yet.
    if not done:
        return 0, None, _log_files(spark, root)
    last = f"{root}/snapshots/{done[-1]}"
    covered = _covered(spark, root, done[-1])
    return done[-1], spark.read.schema(_NEWEST).parquet(f"{last}/newest"), [
        name for name in _log_files(spark, root) if name not in covered]


def newest_entries(spark: SparkSession, root: str) -> DataFrame:
    """(repo, package, ts, status): the newest entry of every package."""
    _, snapshot, tail = _state(spark, root)
    return _newest(spark, root, snapshot, tail)


def _newest(spark: SparkSession, root: str, snapshot: DataFrame | None, tail: list[str]) -> DataFrame:
    parts = [snapshot] if snapshot is not None else []
    if tail:
        entries = spark.read.schema(schemas.LEDGER).parquet(*[f"{root}/log/{name}" for name in tail])
        parts.append(entries.select("repo", "package", "ts", "status"))
    if not parts:
        return spark.createDataFrame([], _NEWEST)
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy("repo", "package").agg(F.max(F.struct("ts", "status")).alias("_last")).select(
        "repo", "package", "_last.ts", "_last.status")


def compact(spark: SparkSession, root: str) -> int:
    """Write the next snapshot from the last one and the files after it; the number of the last snapshot.

    Entries appended meanwhile are in files that it does not name. A compaction that was stopped leaves a folder without
    ``done``, whose number is not used again. Of two that take the same number one fails; two with different numbers are
    both right.
    """
    number, snapshot, tail = _state(spark, root)
    if not tail:
        return number
    taken = [int(name) for name in _names(spark, f"{root}/snapshots") if name.isdigit()]
    folder = f"{root}/snapshots/{max(taken, default=0) + 1}"
    _newest(spark, root, snapshot, tail).write.parquet(f"{folder}/newest")
    # Of the files named before, only those still in the log need a name.
    names = set(tail) | (_covered(spark, root, number) & set(_log_files(spark, root)) if number else set())
    spark.createDataFrame([(name,) for name in sorted(names)], "name string").coalesce(1).write.parquet(f"{folder}/files")
    path, fs = hadoop_path(spark, f"{folder}/done")
    fs.create(path, False).close()
    return max(taken, default=0) + 1


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete all but the last ``keep`` snapshots, unfinished ones included, and the log files that the oldest kept one
    names. Readers of the kept ones are not affected."""
    done = versions(spark, root)[-max(keep, 1):]
    if not done:
        return
    for name in _covered(spark, root, done[0]):
        path, fs = hadoop_path(spark, f"{root}/log/{name}")
        fs.delete(path, False)
    for name in _names(spark, f"{root}/snapshots"):
        if name.isdigit() and int(name) < done[0]:
            path, fs = hadoop_path(spark, f"{root}/snapshots/{name}")
            fs.delete(path, True)
