"""Status-marker files (``<package>.success``, ``<package>.failed``) as a ledger, in batch order and as a stream.

The stream's offset is the time and the path of the last marker that was read. Markers are taken in that order, so an
offset says which files were read without naming them all, and a restart goes on after the last one. A marker touched again
is a new entry.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from pairloom.session import ship_package
from pairloom.sources.files import hadoop_path, opened

# Endings of marker files and what they mean.
ENDINGS = {".success": "success", ".failed": "failed", ".fail": "failed"}
_SCHEMA = "repo string, package string, status string, ts timestamp"
_EPOCH = dt.datetime(1970, 1, 1)

Place = tuple[int, str]  # time in nanoseconds, path


def _markers(root: str, marker: str | None, after: Place, upto: Place | None, lag: float) -> Iterator[tuple[Place, str, str]]:
    """((time, path), package, status) of the markers after one place, in order; ``upto`` another one, or until ``lag``
    seconds ago. Only these are held; the folder is listed as Spark's own file stream does."""
    filesystem, plain = opened(root)
    newest = time.time_ns() - int(lag * 1e9)
    found = []
    for info in filesystem.get_file_info(pafs.FileSelector(plain, recursive=marker is not None, allow_not_found=True)):
        stem, dot, ending = info.base_name.rpartition(".")
        status = ENDINGS.get(dot + ending)
        if info.type != pafs.FileType.File or not status or (marker is not None and stem != marker):
            continue
        place = (info.mtime_ns, info.path)
        if after < place and (place <= upto if upto else place[0] <= newest):
            package = stem if marker is None else info.path.rpartition("/")[0].rpartition("/")[2]
            found.append((place, package, status))
    return iter(sorted(found))


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.root, self.repo = options["path"], options.get("repo", "")
        self.marker, self.lag = options.get("marker"), float(options.get("lag", 2))

    def initialOffset(self) -> dict:
        return {"ns": -1, "path": ""}

    def _rows(self, found) -> list[tuple]:
        return [(self.repo, package, status, _EPOCH + dt.timedelta(microseconds=place[0] // 1000))
                for place, package, status in found]

    def read(self, start: dict):
        found = list(_markers(self.root, self.marker, (start["ns"], start["path"]), None, self.lag))
        end = found[-1][0] if found else (start["ns"], start["path"])
        return iter(self._rows(found)), {"ns": end[0], "path": end[1]}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._rows(_markers(
            self.root, self.marker, (start["ns"], start["path"]), (end["ns"], end["path"]), 0)))


class MarkerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "status_markers"

    def schema(self) -> str:
        return _SCHEMA

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(self.options)


def marker_stream(spark: SparkSession, root: str, repo: str = "", marker: str | None = None, lag: float = 2) -> DataFrame:
    """Stream of ledger entries (repo, package, status, ts) from the marker files of a folder.

    With ``marker`` the files are ``<package>/<marker>.success`` in any depth. A file counts when it is ``lag`` seconds
    old: until then one with an earlier time, from a machine with another clock, may still appear.
    """
    ship_package(spark)
    spark.dataSource.register(MarkerSource)
    path, _ = hadoop_path(spark, root)
    reader = spark.readStream.format("status_markers").option("path", path.toString()).option("repo", repo).option("lag", lag)
    return (reader if marker is None else reader.option("marker", marker)).load()


def write_markers(outcomes: DataFrame, root: str) -> None:
    """Leave an empty file per (package, status) in a folder, written by the tasks. Names with a slash are not allowed."""
    spark = outcomes.sparkSession
    ship_package(spark)
    path, fs = hadoop_path(spark, root)
    fs.mkdirs(path)
    base = path.toString().rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for package, status in zip(*(column.to_pylist() for column in batch.columns)):
                if not package or "/" in package:
                    raise ValueError(f"not a name of a package: {package}")
                filesystem, plain = opened(f"{base}/{package}.{status}")
                # Written aside and renamed, so that a reader never meets half a file and a repeated task does no harm.
                aside = f"{plain}.{uuid.uuid4().hex}"
                filesystem.open_output_stream(aside).close()
                filesystem.move(aside, plain)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows = outcomes.where(F.col("status").isNotNull()).select("package", "status").distinct()
    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()
