"""Whole-tree scans and file classification."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom import schemas
from pairloom.code_types import resolve
from pairloom.functions.text import decode_lossy, file_name
from pairloom.session import materialize, ship_package

# Bytes of file contents a task holds before it passes them on.
CONTENT_BATCH_BYTES = 64 * 1024 * 1024
# Entries of a directory listed in one batch.
LISTING_BATCH = 10_000


def hadoop_path(spark: SparkSession, path: str):
    """Fully qualified Hadoop path and its file system."""
    raw = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = raw.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(raw), fs


_LOCATION = re.compile(r"([a-zA-Z][a-zA-Z0-9+.-]*):(?://([^/]*))?(/.*)", re.S)


@cache
def _file_system(scheme: str, authority: str) -> tuple[pafs.FileSystem, str]:
    found, root = pafs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return found, root.rstrip("/")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a qualified path, and the path in it. The path is taken as it is, never as an encoded URI."""
    scheme, authority, plain = _LOCATION.fullmatch(path).groups()
    found, root = _file_system(scheme, authority or "")
    return found, root + plain


@dataclass(frozen=True)
class Entry:
    name: str
    folder: bool
    length: int | None


def entries_of(filesystem: pafs.FileSystem, plain: str, sizes: bool = True) -> Iterator[Entry]:
    """Files and folders of a folder; links to folders are left out. A local folder is never held as a whole."""
    if isinstance(filesystem, pafs.LocalFileSystem):
        with os.scandir(plain) as found:
            for entry in found:
                if entry.is_dir(follow_symlinks=False):
                    yield Entry(entry.name, True, None)
                elif entry.is_file():
                    yield Entry(entry.name, False, entry.stat().st_size if sizes else None)
        return
    for info in filesystem.get_file_info(pafs.FileSelector(plain)):
        if info.type in (pafs.FileType.File, pafs.FileType.Directory):
            yield Entry(info.base_name, info.type == pafs.FileType.Directory, info.size)


def size_of(filesystem: pafs.FileSystem, plain: str) -> int:
    """The size of a file that was listed without one."""
    return os.stat(plain).st_size if isinstance(filesystem, pafs.LocalFileSystem) else filesystem.get_file_info(plain).size


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files and directories of the directories, in bounded batches; a directory that cannot be listed, with the reason."""
    for batch in batches:
        for directory in batch.column(0).to_pylist():
            filesystem, plain = opened(directory)
            rows: list[tuple] = []
            try:
                for entry in entries_of(filesystem, plain):
                    rows.append((f"{directory.rstrip('/')}/{entry.name}", entry.folder, entry.length or 0, None))
                    if len(rows) == LISTING_BATCH:
                        yield _listed(rows)
                        rows = []
            except OSError as trouble:
                rows.append((directory, False, None, f"{type(trouble).__name__}: {trouble.strerror or trouble}"))
            yield _listed(rows)


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.string())
    columns = zip(*rows) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays(list(map(pa.array, columns, kinds)), names=["path", "is_dir", "length", "problem"])


def list_tree(spark: SparkSession, root: str, repo: str = "") -> tuple[DataFrame, DataFrame]:
    """Every regular file below ``root`` without its content, empty and hidden ones included, and the directories that
    could not be listed, as rejects.

    Directories are listed level by level in tasks, so the list of a very large tree is never held by the driver. Names
    may hold any characters. Linked files are files, linked directories are not entered.
    """
    ship_package(spark)
    qualified, fs = hadoop_path(spark, root)
    if not fs.exists(qualified):
        raise ValueError(f"no folder at {root}")
    base = qualified.toString().rstrip("/")
    directories = spark.createDataFrame([(base,)], "path string")
    levels = []
    while True:
        # Hash partitioning spreads the directories of a level over the tasks.
        spread = directories.repartition("path")
        level = materialize(spread.mapInArrow(_entries, "path string, is_dir boolean, length long, problem string"))
        levels.append(level.where(~F.col("is_dir")).select("path", "length", "problem"))
        directories = level.where("is_dir").select("path")
        if directories.isEmpty():
            break
    found = reduce(DataFrame.unionByName, levels).select(
        F.lit(repo).alias("repo"), "path", F.substr("path", F.lit(len(base) + 2)).alias("rel_path"),
        file_name("path").alias("file_name"), "length", "problem",
    )
    files = derive_artifact(found.where(F.col("problem").isNull()))
    artifact = F.when(F.col("rel_path") != "", F.substring_index("rel_path", "/", 1))
    rejects = found.where(F.col("problem").isNotNull()).select(
        artifact.alias("artifact"), "path", F.lit(None).cast("int").alias("pos"), F.lit("unlisted").alias("reason"),
        F.col("problem").alias("detail"))
    return files.select("repo", "artifact", "path", "rel_path", "file_name", "length"), rejects


def list_files(spark: SparkSession, root: str, repo: str = "") -> DataFrame:
    """The files of ``list_tree``. Add ``with_content`` after filtering: only files that are still wanted get opened."""
    return list_tree(spark, root, repo)[0]


def with_content(files: DataFrame) -> DataFrame:
    """Read the bytes of listed files, spread by path over the tasks and passed on in bounded batches.

    A file that cannot be read has null content; ``unreadable`` lists such files, and the others are not affected.
    """
    ship_package(files.sparkSession)
    names = files.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, start, held = [], 0, 0
            for i, location in enumerate(batch.column(names.index("path")).to_pylist()):
                filesystem, plain = opened(location)
                try:
                    with filesystem.open_input_stream(plain) as stream:
                        contents.append(stream.read())
                except OSError:
                    contents.append(None)
                held += len(contents[-1] or b"")
                if held >= CONTENT_BATCH_BYTES or i + 1 == batch.num_rows:
                    rows = batch.slice(start, len(contents))
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, pa.array(contents, pa.binary())], names=[*names, "content"]
                    )
                    contents, start, held = [], i + 1, 0

    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())])
    return files.repartition("path").mapInArrow(read, schema)


def unreadable(files: DataFrame) -> DataFrame:
    """Rejects of files whose content could not be read."""
    return files.where(F.col("content").isNull()).select(
        "artifact", "path", F.lit(None).cast("int").alias("pos"), F.lit("unreadable").alias("reason"),
        F.col("file_name").alias("detail"),
    )


def scan_files(spark: SparkSession, root: str, repo: str = "") -> DataFrame:
    """Every regular file below ``root`` with its content."""
    return with_content(list_files(spark, root, repo))


def scan_binary_files(spark: SparkSession, root: str, repo: str = "") -> DataFrame:
    """The same through Spark's own binary file source, for any Hadoop path.

    That source leaves out empty files and names that start with ``_`` or ``.``, and keeps the file list on the driver.
    """
    qualified, fs = hadoop_path(spark, root)
    if not fs.exists(qualified):
        raise ValueError(f"no folder at {root}")
    prefix = qualified.toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return derive_artifact(
        files.select(
            F.lit(repo).alias("repo"),
            "path",
            F.substr("path", F.lit(len(prefix) + 1)).alias("rel_path"),
            file_name("path").alias("file_name"),
            "length",
            "content",
        )
    ).select(*schemas.FILES.names)


def scan_files_depth(files: DataFrame, max_depth: int) -> DataFrame:
    """Files at most ``max_depth`` levels below the root; depth 0 is the root itself, which is no file of the tree."""
    return files.where(F.size(F.split("rel_path", "/")) <= max_depth)


def derive_artifact(files: DataFrame) -> DataFrame:
    """Artifact = first component below the root. Files lying directly in the root belong to none and are left out."""
    return files.where(F.contains("rel_path", F.lit("/"))).withColumn(
        "artifact", F.substring_index("rel_path", "/", 1)
    )


def _matches(code_types) -> Column:
    """Array of the (code type, side, suffix) a file name matches; decompiled suffixes beat source suffixes."""
    matches = []
    for ct in resolve(code_types):
        cases = "".join(
            f" WHEN endswith(file_name, '{suffix}') THEN struct('{ct.name}' AS code_type, '{side}' AS side, "
            f"'{suffix}' AS suffix)"
            for side, suffixes in (("decompiled", ct.decompiled), ("source", ct.source))
            for suffix in sorted(suffixes, key=len, reverse=True)
        )
        matches.append(f"CASE{cases} END")
    return F.expr(f"array_compact(array({', '.join(matches)}))")


def recognised_files(files: DataFrame, code_types=None) -> DataFrame:
    """Files that match any of the code types; a cheap filter before contents are read."""
    return files.where(F.size(_matches(code_types)) > 0)


def classify_files(files: DataFrame, code_types=None) -> DataFrame:
    """One row per (file, matching code type) with its side and the matched suffix.

    A decompiled suffix beats a source suffix of the same code type (``x.o.c`` also ends in ``.c``).
    """
    return files.select("*", F.explode(_matches(code_types)).alias("_m")).select(*files.columns, "_m.*")


def skip_empty_files(files: DataFrame) -> DataFrame:
    """Drop zero-byte files: placeholders of earlier failures. The filter reaches the scan, so they are not opened."""
    return files.where(F.col("length") > 0)


def read_text(files: DataFrame) -> DataFrame:
    """Replace ``content`` bytes by decoded ``text``."""
    return files.withColumn("text", decode_lossy("content")).drop("content")


def union_repos(repos: dict[str, DataFrame]) -> DataFrame:
    """Several registries as one dataset, each row labelled with its repo."""
    if not repos:
        raise ValueError("no repos given")
    out = None
    for name, df in repos.items():
        labelled = df.withColumn("repo", F.lit(name))
        out = labelled if out is None else out.unionByName(labelled)
    return out
