"""Folder trees as a data source: listing with pushed filters, and a sink that shows a tree only when it is whole.

Reading gives a row per regular file: repo, artifact (first folder below the root, null for files of the root), path,
rel_path, file_name, ending (last ``.x`` of the name, empty without one), depth (1 in the root), length. A folder that
cannot be listed is a row too, with its ``problem`` and no length, and the rest of the tree is not affected. Linked folders
are not entered. Comparisons with constants reach the listing: ``artifact`` chooses the folders, ``depth`` ends the descent,
``ending``, ``file_name`` and ``length`` are tried before a row is made.

The driver looks at the folders of the first levels, without their files' sizes, and deals them to tasks; a folder of very
many entries is dealt in parts by a hash of their names. A task that has a part of a folder passes over the names of the
others, so a folder has no more parts than its share of all entries seen asks for. Below these levels, and in folders of
more folders than the driver is to name, tasks descend by themselves.
"""

from __future__ import annotations

import operator
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull,
    IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from pairloom.session import ship_package
from pairloom.sources.files import entries_of, hadoop_path, opened, size_of

SCHEMA = ("repo string, artifact string, path string, rel_path string, file_name string, ending string, depth int, "
          "length long, problem string")
COLUMNS = [field.split()[0] for field in SCHEMA.split(", ")]
# Levels that the driver looks at, folders it names, entries of a folder worth a task, and rows passed on at once.
PLANNED_LEVELS = 2
PLANNED_FOLDERS = 10_000
PART_ENTRIES = 5_000
BATCH_ROWS = 10_000

_COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt,
             LessThanOrEqual: operator.le, StringStartsWith: str.startswith, StringEndsWith: str.endswith,
             StringContains: operator.contains, In: lambda value, some: value in some}


@dataclass(frozen=True)
class Condition:
    """A comparison of a column with a constant, as SQL takes it: null holds nothing but ``IS NULL``."""

    column: str
    kind: type
    value: object = None
    negated: bool = False

    @classmethod
    def of(cls, wanted) -> "Condition | None":
        if isinstance(wanted, Not):
            inner = cls.of(wanted.child)
            return inner and cls(inner.column, inner.kind, inner.value, not inner.negated)
        if len(wanted.attribute) != 1 or wanted.attribute[0] not in COLUMNS:
            return None
        if isinstance(wanted, (IsNull, IsNotNull)):
            return cls(wanted.attribute[0], type(wanted))
        if type(wanted) not in _COMPARED:
            return None
        value = tuple(wanted.value) if isinstance(wanted, In) else wanted.value
        if value is None or isinstance(wanted, In) and None in value:
            return None
        return cls(wanted.attribute[0], type(wanted), value)

    def holds(self, value) -> bool:
        if self.kind in (IsNull, IsNotNull):
            return ((value is None) == (self.kind is IsNull)) != self.negated
        return value is not None and bool(_COMPARED[self.kind](value, self.value)) != self.negated


@dataclass
class Folder(InputPartition):
    """Folders of one task: (path below the root, depth of its files, whether to descend, part, parts)."""

    units: list[tuple[str, int, bool, int, int]]


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.repo = options["path"].rstrip("/"), options.get("repo", "")
        self.tasks = int(options.get("tasks", 64))
        self.conditions: list[Condition] = []

    def pushFilters(self, filters):
        for wanted in filters:
            condition = Condition.of(wanted)
            if condition is None:
                yield wanted
            else:
                self.conditions.append(condition)

    def _may(self, column: str, value) -> bool:
        return all(c.holds(value) for c in self.conditions if c.column == column)

    def _descends(self, depth: int) -> bool:
        """Whether some file in that depth or below it can pass."""
        limits = [c.value + (c.kind is not LessThan) for c in self.conditions
                  if c.column == "depth" and not c.negated and c.kind in (LessThan, LessThanOrEqual, EqualTo)]
        return all(depth < limit for limit in limits)

    def _enters(self, rel: str, depth: int) -> bool:
        return self._descends(depth) and self._may("artifact", rel.split("/")[0])

    def partitions(self) -> list[Folder]:
        filesystem, plain = opened(self.root)
        looked, level, named = [], [""], 0
        for depth in range(1, PLANNED_LEVELS + 1):
            below = []
            for rel in level:
                count, inside = 0, []
                try:
                    for entry in entries_of(filesystem, f"{plain}/{rel}" if rel else plain, sizes=False):
                        count += 1
                        if entry.folder and named + len(inside) <= PLANNED_FOLDERS:
                            name = f"{rel}/{entry.name}".lstrip("/")
                            if self._enters(name, depth + 1):
                                inside.append(name)
                except OSError:
                    pass  # the task that lists it says so
                descend = named + len(inside) > PLANNED_FOLDERS
                if not descend:
                    named += len(inside)
                    below += inside
                looked.append((rel, depth, descend, count))
            level = below
        seen, units = sum(count for *_, count in looked) or 1, []
        for rel, depth, descend, count in looked:
            parts = max(1, min(-(-count // PART_ENTRIES), -(-count * self.tasks // seen)))
            units += [(rel, depth, descend, part, parts) for part in range(parts)]
        units += [(rel, PLANNED_LEVELS + 1, True, 0, 1) for rel in level]
        step = max(1, min(self.tasks, len(units)))
        return [Folder(units[k::step]) for k in range(step)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in self._rows(partition):
            rows.append(row)
            if len(rows) == BATCH_ROWS:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    def _rows(self, partition: Folder) -> Iterator[tuple]:
        filesystem, plain = opened(self.root)
        waiting = list(partition.units)
        while waiting:
            rel, depth, descend, part, parts = waiting.pop()
            folder = f"{plain}/{rel}" if rel else plain
            try:
                # Of a folder in parts only the own files are asked for their sizes.
                for entry in entries_of(filesystem, folder, sizes=parts == 1):
                    if parts > 1 and zlib.crc32(entry.name.encode("utf-8", "surrogateescape")) % parts != part:
                        continue
                    name = f"{rel}/{entry.name}".lstrip("/")
                    if not entry.folder:
                        length = size_of(filesystem, f"{folder}/{entry.name}") if entry.length is None else entry.length
                        yield from self._kept(name, entry.name, depth, length, None)
                    elif descend and self._enters(name, depth + 1):
                        waiting.append((name, depth + 1, True, 0, 1))
            except OSError as trouble:
                if not part:
                    yield from self._kept(rel, None, depth, None, f"{type(trouble).__name__}: {trouble.strerror or trouble}")

    def _kept(self, rel: str, name: str | None, depth: int, length: int | None, problem: str | None) -> Iterator[tuple]:
        stem, dot, ending = (name or "").rpartition(".")
        artifact = rel.split("/")[0] if "/" in rel or name is None and rel else None
        row = (self.repo, artifact, f"{self.root}/{rel}".rstrip("/"), rel, name,
               None if name is None else f".{ending}" if dot else "", depth, length, problem)
        if all(c.holds(row[COLUMNS.index(c.column)]) for c in self.conditions):
            yield row


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"depth": pa.int32(), "length": pa.int64()}
    columns = zip(*rows) if rows else [[] for _ in COLUMNS]
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kinds.get(name, pa.string())) for name, column in zip(COLUMNS, columns)], names=COLUMNS)


@dataclass
class Written(WriterCommitMessage):
    files: int


class TreeWriter(DataSourceWriter):
    """Files of rows (rel_path, part, content), a file's rows one after another by part, all in one task.

    Tasks write into a folder beside the target; the commit renames it. A job that fails or is stopped never had a target.
    """

    def __init__(self, options, overwrite: bool):
        self.root, self.overwrite = options["path"].rstrip("/"), overwrite
        parent, _, name = self.root.rpartition("/")
        self.aside = f"{parent}/_pending-{name}-{uuid.uuid4().hex}"

    def write(self, rows) -> Written:
        return self._written((row.rel_path, bytes(row.content or b"")) for row in rows)

    def _written(self, pieces: Iterator[tuple[str, bytes | pa.Buffer]]) -> Written:
        filesystem, base = opened(self.aside)
        # A repeated or second attempt of the task puts the same files in the same places.
        attempt = uuid.uuid4().hex
        current, stream, half, files = None, None, None, 0

        def close() -> None:
            if stream is not None:
                stream.close()
                filesystem.move(half, f"{base}/{current}")

        for rel, content in pieces:
            if rel != current:
                close()
                current = rel
                steps = current.split("/")
                if not current or any(step in ("", ".", "..") for step in steps):
                    raise ValueError(f"{current!r} leads out of the output folder")
                half = f"{base}/{current}.{attempt}.half"
                try:
                    stream = filesystem.open_output_stream(half)
                except FileNotFoundError:  # the first file of its folder
                    filesystem.create_dir(half.rpartition("/")[0], recursive=True)
                    stream = filesystem.open_output_stream(half)
                files += 1
            stream.write(content)
        close()
        return Written(files)

    def commit(self, messages) -> None:
        filesystem, aside = opened(self.aside)
        _, target = opened(self.root)
        filesystem.create_dir(aside, recursive=True)  # a tree without files
        old = f"{aside}-old"
        there = filesystem.get_file_info(target).type != pafs.FileType.NotFound
        if there and not self.overwrite:
            filesystem.delete_dir(aside)
            raise ValueError(f"{self.root} is there already; force replaces it")
        if there:
            filesystem.move(target, old)
        filesystem.move(aside, target)
        if there:
            filesystem.delete_dir(old)

    def abort(self, messages) -> None:
        filesystem, aside = opened(self.aside)
        if filesystem.get_file_info(aside).type != pafs.FileType.NotFound:
            filesystem.delete_dir(aside)


class ArrowTreeWriter(TreeWriter, DataSourceArrowWriter):
    """The same from Arrow batches, whose contents are written without making Python objects of them."""

    def write(self, batches) -> Written:
        return self._written(
            (rel.as_py(), content.as_buffer() if content.is_valid else b"")
            for batch in batches for rel, content in zip(batch.column("rel_path"), batch.column("content")))


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArrowTreeWriter:
        return ArrowTreeWriter(self.options, overwrite)


def _registered(spark: SparkSession, root: str):
    ship_package(spark)
    spark.dataSource.register(FileTree)
    return hadoop_path(spark, root)


def read_tree(spark: SparkSession, root: str, repo: str = "", tasks: int | None = None) -> DataFrame:
    """The files below ``root`` and the folders that could not be listed, without contents. Filters are pushed."""
    path, fs = _registered(spark, root)
    if not fs.exists(path):
        raise ValueError(f"no folder at {root}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return (
        spark.read.format("file_tree").option("path", path.toString()).option("repo", repo)
        .option("tasks", tasks or 4 * spark.sparkContext.defaultParallelism).load()
    )


def unlisted(tree: DataFrame) -> DataFrame:
    """Rejects of the folders that could not be listed."""
    return tree.where(F.col("problem").isNotNull()).select(
        "repo", "artifact", "path", F.lit(None).cast("int").alias("pos"), F.lit("unlisted").alias("reason"),
        F.col("problem").alias("detail"))


def write_tree_files(tree: DataFrame, out_root: str, force: bool = False) -> None:
    """Write (rel_path, part, content) rows as separate files, each streamed by one task. The tree appears as a whole when
    all files are written; an existing one is an error unless ``force`` replaces it."""
    path, fs = _registered(tree.sparkSession, out_root)
    if fs.exists(path) and not force:
        raise ValueError(f"{out_root} is there already; force replaces it")
    rows = tree.select("rel_path", F.col("part").cast("int").alias("part"), F.col("content").cast("binary").alias("content"))
    # Each task takes the first folders in an order of its own; else all tasks make files in one folder at a time.
    turn = F.xxhash64(F.substring_index("rel_path", "/", 1), F.spark_partition_id())
    (
        rows.repartition("rel_path").withColumn("_turn", turn).sortWithinPartitions("_turn", "rel_path", "part").drop("_turn")
        .write.format("file_tree").mode("overwrite" if force else "append").option("path", path.toString()).save()
    )
