"""Trees of generated files: ordered text assembly and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.text import MARKER_PREFIX
from pairloom.sources.file_tree import write_tree_files  # noqa: F401


def ordered_concat(pieces: DataFrame, key: str, pos: str, text: str, sep: str,
                   part_pieces: int | None = None) -> DataFrame:
    """Concatenate ``text`` by ``pos`` per ``key`` into (key, part, content): one row per file, its part is 0.

    A caller whose files do not fit one cell gives ``part_pieces``: files then come in parts of so many positions,
    numbered by position, each joined by its own task; every part but a file's first starts with ``sep``, which makes
    plain concatenation of the parts exact (``join_parts``).
    """
    part = F.lit(0) if part_pieces is None else F.floor(F.col(pos) / part_pieces).cast("int")
    joined = pieces.groupBy(F.col(key), part.alias("part")).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))),
                lambda x: x["t"],
            ),
            sep,
        ).alias("content")
    )
    if part_pieces is None or not sep:
        return joined
    first = F.min("part").over(Window.partitionBy(key))
    return joined.withColumn("_first", first).withColumn(
        "content", F.when(F.col("part") > F.col("_first"), F.concat(F.lit(sep), "content")).otherwise(F.col("content"))
    ).drop("_first")


def join_parts(tree: DataFrame, key: str = "rel_path") -> DataFrame:
    """(key, part, content) with the parts of each file put together again, as part 0."""
    return ordered_concat(tree.select(key, F.col("part").alias("_pos"), "content"), key, "_pos", "content", "")


def build_marked_files(functions: DataFrame, part_pieces: int | None = None) -> DataFrame:
    """Per object file, ``// FUNCTION name`` and the text of each function in order.

    The marker always ends its line, which is what the reader of these files needs.
    """
    piece = F.concat(F.lit(MARKER_PREFIX), "name", F.lit("\n"), "text")
    return ordered_concat(functions.withColumn("_piece", piece), "path", "pos", "_piece", "", part_pieces)


def write_tree(tree: DataFrame, out_root: str, force: bool = False) -> None:
    """Store (rel_path, part, content) rows as Parquet, ordered by path; an existing target is an error unless forced."""
    keys = ["rel_path", "part"]
    (
        tree.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .write.mode("overwrite" if force else "errorifexists").parquet(out_root)
    )
