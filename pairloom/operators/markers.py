"""Functions of marked (decompiled) files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import MARKER_START, TRUNCATION_WARNING, function_id, has_body, split_function


def marked_functions(text: Column) -> Column:
    """Array of (name, text), one per marker line; the preamble is dropped.

    The text is cut once; a piece begins with its name, which ends with the line.
    """
    pieces = F.filter(F.split(text, MARKER_START, -1), lambda piece, i: i > 0)
    name = lambda piece: F.substring_index(piece, "\n", 1)
    return F.transform(pieces, lambda p: F.struct(
        name(p).alias("name"), F.substr(p, F.length(name(p)) + 1).alias("text")))


def split_marked_functions(files_text: DataFrame) -> DataFrame:
    """One row per marker line: name, the text up to the next marker, and its position."""
    keep = [c for c in files_text.columns if c != "text"]
    return files_text.select(*keep, F.posexplode(marked_functions(F.col("text"))).alias("pos", "_f")).select(
        *keep, "pos", "_f.name", "_f.text"
    )


def with_parts(functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add head, body, tail and function_id. Functions without a body go to the rejects."""
    kept = (
        functions.where(has_body("text"))
        .withColumn("_s", split_function("text"))
        .select("*", "_s.head", "_s.body", "_s.tail", function_id("path", "name").alias("function_id"))
        .drop("_s")
    )
    return kept, _rejects(functions.where(~has_body("text")), "no_body")


def drop_truncated(functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop functions whose control flow the decompiler gave up on, and report them."""
    bad = F.contains("text", F.lit(TRUNCATION_WARNING))
    return functions.where(~bad), _rejects(functions.where(bad), "truncated")


def _rejects(rows: DataFrame, reason: str) -> DataFrame:
    artifact = F.col("artifact") if "artifact" in rows.columns else F.lit(None).cast("string")
    return rows.select(artifact.alias("artifact"), "path", F.col("pos").cast("int").alias("pos"),
                       F.lit(reason).alias("reason"), F.col("name").alias("detail"))
