"""Keying, deduplication, pairing and the reports around it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.text import is_blank
from pairloom.session import materialize

KEY = ["artifact", "code_type", "function_id"]


def within(df: DataFrame, *columns: str) -> list[str]:
    """The columns, preceded by ``repo`` if the set has one: artifacts of different repos never mix. A set without that
    column is one repo."""
    return (["repo"] if "repo" in df.columns else []) + list(columns)


def dedupe_functions(functions: DataFrame, last_by: Sequence[str] = ("path", "pos")) -> DataFrame:
    """One body per (artifact, code type, function id): the last one, kept at the first one's position.

    An id shared by many functions is reduced before the shuffle; the later join reuses this grouping's partitioning.
    """
    return functions.groupBy(*within(functions, *KEY)).agg(
        F.max_by("body", F.struct(*last_by)).alias("body"),
        F.min(F.struct("path", F.col("pos").cast("int").alias("pos"))).alias("seq"),
    )


def dedupe_source(functions: DataFrame) -> DataFrame:
    """Source side. Functions found through includes come after the file's own ones, so they win."""
    if "imported" in functions.columns:
        return dedupe_functions(functions, ("path", "imported", "def_path", "pos"))
    return dedupe_functions(functions)


def dedupe_decompiled(functions: DataFrame) -> DataFrame:
    """Decompiled side."""
    return dedupe_functions(functions)


def join_on(left: DataFrame, right: DataFrame, key: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key equals a null key, as it does in a grouping. The result has the key once."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in key})
    joined = left.join(renamed, reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"_right_{c}"]) for c in key]), how)
    if how == "full_outer":
        joined = joined.withColumns({c: F.coalesce(c, f"_right_{c}") for c in key})
    return joined.drop(*[f"_right_{c}" for c in key])


def pair_examples(source: DataFrame, decompiled: DataFrame) -> DataFrame:
    """One example per id present on both sides of the same repo, artifact and code type. Null keys are keys."""
    key = within(source, *KEY)
    s = source.select(*key, F.col("body").alias("source"))
    d = decompiled.select(*key, F.col("body").alias("decompiled"), "seq")
    return join_on(s, d, key).select(
        *within(source), "artifact", "code_type", F.col("function_id").alias("ident"), "source", "decompiled", "seq"
    )


def missing_sources(source: DataFrame, decompiled: DataFrame) -> DataFrame:
    """Decompiled ids without a source."""
    key = within(source, *KEY)
    return join_on(decompiled.select(*key), source.select(*key), key, "left_anti")


def missing_decompileds(source: DataFrame, decompiled: DataFrame) -> DataFrame:
    """Source ids that no decompiled function claimed."""
    key = within(source, *KEY)
    return join_on(source.select(*key), decompiled.select(*key), key, "left_anti")


def missing_report(source: DataFrame, decompiled: DataFrame, sample: int = 100) -> DataFrame:
    """Per artifact, code type and missing side: how many ids, and the first ``sample`` of them.

    Counts are complete. The sample is cut on the map side before the shuffle (a limit per group), so an artifact
    holding most ids sends at most ``sample`` of them per task. The missing ids are stored once, for both uses.
    """
    key = within(source, *KEY)
    sides = join_on(source.select(*key, F.lit(True).alias("_s")), decompiled.select(*key, F.lit(True).alias("_d")), key,
                    "full_outer")
    missing = materialize(
        sides.where(F.col("_s").isNull() | F.col("_d").isNull()).select(
            *key, F.when(F.col("_s").isNull(), "source").otherwise("decompiled").alias("side")
        )
    )
    group = within(source, "artifact", "code_type", "side")
    counts = missing.groupBy(*group).agg(F.count("*").alias("n"))
    first = Window.partitionBy(*group).orderBy("function_id")
    samples = (
        missing.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= sample)
        .groupBy(*group).agg(F.array_sort(F.collect_list("function_id")).alias("sample"))
    )
    return join_on(counts, samples, group, "left").select(*group, "n", "sample")


def drop_half_blank(examples: DataFrame) -> DataFrame:
    """Drop pairs with exactly one blank side. Pairs blank on both sides stay."""
    return examples.where(is_blank("source") == is_blank("decompiled"))


def half_blank_report(examples: DataFrame) -> DataFrame:
    """The pairs ``drop_half_blank`` drops, and which side was blank."""
    return examples.where(is_blank("source") != is_blank("decompiled")).select(
        *within(examples, "artifact"),
        F.col("seq.path").alias("path"),
        F.col("seq.pos").alias("pos"),
        F.when(is_blank("source"), "blank_source").otherwise("blank_decompiled").alias("reason"),
        F.col("ident").alias("detail"),
    )


def union_code_types(parts: Sequence[DataFrame]) -> DataFrame:
    """Examples of several code types as one set."""
    if not parts:
        raise ValueError("no examples given")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def distinct_artifacts(classified: DataFrame) -> DataFrame:
    """Artifacts with at least one recognised file."""
    return classified.select(*within(classified, "artifact")).distinct()


def repo_profile(classified: DataFrame) -> DataFrame:
    """Number of artifacts, source files and decompiled files. A file counts once per matching code type."""
    return classified.agg(
        F.count_distinct(*within(classified, "artifact")).alias("artifacts"),
        F.count_if(F.col("side") == "source").alias("source_files"),
        F.count_if(F.col("side") == "decompiled").alias("decompiled_files"),
    )


def new_ids_per_file(functions: DataFrame) -> DataFrame:
    """Per file, code type and side: how many ids are first seen in it (0 for files that only repeat).

    The distinct (file, id) pairs, without any text, are stored once, so files are not read again for the second use.
    """
    file_key = within(functions, "artifact", "code_type", "side", "path")
    pairs = materialize(functions.select(*file_key, "function_id").distinct())
    # The first position of an id lies in the smallest path that has it.
    first = pairs.groupBy(*within(pairs, "artifact", "code_type", "side", "function_id")).agg(F.min("path").alias("path"))
    new = first.groupBy(*file_key).agg(F.count("*").alias("new_ids"))
    return (
        join_on(pairs.select(*file_key).distinct(), new, file_key, "left")
        .select(*file_key, F.coalesce("new_ids", F.lit(0)).cast("long").alias("new_ids"))
    )


def examples_per_artifact(examples: DataFrame) -> DataFrame:
    """Example counts per (artifact, code type), per artifact (code_type null) and in total (both null). A set with
    ``repo`` is counted within each repo, with one more line per repo."""
    return examples.rollup(*within(examples, "artifact", "code_type")).agg(F.count("*").alias("n"))
