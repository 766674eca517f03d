"""The main job: a scanned tree of files to paired examples, in one scan and one shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.code_types import resolve
from pairloom.functions.text import file_name, function_id
from pairloom.operators.dataset import artifact_cutoff, soft_cap_files
from pairloom.operators.extract import function_parts, scanned
from pairloom.operators.includes import extract_includes, functions_with_imports, include_closure, resolve_includes
from pairloom.operators.markers import marked_functions
from pairloom.operators.pairing import KEY, drop_half_blank, half_blank_report, new_ids_per_file, within
from pairloom.session import materialize, ship_package
from pairloom.sources.files import classify_files, read_text, recognised_files, skip_empty_files, with_content

# Suffixes of files that are read for what they define when a source includes them.
HEADER_SUFFIXES = (".h", ".hh", ".hpp", ".hxx", ".h++", ".inc", ".inl")


@dataclass(frozen=True)
class Build:
    """Examples, and what did not become one: (artifact, path, pos, reason, detail)."""

    examples: DataFrame
    rejects: DataFrame


def _opened(files: DataFrame) -> DataFrame:
    return files if "content" in files.columns else with_content(files)


def _scanned(files: DataFrame, code_types) -> DataFrame:
    """Classified texts with the parser's answer for source texts.

    ``files`` may come with content (``scan_files``) or without (``list_files``); in the latter case only recognised,
    non-empty files are opened. Every file is read once, and only source texts cross to Python.
    """
    ship_package(files.sparkSession)
    texts = read_text(classify_files(_opened(recognised_files(skip_empty_files(files), code_types)), code_types))
    return texts.withColumn("_scan", scanned(
        F.when(_parsed(code_types), F.col("text")), code_types=code_types, marked=F.col("side") == "decompiled"))


def _parsed(code_types) -> Column:
    """Files that go through a parser: sources, and marked files of types with rules of their own."""
    own = [ct.name for ct in resolve(code_types) if ct.split]
    return (F.col("side") == "source") | (F.col("code_type").isin(own) if own else F.lit(False))


def _functions(code_types) -> Column:
    return F.when(_parsed(code_types), F.col("_scan.functions")).otherwise(marked_functions(F.col("text")))


def _exploded(files: DataFrame, functions: Column) -> DataFrame:
    keys = within(files, "artifact", "code_type", "side", "path")
    return files.select(*keys, F.posexplode(functions).alias("pos", "_f")).select(*keys, "pos", "_f.name", "_f.text")


def _with_parts(functions: DataFrame, code_types=None) -> DataFrame:
    return (
        functions.withColumn("_s", function_parts(F.col("text"), code_types)).where(F.col("_s").isNotNull())
        .select("*", "_s.head", "_s.body", "_s.tail", function_id("path", "name").alias("function_id"))
        .drop("_s")
    )


def read_functions(files: DataFrame, code_types=None) -> DataFrame:
    """Functions with a body of both sides."""
    # Exploded where it is made: a named array would be filtered first, and the parser called for that once more.
    return _with_parts(_exploded(_scanned(files, code_types), _functions(code_types)), code_types)


def match_sides(functions: DataFrame) -> DataFrame:
    """Both sides of every id in one grouping: (key, source, decompiled, source_seq, seq).

    A side that is missing is null. Last body wins and first position is kept, as in the separate operators; ids that
    occur very often are reduced on the map side. A function that a source includes comes after its own ones.
    """
    last = "path, imported, def_path, pos" if "imported" in functions.columns else "path, pos"

    def side(name: str, aggregate: str) -> Column:
        return F.expr(f"{aggregate} FILTER (WHERE side = '{name}')")

    return functions.groupBy(*within(functions, *KEY)).agg(
        side("source", f"max_by(body, struct({last}))").alias("source"),
        side("decompiled", f"max_by(body, struct({last}))").alias("decompiled"),
        side("source", "min(struct(path, pos))").alias("source_seq"),
        side("decompiled", "min(struct(path, pos))").alias("seq"),
    )


def _pairs(functions: DataFrame) -> DataFrame:
    both = match_sides(functions).where(F.col("source").isNotNull() & F.col("decompiled").isNotNull())
    return both.select(*within(both, "artifact", "code_type"), F.col("function_id").alias("ident"), "source",
                       "decompiled", "seq")


def build_examples(files: DataFrame, code_types=None) -> DataFrame:
    """Examples of a tree: extract, key, keep the last body per id, pair within the artifact, drop half-blank pairs."""
    return drop_half_blank(_pairs(read_functions(files, code_types)))


def imported_functions(files: DataFrame, functions: DataFrame, code_types=None,
                       library_dirs: Sequence[str] = (), child_depth: int = 0) -> DataFrame:
    """Source functions that source files get through includes, under the including file's path.

    Only functions that can be paired are brought to a file: those whose name occurs on the decompiled side under the
    file's stem. So a header's functions meet the files that use them, not all that reach it.
    """
    is_header = F.lit(False)
    for suffix in HEADER_SUFFIXES:
        is_header = is_header | F.endswith("file_name", F.lit(suffix))
    ours = F.coalesce(*[
        F.when(F.endswith("file_name", F.lit(s)), True) for ct in resolve(code_types) for s in ct.source], F.lit(False))
    texts = materialize(read_text(_opened(skip_empty_files(files).where(is_header | ours))).select(
        *within(files, "artifact"), "path", "text"))
    key = within(files, "artifact", "code_type")
    sources = materialize(functions.where(F.col("side") == "source").select(*key, "path").distinct())
    resolved = resolve_includes(extract_includes(texts), texts.select("path"), library_dirs, child_depth)
    # Only what a file gets from others counts, so files that no other includes are not parsed for it.
    closure = materialize(include_closure(resolved, sources.select("path").distinct()).where("root != path"))
    stem = F.substring_index(file_name("path"), ".", 1)
    names = functions.where(F.col("side") == "decompiled").select(
        *key, stem.alias("_stem"), F.substring_index("name", "<", 1).alias("name")).distinct()
    types = F.array(*[F.lit(ct.name) for ct in resolve(code_types)])
    parsed = texts.join(closure.select("path").distinct(), "path", "left_semi").select(
        "path", "text", F.explode(types).alias("code_type"))
    defined = materialize(
        parsed.select("path", "code_type",
                      F.posexplode(scanned(F.col("text"), code_types=code_types)["functions"]).alias("pos", "_f"))
        .select("path", "code_type", "pos", "_f.name", "_f.text"))
    users = closure.join(sources.select(F.col("path").alias("root"), stem.alias("_stem"), *key), "root")
    found = functions_with_imports(defined, users, names).where("imported")
    return found.join(sources, ["path", "code_type"]).withColumn("side", F.lit("source"))


def build(files: DataFrame, code_types=None, max_len: int = 0, imports: bool = False,
          library_dirs: Sequence[str] = (), child_depth: int = 0) -> Build:
    """Examples and rejects of a tree, with budget and imported functions if asked for.

    ``max_len`` > 0 limits the work: per artifact and side, files are taken in path order until so many new ids were
    seen, and artifacts in name order until so many examples. ``imports`` adds functions found through includes. Files
    are parsed once and stored, for examples and rejects alike. Reasons: ``unreadable``, ``extraction`` (what the parser
    could not follow; functions found all the same are kept), ``no_body``, ``blank_source``, ``blank_decompiled``.
    """
    parsed = materialize(_scanned(files, code_types).select(
        *within(files, "artifact", "code_type", "side", "path"), _functions(code_types).alias("functions"),
        F.when(F.col("text").isNull(), "unreadable").otherwise(F.col("_scan.problem")).alias("problem")))
    plain = _exploded(parsed, F.col("functions"))
    functions = _with_parts(plain, code_types)
    if max_len > 0:
        file_key = within(functions, "artifact", "code_type", "side", "path")
        kept = soft_cap_files(new_ids_per_file(functions), max_len).select(*file_key)
        functions = materialize(functions.join(kept, file_key, "left_semi"))
    if imports:
        extra = _with_parts(imported_functions(files, functions, code_types, library_dirs, child_depth), code_types)
        functions = functions.withColumns({"def_path": F.col("path"), "imported": F.lit(False)}).unionByName(extra)
    pairs = materialize(_pairs(functions))
    examples = artifact_cutoff(drop_half_blank(pairs), max_len)
    columns = within(parsed, "artifact")
    nowhere = F.lit(None).cast("int").alias("pos")
    faults = parsed.where(F.col("problem").isNotNull()).select(
        *columns, "path", nowhere, F.when(F.col("problem") == "unreadable", "unreadable").otherwise("extraction")
        .alias("reason"), F.col("problem").alias("detail"))
    bodiless = plain.where(function_parts(F.col("text"), code_types).isNull()).select(
        *columns, "path", F.col("pos").cast("int").alias("pos"), F.lit("no_body").alias("reason"),
        F.col("name").alias("detail"))
    return Build(examples, faults.unionByName(bodiless).unionByName(half_blank_report(pairs)))
