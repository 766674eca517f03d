"""One query per operator over the given tables. Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.code_types import CodeType
from pairloom.functions import text as T
from pairloom.operators import dataset, encode, extract, includes, markers, pairing, transform, worklist
from pairloom.plans import fixtures as X
from pairloom.plans.build import build, build_examples, match_sides, read_functions
from pairloom.session import materialize, scratch
from pairloom.sources import examples as example_files
from pairloom.sources import file_tree
from pairloom.sources import files as file_source
from pairloom.sources import ledger as ledger_store
from pairloom.sources import status_markers
from pairloom.sources import tree as tree_source
from pairloom.streaming import maintain
from pairloom.streaming.watch import watch_ledger as start_watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BOTH = ("c", "cpp")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def stand_in_model(texts: pd.Series) -> pd.Series:
    """Deterministic replacement of a real model."""
    return texts.str.replace(" ", "_", regex=False)


def _joined(ids: str) -> Column:
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")


def _example_columns(df: DataFrame) -> DataFrame:
    return df.select("artifact", "code_type", "ident", "source", "decompiled",
                     F.col("seq.path").alias("seq_path"), F.col("seq.pos").alias("seq_pos"))


def _examples(spark: SparkSession, sf_dir: str, code_types=None) -> DataFrame:
    return materialize(build_examples(X.code_files(spark, sf_dir), code_types))


def _side(spark: SparkSession, sf_dir: str, source: bool) -> DataFrame:
    files = X.source_files(spark, sf_dir) if source else X.marked_files(spark, sf_dir)
    dedupe = pairing.dedupe_source if source else pairing.dedupe_decompiled
    return dedupe(read_functions(files))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _side(spark, sf_dir, True), _side(spark, sf_dir, False)


def _classified(spark: SparkSession, sf_dir: str, code_types=BOTH) -> DataFrame:
    return file_source.classify_files(X.file_names(spark, sf_dir), code_types)


def _source_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = file_source.classify_files(X.source_files(spark, sf_dir), "cpp")
    return file_source.read_text(files).select("artifact", "code_type", "path", "rel_path", "text")


def _marked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = file_source.classify_files(X.marked_files(spark, sf_dir), "cpp")
    return file_source.read_text(files).select("artifact", "code_type", "path", "rel_path", "text")


# The main job.

@query
def paired_examples(spark, sf_dir):
    return _example_columns(build_examples(X.code_files(spark, sf_dir)))


@query
def build_with_rejects(spark, sf_dir):
    built = build(X.faulty_files(spark, sf_dir))
    examples = built.examples.select(F.lit("example").alias("kind"), F.col("seq.path").alias("path"),
                                     F.col("seq.pos").alias("pos"), F.col("ident").alias("detail"))
    return examples.unionByName(built.rejects.select(F.col("reason").alias("kind"), "path", "pos", "detail"))


@query
def build_with_budget(spark, sf_dir):
    return _example_columns(build(X.code_files(spark, sf_dir), max_len=150).examples)


@query
def build_with_imports(spark, sf_dir):
    return _example_columns(build(X.files_with_headers(spark, sf_dir), imports=True).examples)


def _lines_of(text: str) -> tuple[list[tuple[str, str]], str | None]:
    """Rules of an own code type: every line is a function named by its first word."""
    lines = [line for line in text.split("\n") if line]
    return [(line.split(" ")[0], line) for line in lines], None if lines else "empty"


NOTES = CodeType("notes", "Notes", (".c", ".cpp", ".cc"), (), (), extract=_lines_of)


@query
def extract_own_type(spark, sf_dir):
    files = file_source.classify_files(X.source_files(spark, sf_dir), [NOTES])
    functions, _ = extract.extract_functions(
        file_source.read_text(files).select("artifact", "code_type", "path", "text"), code_types=[NOTES])
    return functions.select("path", "code_type", "pos", "name", F.length("text").alias("length"))


def _marked_lines(text: str) -> tuple[list[tuple[str, str]], str | None]:
    """Rules of an own type for marked files: a line that calls something, named by the text up to its bracket."""
    lines = [line.strip() for line in text.split("\n") if "emit(" in line]
    return [(line[:12], line) for line in lines], None


def _called(text: str) -> tuple[str, str, str] | None:
    """An own cut of functions: what stands between the first opening and the last closing bracket."""
    first, last = text.find("("), text.rfind(")")
    return (text[:first + 1], text[first + 1:last], text[last:]) if 0 <= first < last else None


CALLS = CodeType("calls", "Calls", (".c", ".cpp", ".cc"), (), (".o.c",), extract=_lines_of, split=_marked_lines, parts=_called)


@query
def own_type_functions(spark, sf_dir):
    """Both sides of an own type with its own rules for marked files and its own cut of functions."""
    functions = read_functions(X.code_files(spark, sf_dir), [CALLS]).where(F.col("side") == "decompiled")
    return functions.select("path", "code_type", "pos", "name", "head", "body", "tail")


@query
def own_type_tree(spark, sf_dir):
    """Marked files of an own type through a model: only what its cut calls the body changes."""
    files = X.marked_files(spark, sf_dir).select("rel_path", "content")
    done = transform.transform_tree(files, stand_in_model, [CALLS])
    return done.select("rel_path", "part", F.decode("content", "UTF-8").alias("content"))


# Scans, sources, sinks.

@query
def scan_files(spark, sf_dir):
    root = scratch(spark, "tree")
    X.table(spark, sf_dir, "documents").select("source", "text").write.partitionBy("source").text(root)
    # The writer's own check-sum files are files of the tree too.
    written = file_source.list_files(spark, root, "docs").where(F.endswith("file_name", F.lit(".txt")))
    scanned = file_source.read_text(file_source.with_content(file_source.skip_empty_files(written)))
    return scanned.groupBy("repo", "artifact").agg(
        F.sum(F.length("text")).alias("chars"),
        F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("newlines"),
        F.sum("length").alias("bytes"),
    )


def _written_tree(spark, sf_dir) -> str:
    """Source and marked files and pages as files of a tree."""
    root = scratch(spark, "tree")
    files = X.code_files(spark, sf_dir).select("rel_path", "content").unionByName(_page_files(spark, sf_dir))
    file_tree.write_tree_files(files.withColumn("part", F.lit(0)), root)
    return root


@query
def tree_scan(spark, sf_dir):
    """A listing that gets depth, ending and length as pushed filters."""
    tree = file_tree.read_tree(spark, _written_tree(spark, sf_dir), "docs")
    wanted = (F.col("depth") <= 3) & F.col("ending").isin(".cpp", ".cc", ".html") & (F.col("length") > 2000)
    return tree.where(wanted).select("repo", "artifact", "rel_path", "depth", "length")


@query
def tree_sink(spark, sf_dir):
    """Every file of a written tree, read back."""
    tree = file_tree.read_tree(spark, _written_tree(spark, sf_dir))
    files = tree.where(F.col("problem").isNull()).select("artifact", "path", "rel_path", "file_name", "length")
    return file_source.read_text(file_source.with_content(files)).select("rel_path", "length", "text")


def _page_paths(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_replace("url", "^https?://", "").alias("rel_path")
    )


@query
def scan_files_depth(spark, sf_dir):
    return file_source.scan_files_depth(_page_paths(spark, sf_dir), 3)


@query
def derive_artifact(spark, sf_dir):
    return file_source.derive_artifact(_page_paths(spark, sf_dir)).select("page_id", "rel_path", "artifact")


@query
def classify_files(spark, sf_dir):
    return _classified(spark, sf_dir).select("path", "code_type", "side", "suffix")


@query
def skip_empty_files(spark, sf_dir):
    content = F.when(F.col("n_chars") % 10 == 0, "").otherwise(F.col("text"))
    files = X.table(spark, sf_dir, "documents").select(
        X.marked_path().alias("path"), F.octet_length(content).cast("long").alias("length")
    )
    return file_source.skip_empty_files(files)


@query
def decode_lossy(spark, sf_dir):
    content = F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8"), F.unhex(F.lit("E282")),
                       F.encode("source", "UTF-8"), F.unhex(F.lit("C3")))
    return X.table(spark, sf_dir, "documents").select("doc_id", T.decode_lossy(content).alias("text"))


@query
def write_examples(spark, sf_dir):
    path = scratch(spark, "examples")
    example_files.write_examples(build_examples(X.code_files(spark, sf_dir), BOTH), path)
    return spark.read.parquet(path).groupBy("code_type").agg(
        F.count("*").alias("n"), F.sum("sort_len").alias("sum_len"),
        F.sum(F.length("source") + F.length("decompiled")).alias("chars"),
    )


@query
def read_examples(spark, sf_dir):
    path = scratch(spark, "examples")
    example_files.write_examples(build_examples(X.code_files(spark, sf_dir)), path, force=True)
    saved = example_files.read_examples(spark, path)
    return _example_columns(saved)


def _decompiled_functions(spark, sf_dir):
    return X.lines(spark, sf_dir).select(
        "artifact", "path", "pos", F.expr(X.marker_name("line")).alias("name"),
        F.expr(X.decompiled_function("line", truncated=True)).alias("text"),
    )


@query
def build_marked_files(spark, sf_dir):
    return tree_source.build_marked_files(_decompiled_functions(spark, sf_dir))


@query
def write_tree(spark, sf_dir):
    path = scratch(spark, "tree")
    tree_source.write_tree(transform.reassemble(X.segments(spark, sf_dir)), path)
    return spark.read.parquet(path).select("rel_path", "part", "content")


def _listing(spark, sf_dir, name, key, label):
    return X.table(spark, sf_dir, name).select(
        F.col(key).cast("long").alias("line_no"), F.col(label).alias("package")
    )


@query
def union_repos(spark, sf_dir):
    return file_source.union_repos({
        "apt": _listing(spark, sf_dir, "part", "p_partkey", "p_name"),
        "vcpkg": _listing(spark, sf_dir, "supplier", "s_suppkey", "s_name"),
        "conan": _listing(spark, sf_dir, "customer", "c_custkey", "c_name"),
    }).select("repo", "line_no", "package")


# Projections and scalars.

@query
def split_marked_functions(spark, sf_dir):
    return markers.split_marked_functions(_marked_text(spark, sf_dir)).select("path", "pos", "name", "text")


@query
def split_function(spark, sf_dir):
    functions = markers.split_marked_functions(_marked_text(spark, sf_dir))
    return functions.withColumn("_s", T.split_function("text")).select(
        "path", "pos", "_s.head", "_s.body", "_s.tail"
    )


@query
def has_body(spark, sf_dir):
    pages = X.table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"),
                                                   F.col("html").alias("text"))
    docs = X.table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"),
                                                      "text")
    return pages.unionByName(docs).select("kind", "id", T.has_body("text").alias("has_body"))


@query
def function_id(spark, sf_dir):
    return X.lines(spark, sf_dir).select(
        "doc_id", "pos", T.function_id("path", F.expr(X.marker_name("line"))).alias("function_id")
    )


@query
def is_blank(spark, sf_dir):
    spaces = F.lit(" \t\r\n\u001c\u0085\u00a0\u2003\u3000")
    zero_width = F.lit("\u200b")
    text = F.when(F.length("line") % 17 == 0, spaces).when(F.length("line") % 19 == 0, zero_width).otherwise(
        F.col("line")
    )
    return X.lines(spark, sf_dir).select("doc_id", "pos", T.is_blank(text).alias("blank"))


@query
def drop_truncated(spark, sf_dir):
    kept, rejects = markers.drop_truncated(_decompiled_functions(spark, sf_dir))
    return kept.select("path", "pos", "name", F.lit("kept").alias("reason")).unionByName(
        rejects.select("path", "pos", F.col("detail").alias("name"), "reason")
    )


@query
def output_path(spark, sf_dir):
    return _classified(spark, sf_dir).where(F.col("side") == "decompiled").select(
        "path", "code_type", T.output_path("path", "suffix", F.lit(".c")).alias("out_path")
    )


@query
def decompiled_path(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select(
        "doc_id", T.decompiled_path(X.object_path()).alias("path")
    )


@query
def render_examples(spark, sf_dir):
    rendered = dataset.render_examples(_examples(spark, sf_dir))
    return rendered.select(F.col("idx").cast("long").alias("idx"), "rendered")


@query
def render_repeats(spark, sf_dir):
    """Every example given twice."""
    examples = _examples(spark, sf_dir)
    rendered = dataset.render_examples(examples.unionByName(examples))
    return rendered.select(F.col("idx").cast("long").alias("idx"), "rendered")


# Extraction.

@query
def extract_functions(spark, sf_dir):
    functions, _ = extract.extract_functions(_source_text(spark, sf_dir))
    return functions.select("path", "pos", "name", "text")


@query
def multi_capture_functions(spark, sf_dir):
    captures = X.lines(spark, sf_dir).select(
        "path", "pos", F.when((F.col("pos") == 0) | (F.length("line") % 3 == 0), "fn").otherwise("fn_name")
        .alias("kind"), F.col("line").alias("text"),
    )
    return extract.multi_capture_functions(captures)


@query
def extract_includes(spark, sf_dir):
    return includes.extract_includes(X.header_files(spark, sf_dir))


LIBRARY_DIRS = ("lib/include", "tree/src0", "tree/src1", "tree/src7")


def _resolved(spark, sf_dir, child_depth=0):
    headers = X.header_files(spark, sf_dir)
    return includes.resolve_includes(
        includes.extract_includes(headers), headers.select("path"), LIBRARY_DIRS, child_depth
    )


@query
def resolve_includes(spark, sf_dir):
    return _resolved(spark, sf_dir)


@query
def resolve_includes_children(spark, sf_dir):
    return _resolved(spark, sf_dir, child_depth=1)


def _closure(spark, sf_dir):
    roots = X.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path")
    )
    return includes.include_closure(X.include_edges(spark, sf_dir), roots)


@query
def include_closure(spark, sf_dir):
    return _closure(spark, sf_dir)


@query
def include_closure_hops(spark, sf_dir):
    roots = X.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path")
    )
    return includes.include_closure(X.include_edges(spark, sf_dir), roots, max_hops=2)


@query
def functions_with_imports(spark, sf_dir):
    functions = X.lines(spark, sf_dir).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "pos",
        F.expr(X.decompiled_name("line")).alias("name"),
    )
    joined = includes.functions_with_imports(functions, _closure(spark, sf_dir))
    return joined.select("path", "def_path", "pos", "imported", T.function_id("path", "name").alias("function_id"))


# Joins and set operations.

@query
def dedupe_source(spark, sf_dir):
    return _side(spark, sf_dir, True).select(*pairing.KEY, "body", F.col("seq.path").alias("seq_path"),
                                           F.col("seq.pos").alias("seq_pos"))


@query
def dedupe_decompiled(spark, sf_dir):
    return _side(spark, sf_dir, False).select(*pairing.KEY, "body", F.col("seq.path").alias("seq_path"),
                                           F.col("seq.pos").alias("seq_pos"))


@query
def pair_examples(spark, sf_dir):
    return _example_columns(pairing.pair_examples(*_sides(spark, sf_dir)))


def _two_sides(functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (pairing.dedupe_source(functions.where(F.col("side") == "source")),
            pairing.dedupe_decompiled(functions.where(F.col("side") == "decompiled")))


def _two_repos(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The same artifacts in two repos: functions at even and at odd places of their files."""
    return _two_sides(read_functions(X.code_files(spark, sf_dir)).withColumn(
        "repo", F.concat(F.lit("r"), (F.col("pos") % 2).cast("string"))))


@query
def pair_examples_repos(spark, sf_dir):
    return pairing.pair_examples(*_two_repos(spark, sf_dir)).select(
        "repo", "artifact", "code_type", "ident", "source", "decompiled")


def _no_artifact(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Functions at every fourth place belong to no artifact."""
    return _two_sides(read_functions(X.code_files(spark, sf_dir)).withColumn(
        "artifact", F.when(F.col("pos") % 4 != 0, F.col("artifact"))))


@query
def pair_examples_nulls(spark, sf_dir):
    return pairing.pair_examples(*_no_artifact(spark, sf_dir)).select(
        "artifact", "code_type", "ident", "source", "decompiled")


@query
def missing_report_nulls(spark, sf_dir):
    report = pairing.missing_report(*_no_artifact(spark, sf_dir)).drop("repo")
    return report.withColumn("sample", F.array_join("sample", " "))


@query
def missing_sources(spark, sf_dir):
    return pairing.missing_sources(*_sides(spark, sf_dir)).drop("repo")


@query
def missing_decompileds(spark, sf_dir):
    return pairing.missing_decompileds(*_sides(spark, sf_dir)).drop("repo")


@query
def missing_report(spark, sf_dir):
    return pairing.missing_report(*_sides(spark, sf_dir)).drop("repo").withColumn("sample", F.array_join("sample", " "))


def _pairs(spark, sf_dir):
    sides = match_sides(read_functions(X.code_files(spark, sf_dir)))
    return sides.where(F.col("source").isNotNull() & F.col("decompiled").isNotNull()).withColumnRenamed(
        "function_id", "ident"
    )


@query
def drop_half_blank(spark, sf_dir):
    return _example_columns(pairing.drop_half_blank(_pairs(spark, sf_dir)))


@query
def half_blank_report(spark, sf_dir):
    return pairing.half_blank_report(_pairs(spark, sf_dir)).drop("repo")


@query
def union_code_types(spark, sf_dir):
    files = X.code_files(spark, sf_dir)
    examples = materialize(build_examples(files, BOTH))
    parts = [dataset.limit_code_types(examples, ct) for ct in BOTH]
    return _example_columns(pairing.union_code_types(parts))


@query
def distinct_artifacts(spark, sf_dir):
    return pairing.distinct_artifacts(_classified(spark, sf_dir))


# Filters, slices, sorts, splits.

@query
def limit_code_types(spark, sf_dir):
    return _example_columns(dataset.limit_code_types(build_examples(X.code_files(spark, sf_dir), BOTH), "c"))


@query
def limit_count(spark, sf_dir):
    small = dataset.limit_count(_examples(spark, sf_dir), 300, 100)
    return small.select("artifact", "code_type", "ident")


@query
def limit_count_large(spark, sf_dir):
    large = dataset.limit_count(_examples(spark, sf_dir), 3000, 1500)
    return large.select("artifact", "code_type", "ident")


def _holes(spark, sf_dir):
    """A set with nulls in its order keys."""
    return X.table(spark, sf_dir, "documents").select(
        F.when(F.col("n_chars") % 3 != 0, F.col("source")).alias("artifact"),
        F.when(F.col("n_chars") % 5 != 0, F.col("lang")).alias("code_type"), F.col("doc_id").alias("ident"),
        F.struct(F.lit("p").alias("path"), F.lit(0).alias("pos")).alias("seq"),
    )


@query
def limit_count_nulls(spark, sf_dir):
    return dataset.limit_count(_holes(spark, sf_dir), 100, 20).drop("seq")


@query
def split_off_end_nulls(spark, sf_dir):
    left, right = dataset.split_off_end(_holes(spark, sf_dir), 0.3)
    return left.withColumn("part", F.lit("left")).unionByName(right.withColumn("part", F.lit("right"))).drop("seq")


def _ties(spark, sf_dir):
    """A set of few different rows, each repeated many times."""
    return X.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("artifact"), F.col("l_linestatus").alias("code_type"),
        F.col("l_linenumber").alias("ident"), F.struct(F.lit("p").alias("path"), F.lit(0).alias("pos")).alias("seq"))


@query
def limit_count_ties(spark, sf_dir):
    return dataset.limit_count(_ties(spark, sf_dir), 2000, 777).drop("seq")


@query
def split_off_end_ties(spark, sf_dir):
    left, right = dataset.split_off_end(_ties(spark, sf_dir), 0.37)
    return left.withColumn("part", F.lit("left")).unionByName(right.withColumn("part", F.lit("right"))).drop("seq")


def _new_ids(spark, sf_dir):
    return pairing.new_ids_per_file(read_functions(X.code_files(spark, sf_dir), BOTH))


@query
def soft_cap_files(spark, sf_dir):
    return dataset.soft_cap_files(_new_ids(spark, sf_dir), 150).drop("repo")


@query
def artifact_cutoff(spark, sf_dir):
    return dataset.artifact_cutoff(_examples(spark, sf_dir), 1000).select("artifact", "code_type", "ident")


@query
def seeded_shuffle(spark, sf_dir):
    shuffled = dataset.seeded_shuffle(_examples(spark, sf_dir), 7)
    return dataset.with_position(shuffled).select("idx", "artifact", "ident", dataset.SHUFFLE_KEY)


def _numbered_documents(spark, sf_dir) -> tuple[DataFrame, int]:
    examples = X.table(spark, sf_dir, "documents").select(
        F.col("source").alias("artifact"), F.lit("cpp").alias("code_type"), F.col("doc_id").alias("ident"),
        F.struct(F.col("lang").alias("path"), F.lit(0).alias("pos")).alias("seq"))
    numbered = materialize(dataset.with_position(examples))
    return numbered, numbered.count()


@query
def permuted_positions(spark, sf_dir):
    """Every place of the shuffled order, and whether the way back leads to the rank it came from."""
    numbered, n = _numbered_documents(spark, sf_dir)
    place = numbered.select("idx", dataset.permuted(F.col("idx"), n, 7).alias("place"))
    return place.select("place", (dataset.permuted(F.col("place"), n, 7, inverse=True) == F.col("idx")).alias("back"))


@query
def shuffled_slices(spark, sf_dir):
    """The shuffled set in three slices: every document once, at a place of its slice."""
    numbered, n = _numbered_documents(spark, sf_dir)
    slices = [dataset.shuffled_slice(numbered, n, 11, 60, 60 * k) for k in (0, 1)]
    slices.append(dataset.shuffled_slice(numbered, n, 11, n, 120))
    return reduce(DataFrame.unionByName, slices).select("ident", (F.col("place") < n).alias("inside"))


@query
def split_off_end(spark, sf_dir):
    left, right = dataset.split_off_end(_examples(spark, sf_dir), 0.7)
    columns = ["artifact", "code_type", "ident"]
    return left.select(*columns, F.lit("left").alias("part")).unionByName(
        right.select(*columns, F.lit("right").alias("part"))
    )


@query
def train_eval_split(spark, sf_dir):
    examples = _examples(spark, sf_dir, BOTH)
    train, held_out = dataset.train_eval_split(examples, eval=0.8, code_types="cpp", count=2500)
    columns = ["artifact", "code_type", "ident"]
    return train.select(*columns, F.lit("train").alias("part")).unionByName(
        held_out.select(*columns, F.lit("eval").alias("part"))
    )


@query
def sort_by_length(spark, sf_dir):
    ordered = dataset.sort_by_length(_examples(spark, sf_dir))
    return dataset.with_position(ordered).select("idx", "artifact", "ident", dataset.SORT_LENGTH)


@query
def inspect_examples(spark, sf_dir):
    return dataset.inspect_examples(_examples(spark, sf_dir, BOTH), "c,cpp", count=50, skip=10, seed=42)


# Aggregations.

@query
def repo_profile(spark, sf_dir):
    return pairing.repo_profile(_classified(spark, sf_dir))


@query
def new_ids_per_file(spark, sf_dir):
    return _new_ids(spark, sf_dir).drop("repo")


@query
def examples_per_artifact(spark, sf_dir):
    return pairing.examples_per_artifact(build_examples(X.code_files(spark, sf_dir), BOTH).drop("repo"))


@query
def examples_per_artifact_repos(spark, sf_dir):
    return pairing.examples_per_artifact(pairing.pair_examples(*_two_repos(spark, sf_dir)))


def _objects(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select(
        "doc_id", X.object_path().alias("path")
    )


def _labelled_objects(spark, sf_dir):
    return _objects(spark, sf_dir).join(X.table(spark, sf_dir, "labels"), "doc_id")


@query
def worklist_progress(spark, sf_dir):
    labelled = _labelled_objects(spark, sf_dir)
    done = labelled.where(F.col("quality") == 1).select(T.decompiled_path("path").alias("path"))
    return worklist.worklist_progress(_objects(spark, sf_dir), labelled, done)


def _packages(spark, sf_dir):
    return X.table(spark, sf_dir, "customer").select(
        F.lit("main").alias("repo"), F.col("c_custkey").alias("line_no"),
        F.col("c_custkey").cast("string").alias("package"), F.lit(None).cast("string").alias("version"),
    )


@query
def ledger_success_count(spark, sf_dir):
    return worklist.ledger_success_count(_packages(spark, sf_dir), X.ledger(spark, sf_dir))


@query
def ledger_success_running(spark, sf_dir):
    return worklist.ledger_success_count(_packages(spark, sf_dir), X.ledger(spark, sf_dir), running=True)


def _predictions(spark, sf_dir):
    return X.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ident"), F.col("l_linenumber").alias("pos"),
        (F.col("l_partkey") % 3).cast("int").alias("pred_id"), (F.col("l_quantity") % 3).cast("int").alias("label_id"),
    )


def _rounded(accuracy: DataFrame) -> DataFrame:
    return accuracy.select(F.round("accuracy", 9).alias("accuracy"), F.round("micro_accuracy", 9)
                           .alias("micro_accuracy"), "examples")


@query
def token_accuracy(spark, sf_dir):
    return _rounded(encode.token_accuracy(_predictions(spark, sf_dir)))


@query
def token_accuracy_masked(spark, sf_dir):
    return _rounded(encode.token_accuracy(_predictions(spark, sf_dir), mask_pad=True))


@query
def token_accuracy_logits(spark, sf_dir):
    return _rounded(encode.token_accuracy(X.table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 50).alias("ident"), F.col("vec_id").alias("pos"), F.col("embedding").alias("logits"),
        F.col("label").alias("label_id"),
    )))


# Worklists.

def _part_lines(spark, sf_dir, line: Column):
    return X.table(spark, sf_dir, "part").select(
        F.lit("listing").alias("repo"), F.col("p_partkey").alias("line_no"), line.alias("line")
    )


def _dashed() -> Column:
    return F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.col("p_partkey").cast("string"), F.lit(" - "),
                    "p_brand")


@query
def list_packages(spark, sf_dir):
    return worklist.list_packages(_part_lines(spark, sf_dir, _dashed()), 500).select("repo", "line_no", "package")


@query
def list_packages_drop_last(spark, sf_dir):
    return worklist.list_packages_drop_last(_part_lines(spark, sf_dir, _dashed())).select(
        "repo", "line_no", "package"
    )


@query
def latest_per_package(spark, sf_dir):
    line = F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string"))
    return worklist.latest_per_package(_part_lines(spark, sf_dir, line), n=50).select(
        "repo", "line_no", "package", "version"
    )


def _typed_lines(spark, sf_dir, line: Column):
    return X.table(spark, sf_dir, "part").select(
        F.col("p_type").alias("repo"), F.col("p_partkey").alias("line_no"), line.alias("line"))


@query
def list_packages_repos(spark, sf_dir):
    """A listing per repo, each with its own trailing line."""
    return worklist.list_packages_drop_last(_typed_lines(spark, sf_dir, _dashed()), 40).select("repo", "line_no", "package")


@query
def latest_per_package_repos(spark, sf_dir):
    line = F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string"))
    return worklist.latest_per_package(_typed_lines(spark, sf_dir, line), n=20).select(
        "repo", "line_no", "package", "version")


@query
def cap_per_repo(spark, sf_dir):
    packages = X.table(spark, sf_dir, "part").select(
        F.col("p_type").alias("repo"), F.col("p_partkey").alias("line_no"), F.col("p_name").alias("package")
    )
    return worklist.cap_per_repo(packages, 30)


@query
def resume_worklist(spark, sf_dir):
    return worklist.resume_worklist(_packages(spark, sf_dir), X.ledger(spark, sf_dir)).select(
        "repo", "line_no", "package"
    )


@query
def artifact_worklist(spark, sf_dir):
    artifacts = _packages(spark, sf_dir).select("repo", "package")
    ledger = X.ledger(spark, sf_dir)
    plain = worklist.artifact_worklist(artifacts, ledger)
    both = worklist.artifact_worklist(artifacts, ledger, skip_failures=True)
    redo = worklist.artifact_worklist(artifacts, ledger, skip_successes=False)
    return (
        plain.withColumn("mode", F.lit("default"))
        .unionByName(both.withColumn("mode", F.lit("skip_failures")))
        .unionByName(redo.withColumn("mode", F.lit("redo")))
    )


@query
def file_worklist(spark, sf_dir):
    done = _labelled_objects(spark, sf_dir).select(T.decompiled_path("path").alias("path"))
    return worklist.file_worklist(_objects(spark, sf_dir), done).select("doc_id", "path")


@query
def classify_outcome(spark, sf_dir):
    runs = X.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("repo"), F.col("o_orderkey").cast("string").alias("package"),
        (F.col("o_custkey") % 200 - 50).alias("code"), F.col("o_orderdate").cast("timestamp").alias("ts"),
    ).select("repo", "package", F.greatest("code", F.lit(0)).alias("exit_code"), "ts")
    outcomes = worklist.classify_outcome(runs)
    path = scratch(spark, "ledger")
    worklist.append_ledger(outcomes, path)
    written = spark.read.parquet(path).select("repo", "package", "status", F.lit(False).alias("abort"))
    return written.unionByName(outcomes.where("abort").select("repo", "package", "status", "abort"))


# Encoding.

def _texts(spark, sf_dir):
    return X.documents(spark, sf_dir).select(F.col("doc_id").alias("ident"), "text")


VOCAB_SIZE = 2000


@query
def build_vocab(spark, sf_dir):
    return encode.build_vocab(_texts(spark, sf_dir), ["text"], VOCAB_SIZE)


def _vocabulary(spark, sf_dir):
    return materialize(encode.build_vocab(_texts(spark, sf_dir), ["text"], VOCAB_SIZE))


def _tokenized(spark, sf_dir, lookup: bool):
    return encode.tokenize(_texts(spark, sf_dir), "text", _vocabulary(spark, sf_dir), lookup=lookup)


@query
def tokenize(spark, sf_dir):
    return _tokenized(spark, sf_dir, True).select("ident", _joined("input_ids").alias("input_ids"))


@query
def tokenize_by_join(spark, sf_dir):
    return _tokenized(spark, sf_dir, False).select("ident", _joined("input_ids").alias("input_ids"))


@query
def pad_longest(spark, sf_dir):
    ids = materialize(_tokenized(spark, sf_dir, True))
    whole = encode.pad_longest(ids).withColumn("mode", F.lit("longest"))
    bucketed = encode.pad_longest(ids, bucket=64).withColumn("mode", F.lit("bucket"))
    return whole.unionByName(bucketed).select(
        "mode", "ident", _joined("input_ids").alias("input_ids"), _joined("attention_mask").alias("attention_mask")
    )


def _encoded(spark, sf_dir, lookup: bool):
    return encode.encode_dataset(_examples(spark, sf_dir), VOCAB_SIZE, lookup=lookup).select(
        "artifact", "code_type", "ident", _joined("input_ids").alias("input_ids"),
        _joined("attention_mask").alias("attention_mask"), _joined("labels").alias("labels"),
    )


@query
def encode_dataset(spark, sf_dir):
    return _encoded(spark, sf_dir, True)


@query
def encode_by_join(spark, sf_dir):
    return _encoded(spark, sf_dir, False)


def _decoded(spark, sf_dir, lookup: bool):
    vocab = _vocabulary(spark, sf_dir)
    ids = materialize(encode.tokenize(_texts(spark, sf_dir), "text", vocab, lookup=True))
    return encode.decode_tokens(ids, "input_ids", vocab, lookup=lookup)


@query
def decode_tokens(spark, sf_dir):
    return _decoded(spark, sf_dir, True)


@query
def decode_by_join(spark, sf_dir):
    return _decoded(spark, sf_dir, False)


def word_lengths(texts: pd.Series) -> list[list[int]]:
    """Deterministic stand-in for a caller's tokenizer: a word's id is its length."""
    return [[len(w) for w in text.split(" ") if w] for text in texts]


def words_of_lengths(ids: pd.Series) -> list[str]:
    return [" ".join("x" * i for i in row) for row in ids]


@query
def tokenize_with(spark, sf_dir):
    ids = encode.tokenize_with(_texts(spark, sf_dir), "text", word_lengths, max_len=64)
    return ids.select("ident", _joined("input_ids").alias("input_ids"))


@query
def decode_with(spark, sf_dir):
    ids = encode.tokenize_with(_texts(spark, sf_dir), "text", loader=lambda: word_lengths, max_len=64)
    return encode.decode_with(ids, "input_ids", words_of_lengths)


# Batch transformation.

@query
def segment_files(spark, sf_dir):
    functions, _ = extract.extract_functions(_marked_text(spark, sf_dir))
    return transform.segment_files(functions).select("rel_path", "pos", F.col("kind").cast("int").alias("kind"), "text")


@query
def apply_model(spark, sf_dir):
    return transform.apply_model(X.segments(spark, sf_dir), stand_in_model).select(
        "rel_path", "pos", F.col("kind").cast("int").alias("kind"), "text"
    )


@query
def reassemble(spark, sf_dir):
    return transform.reassemble(X.segments(spark, sf_dir))


def _page_files(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("html/p"), F.col("page_id").cast("string"), F.lit(".html")).alias("rel_path"),
        F.encode("html", "UTF-8").alias("content"),
    )


def _mixed_tree(spark, sf_dir):
    """Source and marked files, an object file per document and a page per page."""
    code = X.code_files(spark, sf_dir).select("rel_path", "content")
    objects = _objects(spark, sf_dir).select(F.col("path").alias("rel_path"), F.unhex(F.lit("7F454C46")).alias("content"))
    return code.unionByName(objects).unionByName(_page_files(spark, sf_dir))


@query
def transform_raw(spark, sf_dir):
    files = X.code_files(spark, sf_dir)
    done = transform.transform_raw(files, stand_in_model)
    return done.select("rel_path", "part", F.decode("content", "UTF-8").alias("content"))


@query
def plan_tree(spark, sf_dir):
    names = [X.file_names(spark, sf_dir).select("rel_path"), _objects(spark, sf_dir).select(F.col("path").alias("rel_path")),
             _page_files(spark, sf_dir).select("rel_path")]
    return transform.plan_tree(reduce(DataFrame.unionByName, names), BOTH, count=150)


@query
def transform_tree(spark, sf_dir):
    done = transform.transform_tree(_mixed_tree(spark, sf_dir), stand_in_model)
    return done.select("rel_path", "part", F.decode("content", "UTF-8").alias("content"))


@query
def transform_tree_gaps(spark, sf_dir):
    """A model that changes nothing, with the text between functions kept: every file as it was."""
    files = X.files_with_headers(spark, sf_dir).select("rel_path", "content")
    done = transform.transform_tree(files, lambda texts: texts, gaps=True)
    return done.select("rel_path", "part", F.decode("content", "UTF-8").alias("content"))


def _stored_runs(spark, sf_dir):
    """Two runs with one store: the conversations with even numbers, then all; the segments, and the calls of each run."""
    store = scratch(spark, "answers")
    segments = X.segments(spark, sf_dir)
    even = segments.where(F.col("rel_path").cast("long") % 2 == 0)
    transform.apply_model_once(even, store, "stand in/1", stand_in_model, slices=2)
    first = transform.model_answers(spark, store, "stand in/1").count()
    done = transform.apply_model_once(segments, store, "stand in/1", stand_in_model)
    return done, [(1, first), (2, transform.model_answers(spark, store, "stand in/1").count() - first)]


@query
def model_store(spark, sf_dir):
    return _stored_runs(spark, sf_dir)[0].select("rel_path", "pos", F.col("kind").cast("int").alias("kind"), "text")


@query
def model_store_calls(spark, sf_dir):
    return spark.createDataFrame(_stored_runs(spark, sf_dir)[1], "run int, calls long")


# Streaming.

@query
def watch_ledger(spark, sf_dir):
    root = scratch(spark, "watch")
    (
        X.ledger(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
        .repartitionByRange(4, "ts").write.parquet(f"{root}/ledger")
    )

    def process(packages: DataFrame, batch_id: int) -> None:
        packages.select("repo", "package").write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    stream = start_watch(spark, f"{root}/ledger", process, f"{root}/state", files_per_batch=1)
    stream.awaitTermination()
    return spark.read.schema("repo string, package string").parquet(f"{root}/out").select("repo", "package")


@query
def watch_build(spark, sf_dir):
    """Examples kept by a watch over the ledger of artifacts, in one batch and in eight."""
    ledger = scratch(spark, "ledger")
    X.artifact_ledger(spark, sf_dir).repartitionByRange(8, "package").write.parquet(ledger)

    def files(changed: DataFrame) -> DataFrame:
        return X.code_files(spark, sf_dir, changed)

    kept = []
    for files_per_batch in (8, 1):
        root = scratch(spark, "watch")
        process = maintain.example_keeper(files, f"{root}/examples")
        start_watch(spark, ledger, process, f"{root}/state", files_per_batch=files_per_batch).awaitTermination()
        kept.append(maintain.read_maintained(spark, f"{root}/examples").select(
            F.lit(8 // files_per_batch).alias("batches"), "artifact", "code_type", "ident", "source", "decompiled"))
    return kept[0].unionByName(kept[1])


@query
def ledger_snapshot(spark, sf_dir):
    """Newest status from a snapshot of a snapshot, and the entries after it."""
    root, entries = scratch(spark, "ledger"), X.ledger(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(4):
        ledger_store.append_entries(entries.where(F.pmod(F.unix_seconds("ts"), F.lit(4)) == k), root)
        if k in (1, 2):
            ledger_store.compact(spark, root)
    ledger_store.vacuum(spark, root, keep=1)
    return ledger_store.newest_entries(spark, root).select("repo", "package", "status")


@query
def marker_ledger(spark, sf_dir):
    """Status markers written from the events and drained as a stream of ledger entries."""
    root = scratch(spark, "markers")
    status_markers.write_markers(X.ledger(spark, sf_dir), f"{root}/stats")
    entries = status_markers.marker_stream(spark, f"{root}/stats", "main", lag=0)
    entries.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).format("parquet") \
        .start(f"{root}/entries").awaitTermination()
    return spark.read.schema("repo string, package string, status string").parquet(f"{root}/entries")
