"""Corpus shapes derived from the given tables: every row and every line of text takes part.

The Spark formulas here and the SQL in ``oracles`` state the same rules independently.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.text import MARKER_PREFIX, TRUNCATION_WARNING, file_name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


REPO = "docs"


def documents(spark: SparkSession, sf_dir: str, changed: DataFrame | None = None) -> DataFrame:
    """The documents, dealt by id: a small table is one scan task, and rendering a corpus needs all cores. With
    ``changed`` (repo, artifact) only those of these artifacts, chosen before any text is moved."""
    docs = table(spark, sf_dir, "documents")
    if changed is not None:
        wanted = changed.where(F.col("repo") == REPO).select(F.col("artifact").alias("_artifact"))
        docs = docs.join(wanted, docs["source"].eqNullSafe(wanted["_artifact"]), "left_semi")
    return docs.repartition("doc_id")


def _word(line: str) -> str:
    return f"regexp_extract({line}, '^[A-Za-z]+', 0)"


def _name(line: str) -> str:
    return _named(_word(line))


def _named(word: str) -> str:
    return f"concat('do_', coalesce(nullif({word}, ''), 'anon'))"


def _quoted(line: str) -> str:
    return rf"""concat('emit("', replace(replace({line}, r'\', r'\\'), '"', r'\"'), '");')"""


@dataclass(frozen=True)
class Line:
    """SQL of a line and of what is taken from it."""

    text: str
    length: str
    name: str
    quoted: str


def _line(line: str | Line) -> Line:
    return line if isinstance(line, Line) else Line(line, f"length({line})", _name(line), _quoted(line))


# What both files of a document take from its lines, computed once, and a line of these.
_LINES = (f"transform(split(text, '\\n'), x -> struct(x AS text, length(x) AS length, {_word('x')} AS word, "
          f"{_quoted('x')} AS quoted))")
_PARSED = Line("x.text", "x.length", _named("x.word"), "x.quoted")


def _every(line: Line, n: int, then: str, otherwise: str = "''") -> str:
    return f"if({line.length} % {n} = 0, {then}, {otherwise})"


def source_function(line: str | Line) -> str:
    """A one-line definition; some are local to the source, some have a blank body (their line stays as a comment)."""
    line = _line(line)
    comment = _every(line, 11, f"concat('// ', {line.text}, '\\n')")
    body = _every(line, 11, "' '", f"concat(' ', {line.quoted}, ' ')")
    local = _every(line, 7, "'_local'")
    return f"concat({comment}, 'int ', {line.name}, {local}, '(void) {{', {body}, '}}')"


def decompiled_name(line: str | Line) -> str:
    line = _line(line)
    prefix = _every(line, 5, "'FUN_'")
    return f"concat({prefix}, {line.name})"


def marker_name(line: str | Line) -> str:
    line = _line(line)
    template = _every(line, 13, "'<int>'")
    return f"concat({decompiled_name(line)}, {template})"


def decompiled_function(line: str | Line, truncated: bool = False) -> str:
    """A decompiled function with nested braces; some bodies are blank, some (on request) carry the warning."""
    line = _line(line)
    warning = _every(line, 19, f"'  /* {TRUNCATION_WARNING} */\\n'") if truncated else "''"
    full = f"concat('\\n', {warning}, '  if (ok) {{\\n    ', {line.quoted}, '\\n  }}\\n')"
    body = _every(line, 17, "''", full)
    return f"concat('\\nundefined8 ', {decompiled_name(line)}, '(void)\\n\\n{{', {body}, '}}\\n')"


_STEM = "concat(source, '/d', lpad(cast(doc_id as string), 6, '0'), '/f', lpad(cast((doc_id div 20) % 25 as string), 2, '0'))"


def source_path() -> Column:
    return F.expr(f"concat({_STEM}, case doc_id % 3 when 0 then '.c' when 1 then '.cpp' else '.cc' end)")


def marked_path() -> Column:
    return F.expr(f"concat({_STEM}, '.o.c')")


def object_path() -> Column:
    return F.expr(f"concat({_STEM}, '.o')")


def _files(docs: DataFrame, *files: tuple[Column, Column]) -> DataFrame:
    """The files (path, content) of every document, from one read."""
    made = F.array(*[F.struct(path.alias("path"), F.encode(content, "UTF-8").alias("content")) for path, content in files])
    # The explode keeps the rendering from being repeated in every expression that reads the content.
    rendered = docs.select("source", F.explode(made).alias("_f")).select("source", "_f.path", "_f.content")
    return rendered.select(
        F.lit(REPO).alias("repo"), F.col("source").alias("artifact"), "path", F.col("path").alias("rel_path"),
        file_name("path").alias("file_name"), F.octet_length("content").cast("long").alias("length"), "content",
    )


def _source_file() -> tuple[Column, Column]:
    return source_path(), F.expr(f"array_join(transform(_lines, x -> {source_function(_PARSED)}), '\\n')")


def _marked_file() -> tuple[Column, Column]:
    function = f"concat('{MARKER_PREFIX}', {marker_name(_PARSED)}, '\\n', {decompiled_function(_PARSED)})"
    return marked_path(), F.expr(
        "concat('/* doc ', cast(doc_id as string), ' */\\n', "
        f"array_join(transform(_lines, x -> {function}), ''))"
    )


def _with_lines(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_lines", F.expr(_LINES))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file per document, one function per line."""
    return _files(_with_lines(documents(spark, sf_dir)), _source_file())


def marked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A marked file per document, one function per line."""
    return _files(_with_lines(documents(spark, sf_dir)), _marked_file())


def code_files(spark: SparkSession, sf_dir: str, changed: DataFrame | None = None) -> DataFrame:
    """Both files of every document, or of those of the ``changed`` artifacts."""
    return _files(_with_lines(documents(spark, sf_dir, changed)), _source_file(), _marked_file())


def faulty_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with a brace too many in every tenth source and a function without a body in every tenth marked file."""
    last = F.regexp_extract("path", "/d0*([0-9]+)/", 1).cast("long") % 10
    marked = F.endswith("path", F.lit(".o.c"))
    more = F.when(~marked & (last == 7), "\n}").when(
        marked & (last == 3), f"{MARKER_PREFIX}nobody\nundefined8 nobody(void);\n").otherwise("")
    files = code_files(spark, sf_dir).withColumn("content", F.concat("content", F.encode(more, "UTF-8")))
    return files.withColumn("length", F.octet_length("content").cast("long"))


def files_with_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with a header per document that defines what its source has under a local name only."""
    docs = documents(spark, sf_dir)
    line = f"if(length(x) % 7 = 0, concat('int ', {_name('x')}, '(void) {{ imported(); }}\\n'), '')"
    content = F.expr(f"array_join(transform(split(text, '\\n'), x -> {line}), '')")
    folder = F.substring_index(source_path(), "/", 2)
    headers = _files(docs, (F.concat(folder, F.lit("/h.h")), F.concat(F.lit("/* header */\n"), content)))
    include = F.when(F.endswith("path", F.lit(".o.c")), F.lit("")).otherwise(F.lit('#include "h.h"\n'))
    code = code_files(spark, sf_dir).withColumn("content", F.concat(F.encode(include, "UTF-8"), "content"))
    both = code.unionByName(headers)
    return both.withColumn("length", F.octet_length("content").cast("long"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files by name only."""
    docs = table(spark, sf_dir, "documents")
    paths = docs.select(F.col("source").alias("artifact"), F.explode(F.array(source_path(), marked_path())).alias("path"))
    return paths.select("artifact", "path", F.col("path").alias("rel_path"), file_name("path").alias("file_name"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(artifact, doc_id, path, pos, line) of every line."""
    return documents(spark, sf_dir).select(
        F.col("source").alias("artifact"), "doc_id", marked_path().alias("path"),
        F.posexplode(F.split("text", "\n")).alias("pos", "line"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is an entry: errors are failures of the package named by the user, all other events successes."""
    return table(spark, sf_dir, "events").select(
        F.lit("main").alias("repo"), F.col("user_id").cast("string").alias("package"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), "ts",
    )


def artifact_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as entries of 40 packages, half of them artifacts of the code tree; every sixth package always fails."""
    package = F.col("user_id") % 40
    good = (F.col("event_type") != "error") & (package % 6 != 5)
    return table(spark, sf_dir, "events").select(
        F.lit("docs").alias("repo"), F.concat(F.lit("src"), package.cast("string")).alias("package"),
        F.when(good, "success").otherwise("failed").alias("status"), F.col("ts").cast("timestamp").alias("ts"))


def header_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header per document with include lines to other documents' headers, the text following as comments.

    Document a includes a/3 by a path below the common root, a/2 by its bare name (found only in the same folder),
    and, for some lengths, (7a+3) mod N as a system header.
    """
    docs = documents(spark, sf_dir)
    total = table(spark, sf_dir, "documents").agg(F.count("*")).scalar()
    a = F.col("doc_id")

    def name(doc: Column) -> Column:
        return F.concat(F.lit("h"), doc.cast("string"), F.lit(".h"))

    third, half, far = F.floor(a / 3), F.floor(a / 2), (a * 7 + 3) % total
    text = F.concat(
        F.lit('#include "src'), (third % 20).cast("string"), F.lit("/"), name(third), F.lit('"\n'),
        F.lit('#  include "./'), name(half), F.lit('"\n'),
        F.when(F.col("n_chars") % 10 == 0, F.concat(F.lit("#include <"), name(far), F.lit(">\n"))).otherwise(""),
        F.lit("/* #include <none.h> */\n"),
        F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("// "), x)), "\n"),
    )
    return docs.select(
        F.concat(F.lit("tree/src"), (a % 20).cast("string"), F.lit("/"), name(a)).alias("path"), text.alias("text")
    )


def include_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved edges between documents, cycles included: a to a/3, and for some lengths a to (7a+3) mod N."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    total = docs.agg(F.count("*")).scalar()
    a = F.col("doc_id")
    near = docs.select(a.alias("_a"), F.floor(a / 3).alias("_b"))
    far = docs.where(F.col("n_chars") % 10 == 0).select(a.alias("_a"), ((a * 7 + 3) % total).alias("_b"))
    return near.unionByName(far).select(
        F.concat(F.lit("d"), F.col("_a").cast("string")).alias("path"),
        F.concat(F.lit("d"), F.col("_b").cast("string")).alias("resolved_path"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as segments of a file; system turns pass through."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("rel_path"), F.col("turn").cast("int").alias("pos"),
        F.when(F.col("role") == "system", 1).otherwise(0).cast("byte").alias("kind"), "text",
    )
