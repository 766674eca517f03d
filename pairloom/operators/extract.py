"""Function extraction from source files as a Spark job."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from pairloom.code_types import CODE_TYPES, CodeType, resolve
from pairloom.functions.c_scan import scan_functions
from pairloom.functions.text import has_body, split_function
from pairloom.session import ship_package

_FUNCTION = pa.struct([("name", pa.string()), ("text", pa.string())])
_RESULT = pa.struct([("functions", pa.list_(_FUNCTION)), ("problem", pa.string())])
_RESULT_TYPE = from_arrow_type(_RESULT)


# Characters of input whose results are Python objects at once, whatever the size of a batch.
PIECE_CHARS = 256 * 1024
_MARKED = "/marked"
Extractor = Callable[[str], tuple[list[tuple[str, str]], str | None]]


def built(values: Iterator[tuple[object, int]], kind: pa.DataType) -> pa.Array:
    """An Arrow array of values that come with the size of their input, made piece by piece: lists of dicts take many
    times the room of the texts in them."""
    pieces, waiting, held = [], [], 0
    for value, size in values:
        waiting.append(value)
        held += size
        if held >= PIECE_CHARS:
            pieces.append(pa.array(waiting, kind))
            waiting, held = [], 0
    return pa.concat_arrays([*pieces, pa.array(waiting, kind)])


def _extractor(ct: CodeType) -> Extractor:
    return ct.extract or partial(scan_functions, cpp=ct.language == "cpp")


def scanned(text: Column, language: str | None = None, code_types=None, marked: Column | None = None) -> Column:
    """Struct (functions: array of (name, text) in order, problem) of one file; null text gives null.

    ``language`` is "c" or "cpp"; by default each row's ``code_type`` decides, which is one of ``code_types`` (names or
    types of the caller's, which bring their own rules) or of the registry. Where ``marked`` is true a type's rules for
    marked files count, if it has some.
    """
    if language is None:
        types = {**CODE_TYPES, **{ct.name: ct for ct in resolve(code_types)}}
        kind, rules = F.col("code_type"), {name: _extractor(ct) for name, ct in types.items()}
        own = {name: ct.split for name, ct in types.items() if ct.split}
        if marked is not None and own:
            kind = F.when(marked & kind.isin(list(own)), F.concat(kind, F.lit(_MARKED))).otherwise(kind)
            rules |= {name + _MARKED: split for name, split in own.items()}
    else:
        kind, rules = F.lit(language), {language: partial(scan_functions, cpp=language == "cpp")}

    def found(text: pa.Array, kind: pa.Array) -> Iterator[tuple[dict | None, int]]:
        for content, name in zip(text, kind):
            if not content.is_valid:
                yield None, 0
                continue
            whole = content.as_py()
            try:
                functions, problem = rules[name.as_py()](whole)
            except Exception as error:  # one bad file must not fail the job; it is listed in the rejects
                functions, problem = [], f"failed: {error}"
            yield {"functions": [{"name": n, "text": t} for n, t in functions], "problem": problem}, len(whole)

    def scan(text: pa.Array, kind: pa.Array) -> pa.Array:
        return built(found(text, kind), _RESULT)

    return F.arrow_udf(scan, _RESULT_TYPE)(text, kind)


def function_parts(text: Column, code_types=None) -> Column:
    """Struct (head, body, tail) of a function, null for one without a body; types with ``parts`` cut by themselves."""
    plain = F.when(has_body(text), split_function(text))
    own = {ct.name: ct.parts for ct in resolve(code_types) if ct.parts}
    if not own:
        return plain

    def cut(texts: pa.Array, kinds: pa.Array) -> pa.Array:
        def parts() -> Iterator[tuple[dict | None, int]]:
            for text, kind in zip(texts, kinds):
                whole = text.as_py()
                p = own[kind.as_py()](whole) if whole is not None else None
                yield p and dict(zip(("head", "body", "tail"), p)), len(whole or "")

        return built(parts(), _PARTS)

    mine = F.col("code_type").isin(list(own))
    return F.when(mine, F.arrow_udf(cut, from_arrow_type(_PARTS))(F.when(mine, text), F.col("code_type"))).otherwise(plain)


_PARTS = pa.struct([("head", pa.string()), ("body", pa.string()), ("tail", pa.string())])


def extract_functions(files_text: DataFrame, language: str | None = None, keep_empty: bool = False,
                      code_types=None, marked: bool = False) -> tuple[DataFrame, DataFrame]:
    """Every function definition of each file's ``text``, and the files that were not well formed.

    Filter before this step: nothing can be pushed through it. The two results are separate scans of the input.
    ``keep_empty`` gives files without functions one nameless, empty row. ``marked`` says that the files are marked ones,
    for types with rules of their own for these.
    """
    ship_package(files_text.sparkSession)
    keep = [c for c in files_text.columns if c != "text"]
    scan = scanned(F.col("text"), language, code_types, F.lit(marked))
    rows = files_text.select(*keep, scan.alias("_r"))
    explode = F.posexplode_outer if keep_empty else F.posexplode
    # Exploded where it is made: a named array would be filtered first, and the parser called for that once more.
    found = files_text.select(*keep, explode(scan["functions"]).alias("pos", "_f"))
    functions = found.select(
        *keep,
        F.coalesce("pos", F.lit(0)).alias("pos"),
        F.col("_f.name").alias("name"),
        F.coalesce("_f.text", F.lit("")).alias("text"),
    )
    artifact = F.col("artifact") if "artifact" in keep else F.lit(None).cast("string")
    rejects = rows.where(F.col("_r.problem").isNotNull()).select(
        artifact.alias("artifact"), F.col("path" if "path" in keep else "rel_path").alias("path"),
        F.lit(None).cast("int").alias("pos"), F.lit("extraction").alias("reason"), F.col("_r.problem").alias("detail"),
    )
    return functions, rejects


def multi_capture_functions(captures: DataFrame, block: int = 65_536) -> DataFrame:
    """Pair each captured name with the latest definition before it.

    ``captures``: path, pos, kind ("fn" or "fn_name"), text. Names may outnumber definitions; each extra name repeats
    the latest definition. Positions are handled in blocks, and only the last definition of each block is carried to
    the next ones, so one huge file does not end up in one task.
    """
    blocks = captures.withColumn("_block", F.floor(F.col("pos") / block))
    definition = F.when(F.col("kind") == "fn", F.col("text"))
    last = blocks.where(F.col("kind") == "fn").groupBy("path", "_block").agg(F.max_by("text", "pos").alias("_last"))
    # One row per block that has captures.
    index = blocks.select("path", "_block").distinct().join(last, ["path", "_block"], "left")
    earlier = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = index.select("path", "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    inside = Window.partitionBy("path", "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocks.withColumn("_def", F.last(definition, ignorenulls=True).over(inside))
        .join(carried, ["path", "_block"])
        .where(F.col("kind") == "fn_name")
        .select("path", "pos", F.col("text").alias("name"), F.coalesce("_def", "_carried").alias("text"))
    )
