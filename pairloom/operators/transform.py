"""Batch transformation of file trees with a model given by the caller."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from pairloom.code_types import resolve
from pairloom.functions.text import decode_lossy, file_name, output_path
from pairloom.operators.extract import built, extract_functions, function_parts, scanned
from pairloom.operators.ordering import keys_at, precedes
from pairloom.session import materialize, ship_package
from pairloom.sources.files import hadoop_path
from pairloom.sources.tree import ordered_concat

REGULAR, PASS_THROUGH = 0, 1
SEPARATOR = "\n\n"
TRANSFORM, OVER_COUNT, COPY, UNSUPPORTED = "transform", "copy_over_count", "copy", "unsupported"

Model = Callable[[pd.Series], pd.Series]


def segment_files(functions: DataFrame, code_types=None) -> DataFrame:
    """Extracted functions to ordered segments: head and tail pass through, the body is for the model.

    A function without a body passes through whole. Text between functions is not kept.
    """
    cut = function_parts(F.col("text"), code_types)

    def segment(kind: int, text: Column) -> Column:
        return F.struct(F.lit(kind).cast("byte").alias("kind"), text.alias("text"))

    whole = F.array(segment(PASS_THROUGH, F.col("text")))
    parts = F.array(segment(PASS_THROUGH, F.col("_cut.head")), segment(REGULAR, F.col("_cut.body")),
                    segment(PASS_THROUGH, F.col("_cut.tail")))
    return (
        functions.select("rel_path", F.col("pos").alias("_fn"), "text", cut.alias("_cut"))
        .select("rel_path", "_fn", F.posexplode(F.when(F.col("_cut").isNotNull(), parts).otherwise(whole)).alias("_i", "_s"))
        .select("rel_path", (F.col("_fn") * 3 + F.col("_i")).cast("int").alias("pos"), "_s.kind", "_s.text")
    )


def _cut(texts: pa.Array, functions: pa.Array) -> pa.Array:
    """Per file its segments in order; together they are the file, character for character."""
    return built(_segmented(texts, functions), _SEGMENTS)


def _segmented(texts: pa.Array, functions: pa.Array) -> Iterator[tuple[list[dict] | None, int]]:
    for text, found in ((t.as_py(), f.as_py()) for t, f in zip(texts, functions)):
        if text is None:
            yield None, 0
            continue
        segments, at = [], 0
        for function in found or ():
            # The functions come in the order they stand; one that lies in the one before is part of it.
            start = text.find(function["text"], at)
            first, last = function["text"].find("{"), function["text"].rfind("}")
            if start < 0 or first < 0 or last < first:
                continue
            segments += [(PASS_THROUGH, text[at:start + first + 1]), (REGULAR, text[start + first + 1:start + last])]
            at = start + last
        segments.append((PASS_THROUGH, text[at:]))
        yield [{"kind": kind, "text": part} for kind, part in segments if part or kind == REGULAR], len(text)


_SEGMENTS = pa.list_(pa.struct([("kind", pa.int8()), ("text", pa.string())]))


def segment_whole_files(files_text: DataFrame, code_types=None) -> DataFrame:
    """Files (rel_path, code_type, text) to ordered segments that keep all text: bodies are for the model, everything else,
    also what stands between functions, passes through. Joined with nothing between them they are the file again."""
    ship_package(files_text.sparkSession)
    cut = F.arrow_udf(_cut, from_arrow_type(_SEGMENTS))("text", F.col("_scan.functions"))
    return (
        files_text.select("rel_path", "text", scanned(F.col("text"), code_types=code_types).alias("_scan"))
        .select("rel_path", F.posexplode(cut).alias("pos", "_s")).select("rel_path", "pos", "_s.kind", "_s.text")
    )


def _answers(batch: pd.Series, model: Model) -> pd.Series:
    """The model's answers to the texts of a batch, null for null."""
    wanted = batch.dropna()
    out = pd.Series([None] * len(batch), dtype=object)
    if len(wanted):
        # As objects: a plain list would become an array in which every text takes the room of the longest.
        out[batch.notna().to_numpy()] = pd.Series(list(model(wanted)), dtype=object).to_numpy()
    return out


def _model_column(fn: Model | None, loader: Callable[[], Model] | None, text: Column) -> Column:
    if (fn is None) == (loader is None):
        raise ValueError("give either fn or loader")

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loader() if loader is not None else fn  # loaded once per task, not per batch
        for batch in batches:
            yield _answers(batch, model)

    return run(text)


def apply_model(segments: DataFrame, fn: Model | None = None, *, loader: Callable[[], Model] | None = None,
                spread: bool = True) -> DataFrame:
    """Run the model on REGULAR segments; others keep their text.

    One pass: pass-through text is replaced by null before it would cross to Python, so only model input is sent.
    Running a model costs far more than moving a segment, so segments are spread evenly first; otherwise a file with
    very many functions would be one task's work. ``spread=False`` leaves them where they are.
    """
    regular = F.col("kind") == REGULAR
    placed = segments.repartition("rel_path", "pos") if spread else segments
    answers = placed.withColumn("_answer", _model_column(fn, loader, F.when(regular, F.col("text"))))
    return answers.withColumn("text", F.when(regular, F.col("_answer")).otherwise(F.col("text"))).drop("_answer")


STORED = "text_hash string, answer string"


def model_answers(spark: SparkSession, store: str, model_id: str) -> DataFrame:
    """(text_hash, answer) that the store holds for a model; each text once."""
    path, fs = hadoop_path(spark, f"{store}/{quote(model_id, safe='')}")
    parts = [s.getPath().toString() for s in fs.listStatus(path)] if fs.exists(path) else []
    whole = [part for part in parts if fs.exists(hadoop_path(spark, f"{part}/_SUCCESS")[0])]
    if not whole:
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(*whole).dropDuplicates(["text_hash"])


def apply_model_once(segments: DataFrame, store: str, model_id: str, fn: Model | None = None, *,
                     loader: Callable[[], Model] | None = None, slices: int = 1) -> DataFrame:
    """``apply_model`` with a store of results by (model id, hash of the text): a text that occurs often goes to the model
    once, and one that the store knows not at all.

    New texts are done in ``slices`` by their hash, each stored when it is complete, so a run that was stopped goes on with
    the slices it has not done. A text's hash is its SHA-256. Texts that very many segments share meet their one answer in
    a join that the runtime splits.
    """
    spark = segments.sparkSession
    regular = (F.col("kind") == REGULAR) & F.col("text").isNotNull()
    new = materialize(
        segments.where(regular).select(F.sha2("text", 256).alias("text_hash"), "text")
        .join(model_answers(spark, store, model_id), "text_hash", "left_anti").dropDuplicates(["text_hash"]))
    for k in range(slices):
        part = new.where(F.pmod(F.conv(F.substring("text_hash", 1, 8), 16, 10).cast("long"), F.lit(slices)) == k)
        if not part.isEmpty():
            answers = part.repartition("text_hash").select("text_hash", _model_column(fn, loader, F.col("text")).alias("answer"))
            answers.write.parquet(f"{store}/{quote(model_id, safe='')}/{uuid.uuid4().hex}")
    known = model_answers(spark, store, model_id)
    answered = segments.withColumn("text_hash", F.when(regular, F.sha2("text", 256))).join(known, "text_hash", "left")
    return answered.withColumn("text", F.when(regular, F.col("answer")).otherwise(F.col("text"))).select(
        *[f"`{c}`" for c in segments.columns])


def reassemble(segments: DataFrame, sep: str = SEPARATOR, part_pieces: int | None = None) -> DataFrame:
    """Join the segments of each file in order into (rel_path, part, content)."""
    return ordered_concat(segments, "rel_path", "pos", "text", sep, part_pieces)


def _planned(files: DataFrame, code_types, count: int | None, bytecode: bool) -> DataFrame:
    """Add out_path, action and code_type. They follow from the path alone, so no file content moves for them."""
    match = None
    for ct in resolve(code_types):
        for side, suffixes in (("bytecode", ct.bytecode), ("decompiled", ct.decompiled)):
            for suffix in suffixes:
                hit = F.struct(F.lit(ct.name).alias("code_type"), F.lit(side).alias("side"),
                               F.lit(suffix).alias("suffix"), F.lit(ct.output_suffix).alias("target"))
                test = F.endswith(file_name("rel_path"), F.lit(suffix))
                match = F.when(test, hit) if match is None else match.when(test, hit)
    matched = files.withColumn("_m", match)
    usable = F.col("_m").isNotNull() & (F.lit(bytecode) | (F.col("_m.side") != "bytecode"))
    over = F.lit(False)
    if count is not None:
        order = [F.col("rel_path")]
        first_over = keys_at(matched.where(usable), order, [count])[0]
        if first_over is not None:
            over = ~precedes(order, first_over)
    return matched.select(
        *files.columns,
        F.when(F.col("_m").isNotNull(), output_path("rel_path", F.col("_m.suffix"), F.col("_m.target")))
        .otherwise(F.col("rel_path")).alias("out_path"),
        F.when(F.col("_m").isNull(), COPY).when(~usable, UNSUPPORTED).when(over, OVER_COUNT).otherwise(TRANSFORM)
        .alias("action"),
        F.col("_m.code_type").alias("code_type"),
    )


def plan_tree(files: DataFrame, code_types=None, count: int | None = None, bytecode: bool = False) -> DataFrame:
    """What happens to each file: (rel_path, out_path, action, code_type).

    The first code type with a matching suffix decides. Files beyond the first ``count`` matching ones, in path order,
    are copied under their new name. Object files cannot be segmented and are marked unsupported, unless ``bytecode``.
    """
    return _planned(files.select("rel_path"), code_types, count, bytecode)


def _finish(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Copies and transformed files under their output paths.

    When several inputs map to one output path the last one in path order is kept, as a later write would. Only paths
    are compared; contents are filtered by the (few) losers and stay where they are.
    """
    copies = planned.where(F.col("action").isin(COPY, OVER_COUNT)).select(
        "rel_path", "out_path", F.lit(0).alias("part"), "content"
    )
    # One path can only come from as many inputs as there are suffixes, which bounds the window's groups.
    last = F.max("rel_path").over(Window.partitionBy("out_path"))
    losers = (
        planned.where(F.col("action") != UNSUPPORTED).select("rel_path", last.alias("_last"))
        .where(F.col("rel_path") < F.col("_last")).select("rel_path")
    )
    both = copies.unionByName(done.select("rel_path", "out_path", "part", "content"))
    return both.join(losers, "rel_path", "left_anti").select(F.col("out_path").alias("rel_path"), "part", "content")


def transform_raw(files: DataFrame, fn: Model | None = None, count: int | None = None, code_types=None, *,
                  loader: Callable[[], Model] | None = None) -> DataFrame:
    """Whole texts of matching files through the model, without segments; other files are copied."""
    planned = _planned(files.select("rel_path", "content"), code_types, count, bytecode=True)
    todo = planned.where(F.col("action") == TRANSFORM).select("rel_path", "out_path", decode_lossy("content").alias("_t"))
    done = todo.withColumn("content", _model_column(fn, loader, F.col("_t")).cast("binary")).withColumn(
        "part", F.lit(0)
    )
    return _finish(planned, done)


def transform_tree(files: DataFrame, fn: Model | None = None, code_types=None, count: int | None = None, *,
                   loader: Callable[[], Model] | None = None, gaps: bool = False) -> DataFrame:
    """Plan, segment, run the model and reassemble: (rel_path, part, content) of the whole output tree.

    Unsupported files have no output; ``plan_tree`` lists them. A file without functions becomes an empty one. With
    ``gaps`` the text between functions is kept, and only bodies change. Only the segments of transformed files are
    shuffled.
    """
    planned = _planned(files.select("rel_path", "content"), code_types, count, bytecode=False)
    text = planned.where(F.col("action") == TRANSFORM).select(
        "rel_path", "code_type", decode_lossy("content").alias("text")
    )
    if gaps:
        answered = apply_model(segment_whole_files(text, code_types), fn, loader=loader)
    else:
        functions, _ = extract_functions(text, keep_empty=True, code_types=code_types, marked=True)
        answered = apply_model(segment_files(functions, code_types), fn, loader=loader)
    joined = reassemble(answered, "" if gaps else SEPARATOR).withColumn("content", F.col("content").cast("binary"))
    done = _planned(joined, code_types, None, bytecode=False)
    return _finish(planned, done)
