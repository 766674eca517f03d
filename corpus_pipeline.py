"""From raw documents to a training mix: five stages, each an operator of ``pairloom.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is stored and read again as the next one's
``docs``. All but the last return the columns of ``docs``. Each works on all rows it gets, and nothing else.

1. language_id: documents in no known language go: without a letter, or with eight letters or more and a cosine with the
   best language below twice the standard deviation of unrelated vectors (``language_id.FLOOR``). Shorter ones stay.
2. line_dedup: later repeats of passages of at least 50 words go; documents left without a word by that go too, documents
   without a word before stay. ``n_chars`` follows the text.
3. near_duplicates: one document of each group stays.
4. decontamination: documents that hold a passage of the benchmark go.
5. mixing: every document with the words that the mix takes from it; those it takes nothing from go.

Near duplicates are judged on what line dedup left of the documents, as the order of the stages says: a later copy is cut
down to its own lines, and two documents whose remainders differ are no near duplicates any more, whatever they had in common.

Nulls: a null text has no letter and goes in stage 1; a null source is a source of its own; a null id cannot name a group,
and of rows without one that have the same words one stays, if no row with an id has them. Repeated rows: line dedup treats
rows of equal id and text as one document, the stage after it keeps one. Ties: the smaller id stays, of equal ids the
smaller hash of the text. Texts of any length are whole cells. Columns may have any names: the operators' own columns
replace none but those of the last stage (``size``, ``source_size``, ``target``, ``taken``). Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import decontamination, language_id, line_dedup, mixing, superminhash
from pairloom.llm.common import bound_batches, table, word_count
from pairloom.session import materialize, ship_package

# SQL has no vectors of letters, suffix arrays or signatures; the stages are tested against brute force instead.
ORACLE_SQL = None


def _started(spark: SparkSession) -> None:
    ship_package(spark)
    bound_batches(spark)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _started(spark)
    own = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__own"))
    found = language_id.predict(own, language_id.fit(docs))
    return found.where(language_id.in_known_language()).select("__own.*")


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _started(spark)
    # The operator's columns and a document's own of the same names must not meet.
    own = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__own"))
    deduped = line_dedup.remove_repeats(own)
    left = deduped.where((F.col("n_deleted") == 0) | (word_count(F.col("text")) > 0))

    def column(name: str) -> Column:
        kept = F.col(f"__own.`{name}`")
        if name == "text":
            return F.col("text")
        if name == "n_chars":
            kept = F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(kept).cast(docs.schema[name].dataType)
        return kept.alias(name)

    return left.select(*[column(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _started(spark)
    return superminhash.drop_near_duplicates(docs).select(*[f"`{c}`" for c in docs.columns])


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _started(spark)
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _started(spark)
    return mixing.mix_documents(docs).where(F.col("taken") > 0)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_passages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
