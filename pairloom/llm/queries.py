"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import (
    decontamination, importance, language_id, line_dedup, line_quality, mixing, periodic_runs, pii, preference,
    retrieval_packing, secrets, superminhash, wrappers,
)
from pairloom.llm.common import bound_batches, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    bound_batches(spark)
    return table(spark, sf_dir, "documents").select("doc_id", "text", *columns)


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "lang")
    found = language_id.predict(docs.drop("lang"), language_id.fit(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@query
def op2_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.preference_pairs(preference.branched(table(spark, sf_dir, "conversations")))


@query
def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(table(spark, sf_dir, "documents"))


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secrets.find_secrets(docs, secrets.fit(docs)).drop("text")


@query
def op5_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return wrappers.extract(table(spark, sf_dir, "pages"))


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = line_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return deduped.select("doc_id", "n_lines", "n_deleted", "text")


@query
def op7_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(documents(spark, sf_dir))


@query
def op8_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.drop("text")


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.find_personal(docs, pii.fit(docs)).drop("text")


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find_runs(periodic_runs.planted(documents(spark, sf_dir))))


@query
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query
def op13_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_packing.digests(retrieval_packing.pack(documents(spark, sf_dir)))
