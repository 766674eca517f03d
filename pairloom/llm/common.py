"""What the operators share: words, bindings inside column expressions, keys of documents, and bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the query contracts.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"

# A batch sent to a Python worker holds at most so many rows and bytes of input.
BATCH_ROWS = 1_000
BATCH_BYTES = 8 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once, so a run of very long texts does not pile up in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once: a name used twice inside a lambda would otherwise be computed twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def word_list(text: Column) -> Column:
    """Words between white space of ASCII; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def text_key(text: Column) -> Column:
    """Tells different texts under one document id apart; identical rows are one document."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which a null key meets a null key; the result has ``left``'s keys only."""
    renamed = right.select(*[F.col(f"`{c}`").alias(f"__right_{c}" if c in keys else c) for c in right.columns])
    condition = None
    for key in keys:
        equal = left[f"`{key}`"].eqNullSafe(renamed[f"`__right_{key}`"])
        condition = equal if condition is None else condition & equal
    return left.join(renamed, condition, how).drop(*[f"__right_{key}" for key in keys])
