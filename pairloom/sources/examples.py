"""Saved example sets: Parquet, length-sorted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pairloom import schemas
from pairloom.operators.dataset import SORT_LENGTH, sort_length


def write_examples(examples: DataFrame, path: str, force: bool = False) -> None:
    """Write by code type, each type range-sorted by length; an existing target is an error unless ``force``."""
    keys = ["code_type", SORT_LENGTH, "artifact", "seq.path", "seq.pos", "ident"]
    (
        examples.select(*schemas.EXAMPLES.names, sort_length().alias(SORT_LENGTH))
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.mode("overwrite" if force else "errorifexists")
        .partitionBy("code_type")
        .parquet(path)
    )


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Load a saved set. It keeps its length order through the ``sort_len`` column; a missing path is an error."""
    schema = T.StructType([*schemas.EXAMPLES.fields, T.StructField(SORT_LENGTH, T.IntegerType())])
    return spark.read.schema(schema).parquet(path).select(*schema.names)
