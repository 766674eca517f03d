"""A stored example set that follows a ledger: artifacts are built when they succeed, and only those."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom import schemas
from pairloom.operators.pairing import join_on
from pairloom.plans.build import build_examples
from pairloom.session import materialize

ARTIFACT = ["repo", "artifact"]
_STORED = T.StructType([
    *[f for f in schemas.EXAMPLES.fields if f.name not in ARTIFACT],
    *[T.StructField(name, T.StringType()) for name in ARTIFACT],
])


def read_maintained(spark: SparkSession, path: str) -> DataFrame:
    """The examples of a maintained set. A row without an id says that its artifact was built and has none."""
    return spark.read.schema(_STORED).parquet(path).where(F.col("ident").isNotNull())


def refresh_artifacts(files: DataFrame, changed: DataFrame, path: str, code_types=None) -> None:
    """Build the artifacts ``changed`` (repo, artifact) from ``files`` and put them in place of what is stored of them.

    Files of other artifacts are not opened, and partitions of other artifacts are not written. An artifact that has no
    example any more gets a row that says so, as a partition without rows would stay as it was. Can be repeated.
    """
    spark = files.sparkSession
    wanted = materialize(changed.select(*ARTIFACT).distinct())
    built = materialize(build_examples(join_on(files, wanted, ARTIFACT, "left_semi"), code_types))
    empty = join_on(wanted, built.select(*ARTIFACT).distinct(), ARTIFACT, "left_anti").select(
        *[F.col(f.name) if f.name in ARTIFACT else F.lit(None).cast(f.dataType).alias(f.name) for f in _STORED.fields])
    rows = built.select(*_STORED.names).unionByName(empty)
    # Rebalanced at run time: few files per artifact, and a very large artifact is split over tasks.
    rows.hint("rebalance", *ARTIFACT).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(*ARTIFACT).parquet(path)


def example_keeper(files: Callable[[DataFrame], DataFrame], path: str, code_types=None) -> Callable[[DataFrame, int], None]:
    """What a watch calls to keep the example set at ``path``: a package is an artifact of its repo.

    ``files(changed)`` lists the files of a repo tree as they are now; it gets the changed artifacts (repo, artifact), so
    that it may list those folders only.
    """
    def process(packages: DataFrame, batch_id: int) -> None:
        changed = packages.select("repo", F.col("package").alias("artifact")).distinct()
        if not changed.isEmpty():
            refresh_artifacts(files(changed), changed, path, code_types)

    return process
