"""Session settings and the one place that decides where checkpoints live."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are written for. Sizes are left to the cluster; these only keep the runtime re-planning on.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A batch of whole files is bounded by bytes, not only by rows, so large files do not pile up in a Python worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 * 1024 * 1024),
}
BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


_shipped: set[str] = set()


def bound_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once, in sessions not made by ``builder`` too; settings of the caller's stay."""
    for key in BATCHES:
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, RECOMMENDED[key])


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application: the driver serves the archive to them."""
    bound_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(), "pairloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def builder(app_name: str = "pairloom") -> SparkSession.Builder:
    b = SparkSession.builder.appName(app_name)
    for key, value in RECOMMENDED.items():
        b = b.config(key, value)
    return b


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only a local session may fall back to a temporary one."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if root:
        return root
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="pairloom-checkpoint-")
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_tables: dict[str, list[str]] = {}


def drop_materialized(spark: SparkSession) -> None:
    """Delete the tables this application has stored so far. Results that still read them must have been used."""
    for path in _tables.pop(spark.sparkContext.applicationId, []):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table on reliable storage and read it back.

    Later reads agree with each other, survive a lost executor, carry no lineage, and take only the columns they need.
    ``checkpoint()`` would compute the plan twice and always read whole rows.
    """
    path = scratch(df.sparkSession, "table")
    _tables.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
