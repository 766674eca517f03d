"""Watch mode: process packages as success entries arrive in a ledger or as marker files.

Each package has one value of keyed state (newest entry, whether it was handled). A batch reads and writes the state of
the packages it holds and of no others, so its cost follows the batch, however many packages there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pairloom import schemas
from pairloom.session import ship_package
from pairloom.sources.files import hadoop_path

_STATE = "handled boolean, ts timestamp, status string"
_NEW = "repo string, package string, ts timestamp"
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass",
             "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class PackageWatch(StatefulProcessor):
    """A row (repo, package, ts) per package that newly succeeded, ts being its newest success in the batch.

    With ``settle`` (milliseconds) a package waits until the watermark has passed its newest entry by so much, and counts
    only if that entry is a success: a failure that comes late takes a success back.
    """

    def __init__(self, force: bool, settle: int | None):
        self.force, self.settle = force, settle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.package = handle.getValueState("package", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        handled, ts, status = self.package.get() if self.package.exists() else (False, None, None)
        success = None
        for part in rows:  # a package that reports very often comes in several parts
            good = part.loc[part["status"] == "success", "ts"].max()
            success = good if success is None or pd.isna(success) or good > success else success
            newest = max(zip(part["ts"], part["status"].fillna("")))
            if ts is None or newest > (pd.Timestamp(ts), status or ""):
                ts, status = newest
        todo = success is not None and not pd.isna(success) and (self.force or not handled)
        if self.settle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if status == "success" and (self.force or not handled):
                self.handle.registerTimer(int(pd.Timestamp(ts).value // 1_000_000) + self.settle)
            todo = False
        self.package.update((bool(handled or todo), pd.Timestamp(ts).to_pydatetime(), status))
        if todo:
            yield pd.DataFrame({"repo": [key[0]], "package": [key[1]], "ts": [success]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, ts, status = self.package.get()
        self.package.update((True, ts, status))
        yield pd.DataFrame({"repo": [key[0]], "package": [key[1]], "ts": [pd.Timestamp(ts)]})

    def close(self) -> None:
        pass


def watch_entries(entries: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, force: bool = False,
                  settle: str | None = None, continuous: bool = False) -> StreamingQuery:
    """Call ``process(packages, batch_id)`` with every package that newly succeeded in a stream of ledger entries (repo,
    package, status, ts); each package only once unless ``force``.

    ``process`` must be able to run twice for one ``batch_id``: a batch repeated after a failure sees the state of the
    batch before it and the same work again. Without ``settle`` any success counts, so that the packages handled do not
    depend on how entries fall into batches. With it (such as ``"10 minutes"``) see ``PackageWatch``; entries that are
    later than that are ignored.
    """
    spark = entries.sparkSession
    ship_package(spark)
    base = checkpoint.rstrip("/")
    known = entries.where(F.col("ts").isNotNull()).select(*schemas.LEDGER.names)
    if settle is None:
        keyed, wait, mode = known.where(F.col("status") == "success"), None, "None"
    else:
        wait = int(pd.Timedelta(settle).total_seconds() * 1000)
        keyed, mode = known.withWatermark("ts", settle), "EventTime"
    new = keyed.groupBy("repo", "package").transformWithStateInPandas(
        PackageWatch(force, wait), _NEW, "Append", mode)

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Stored first: the state is read and written by one evaluation of the batch, whatever ``process`` does with it.
        session, path = batch.sparkSession, f"{base}/packages/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        process(session.read.schema(_NEW).parquet(path), batch_id)
        older, fs = hadoop_path(session, f"{base}/packages/batch_id={batch_id - 2}")
        fs.delete(older, True)

    writer = new.writeStream.option("checkpointLocation", f"{base}/stream").foreachBatch(handle)
    name, provider = _PROVIDER
    before = spark.conf.get(name)
    spark.conf.set(name, provider)  # taken over by the stream when it starts
    try:
        return (writer if continuous else writer.trigger(availableNow=True)).start()
    finally:
        spark.conf.set(name, before)


def watch_ledger(spark: SparkSession, ledger_path: str, process: Callable[[DataFrame, int], None], checkpoint: str,
                 force: bool = False, files_per_batch: int | None = None, continuous: bool = False,
                 settle: str | None = None) -> StreamingQuery:
    """``watch_entries`` over a ledger that grows by files."""
    reader = spark.readStream.schema(schemas.LEDGER)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return watch_entries(reader.parquet(ledger_path), process, checkpoint, force, settle, continuous)
