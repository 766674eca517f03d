"""Package listings, status ledgers and the work that remains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom import schemas
from pairloom.functions.text import decompiled_path

# Lines are counted in blocks of this many, so running counts need no window over a whole listing.
_BLOCK = 65_536


def cap_per_repo(packages: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` packages of each repo in listing order. The limit per group is applied before the shuffle too."""
    if n is None:
        return packages
    listing = Window.partitionBy("repo").orderBy("line_no", "package")
    return packages.withColumn("_nth", F.row_number().over(listing)).where(F.col("_nth") <= n).drop("_nth")


def _first_field(line: Column) -> Column:
    return F.substring_index(line, " ", 1)


def _with_bound(lines: DataFrame, bound: Column) -> DataFrame:
    """Add ``_bound``, an aggregate over each repo's lines: one row per repo, reduced before it is shuffled."""
    bounds = lines.groupBy(F.col("repo").alias("_repo")).agg(bound.alias("_bound"))
    return lines.join(bounds, F.col("repo").eqNullSafe(F.col("_repo"))).drop("_repo")


def list_packages(lines: DataFrame, n: int | None = None) -> DataFrame:
    """First field of each of the first ``n`` listing lines of each repo. Input: repo, line_no, line."""
    return cap_per_repo(lines.select("repo", "line_no", _first_field(F.col("line")).alias("package"),
                                     F.lit(None).cast("string").alias("version")), n)


def list_packages_drop_last(lines: DataFrame, n: int | None = None) -> DataFrame:
    """The same for listings whose trailing line is a remark."""
    kept = _with_bound(lines, F.max("line_no")).where(F.col("line_no") < F.col("_bound")).drop("_bound")
    return list_packages(kept, n)


def latest_per_package(lines: DataFrame, header: int = 2, n: int | None = None) -> DataFrame:
    """``name/version`` lines after each repo's ``header`` lines: the last one of each name, in listing order, the first
    ``n`` of each repo."""
    body = _with_bound(lines, F.min("line_no")).where(F.col("line_no") >= F.col("_bound") + header)
    name = F.substring_index("line", "/", 1)
    latest = (
        body.groupBy("repo", name.alias("package"))
        .agg(F.max_by("line", "line_no").alias("_line"), F.max("line_no").alias("line_no"))
        .select("repo", "line_no", "package",
                F.when(F.contains("_line", F.lit("/")), F.substr("_line", F.length("package") + 2)).alias("version"))
    )
    return cap_per_repo(latest, n)


def latest_status(ledger: DataFrame) -> DataFrame:
    """The newest status per package. Entries are reduced before the shuffle, however often one package reports."""
    return ledger.groupBy("repo", "package").agg(F.max_by("status", F.struct("ts", "status")).alias("status"))


def resume_worklist(packages: DataFrame, ledger: DataFrame) -> DataFrame:
    """Packages that have neither succeeded nor failed yet."""
    return packages.join(latest_status(ledger).select("repo", "package"), ["repo", "package"], "left_anti")


def artifact_worklist(artifacts: DataFrame, ledger: DataFrame, skip_successes: bool = True,
                      skip_failures: bool = False) -> DataFrame:
    """Artifacts to process again or for the first time. ``artifacts``: repo, package; flags say what to leave out."""
    skipped = [s for s, on in (("success", skip_successes), ("failed", skip_failures)) if on]
    done = latest_status(ledger).where(F.col("status").isin(skipped) if skipped else F.lit(False))
    return artifacts.join(done.select("repo", "package"), ["repo", "package"], "left_anti")


def file_worklist(files: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Object files without a decompiled counterpart in ``done`` (column path); all of them when forced."""
    if force:
        return files
    return (
        files.withColumn("_target", decompiled_path("path"))
        .join(done.select(F.col("path").alias("_target")).distinct(), "_target", "left_anti")
        .drop("_target")
    )


def worklist_progress(files: DataFrame, imported: DataFrame, done: DataFrame, force_import: bool = False,
                      force_decompile: bool = False) -> DataFrame:
    """To-do and skipped counts of both phases.

    ``imported`` lists object paths already imported, ``done`` decompiled paths already written.
    """
    flagged = (
        files.select("path", decompiled_path("path").alias("_target"))
        .join(imported.select("path", F.lit(True).alias("_imported")).distinct(), "path", "left")
        .join(done.select(F.col("path").alias("_target"), F.lit(True).alias("_done")).distinct(), "_target", "left")
    )
    phases = F.array(
        F.struct(F.lit("import").alias("phase"),
                 (F.col("_imported").isNotNull() & F.lit(not force_import)).alias("skip")),
        F.struct(F.lit("decompile").alias("phase"),
                 (F.col("_done").isNotNull() & F.lit(not force_decompile)).alias("skip")),
    )
    return (
        flagged.select(F.explode(phases).alias("_p"))
        .groupBy(F.col("_p.phase").alias("phase"))
        .agg(F.count_if(~F.col("_p.skip")).alias("todo"), F.count_if(F.col("_p.skip")).alias("skipped"))
    )


def ledger_success_count(packages: DataFrame, ledger: DataFrame, running: bool = False) -> DataFrame:
    """Successes per repo, or with ``running`` the count after each listed package.

    The running form counts per block of lines first, so a long listing is not counted by a single task.
    """
    status = packages.join(latest_status(ledger), ["repo", "package"], "left")
    success = F.count_if(F.col("status") == "success")
    if not running:
        return status.groupBy("repo").agg(success.alias("num_success"))
    blocks = status.withColumn("_block", F.floor(F.col("line_no") / _BLOCK))
    before = Window.partitionBy("repo").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocks.groupBy("repo", "_block").agg(success.alias("_n"))
        .select("repo", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = (
        Window.partitionBy("repo", "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    )
    return blocks.join(offsets, ["repo", "_block"]).select(
        "repo", "line_no", "package", "status", (F.col("_offset") + success.over(inside)).alias("num_success")
    )


def classify_outcome(runs: DataFrame) -> DataFrame:
    """Exit codes to ledger rows. Codes above 127 abort: no status is recorded for them."""
    code = F.col("exit_code")
    return runs.select(
        "repo", "package",
        F.when(code > 127, F.lit(None)).when(code != 0, "failed").otherwise("success").alias("status"),
        "ts",
        (code > 127).alias("abort"),
    )


def append_ledger(outcomes: DataFrame, path: str) -> None:
    """Append the recorded outcomes; earlier entries are never rewritten."""
    outcomes.where(F.col("status").isNotNull()).select(*schemas.LEDGER.names).write.mode("append").parquet(path)
