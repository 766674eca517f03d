"""Repeated passages removed by winnowing over line hashes, with built-in functions only.

A document is its sequence of lines that hold a word, each with a hash and its number of words.

1. A window is the shortest run of lines from a line on that holds ``min_words`` words. Its fingerprint is the smallest
   line hash in it, carried with a hash of the whole window, so that only equal windows meet: any passage of at least
   ``min_words`` words in whole lines contains a window, and equal passages have equal fingerprints.
2. Every window is kept, not only a document's minima: so a repeated passage is found from its first whole line on.
   Positions of equal fingerprints are joined to the first one, in the order of document id and position. One partner
   per position: the work grows with the positions, not with the pairs of a group.
3. A match is extended both ways. To the left nothing is left to do: a longer equal run to the left begins with a window
   that is a match itself. To the right the lines that follow are added, fewer than ``min_words`` words, or they would
   hold a window of their own: a repeated window is looked up together with its first following line, with the first two,
   and so on, each such run having a first place of its own. So a passage that goes on differently in several groups of
   documents is followed in each group.
4. All lines of later matches, with the blank lines between them, are deleted. The first place of a window stays; a
   window that overlaps its own first place in the same document loses only the lines beyond it.

Null text stays null, empty text stays empty; neither matches anything; an empty table stays empty. Rows with equal id and text are one document and
each keeps its row, with the same result. Rows with equal id and different text are different documents, ordered by a
hash of their text. A null id comes first. Lines are compared without white space at their ends. A match needs two equal
64-bit hashes. Very long documents are windows over one document's lines, never over a group. All columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import GAP, let, null_safe, text_key, trimmed
from pairloom.session import materialize

MIN_WORDS = 50
KEY = ["doc_id", "__text_key"]


def fingerprints(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, __text_key, pos, end, low, window, tail): one per window.

    ``pos`` and ``end`` are line numbers in the text; ``tail`` are the next lines of fewer than ``min_words`` words.
    """
    line = F.posexplode(F.transform(F.split("text", "\n"), lambda x: let(trimmed(x), lambda t: F.when(
        F.length(t) > 0, F.struct(F.xxhash64(t).alias("h"), F.size(F.split(t, GAP)).alias("n"))))))
    rows = (
        docs.where(F.col("text").isNotNull()).select("doc_id", text_key(F.col("text")).alias("__text_key"), line)
        .where(F.col("col").isNotNull())
        .select(*KEY, "pos", "col.h", F.col("col.n").cast("long").alias("n"))
    )
    # Rows given twice are one document. The exchange by document serves this and all windows.
    lines = rows.repartition(*KEY).groupBy(*KEY, "pos").agg(F.first("h").alias("h"), F.first("n").alias("n"))
    document = Window.partitionBy(*KEY)
    upto = document.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = document.orderBy("to").rangeBetween(1, min_words - 1)
    window = document.orderBy("from").rangeBetween(0, min_words - 1)
    return (
        lines.withColumn("to", F.sum("n").over(upto)).withColumn("from", F.col("to") - F.col("n"))
        .withColumn("tail", F.collect_list(F.struct("h", "pos")).over(after))
        .select(
            *KEY, "pos",
            F.max("pos").over(window).alias("end"), (F.max("to").over(window) - F.col("from")).alias("words"),
            F.min("h").over(window).alias("low"), F.xxhash64(F.collect_list("h").over(window)).alias("window"),
            F.last("tail").over(window).alias("tail"),
        )
        .where(F.col("words") >= min_words).drop("words")
    )


def longer_runs() -> Column:
    """Of a window: structs (key, end) of the window alone and with its first one, two, ... following lines."""
    start = F.array(F.struct(F.col("window").alias("key"), F.col("end").alias("end")))

    def add(runs: Column, line: Column) -> Column:
        key = F.xxhash64(F.element_at(runs, -1)["key"], line["h"])
        return F.concat(runs, F.array(F.struct(key.alias("key"), line["pos"].alias("end"))))

    return F.aggregate(F.coalesce("tail", F.array().cast("array<struct<h:bigint,pos:int>>")), start, add)


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, __text_key, __gone): per document the numbers of the lines to delete."""
    prints = materialize(fingerprints(docs, min_words))
    twice = prints.groupBy("low", "window").agg(F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    windows = prints.join(twice, ["low", "window"], "left_semi")
    runs = materialize(
        windows.select(*KEY, "pos", "low", F.explode(longer_runs()).alias("run"))
        .select(*KEY, "pos", "low", "run.key", "run.end"))
    # Stored, so that the join reads two plain tables and the runtime may split a run that very many places hold.
    first = materialize(
        runs.groupBy("low", "key").agg(F.min(F.struct(*KEY, "pos", "end")).alias("first"), F.count("*").alias("n"))
        .where(F.col("n") > 1).drop("n"))
    same_document = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("__text_key") == F.col("first.__text_key"))
    matches = (
        runs.join(first, ["low", "key"])
        .where(~(same_document & (F.col("pos") == F.col("first.pos"))))
        .withColumn("from", F.when(same_document, F.greatest(F.col("pos"), F.col("first.end") + 1))
                    .otherwise(F.col("pos")))
        .where(F.col("from") <= F.col("end"))
        # Of the runs from one place the longest says it all; both groupings use one exchange.
        .select(*KEY, "from", "end").repartition(*KEY).groupBy(*KEY, "from").agg(F.max("end").alias("to"))
    )
    return matches.groupBy(*KEY).agg(F.collect_list(F.struct("from", "to")).alias("runs")).select(
        *KEY, F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["from"], r["to"])))).alias("__gone"))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows of ``docs`` with later repeated passages taken out of ``text``, and ``n_lines``, ``n_deleted`` added."""
    keyed = docs.drop("n_lines", "n_deleted").withColumn("__text_key", text_key(F.col("text")))
    lines = F.split("text", "\n")
    kept = let(lines, lambda x: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__gone")), lambda i: F.get(x, i)), "\n"))
    return (
        null_safe(keyed, repeated_lines(docs, min_words), KEY, "left")
        .withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
        .withColumn("n_deleted", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept))
        .drop("__gone", "__text_key")
    )
