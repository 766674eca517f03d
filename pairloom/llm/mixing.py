"""Sources mixed to target weights by Sainte-Laguë apportionment, with built-in functions only.

1. Sizes are words. Each source's target is its weight's share of all words; a source stops at ``max_epochs`` times its
   size and what it cannot take is shared again by weight (``targets``).
2. The mix is cut into blocks of equally many words. Blocks go to the sources by the highest quotients
   ``target / (2 * seats + 1)``. Seats far below a source's fair share are never in doubt, so quotients are listed only
   around it: a few per source however many blocks there are (``apportion``).
3. A source's documents are dealt by seeded hash to shards of about ``docs_per_shard`` documents, and the source's blocks
   to its shards by the same rule. So no source, however large, is ordered as a whole.
4. In a shard the documents form a ring of words in seeded order; the quota's blocks are consecutive blocks of the ring
   from a seeded start. A quota above the ring's size goes round again: repeats.

Null source: a source of its own, after all others. Null or empty text: size 0, takes nothing. Repeated rows: each is a
document of its own with the same place in the ring order, so they may share their blocks unevenly, but in total they
take what the ring gives them. Ties of the seeded hash are broken by document id. Empty input: empty result. Other
columns are kept by ``mix_documents``; one named like a result column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import word_count
from pairloom.session import materialize

SEED = 17
BLOCK_WORDS = 64
MAX_EPOCHS = 3
DOCS_PER_SHARD = 5_000
RESULT = ["size", "source_size", "target", "taken"]


def targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to rows (source, source_size, n_docs), one per source.

    A source is full when its capacity per weight is below the share per weight of all that are not full. Sources in the
    order of capacity per weight make the full ones a prefix, found without iterating. Windows run over one row per
    source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    on = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    return (
        sources
        .withColumn("weight", (F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1).cast("double"))
        .withColumn("capacity", (F.col("source_size") * max_epochs).cast("double"))
        .withColumn("room", F.col("capacity") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("share", (F.col("total") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0)))
                    / F.sum("weight").over(on))
        # The first source that is not full sets the share of all that follow.
        .withColumn("level", F.min(F.when(F.col("room") >= F.col("share"), F.struct("room", "share")))
                    .over(everything)["share"])
        .withColumn("target", F.least("capacity", F.col("level") * F.col("weight")))
        .select("source", "source_size", "n_docs", F.coalesce("target", F.lit(0.0)).alias("target"))
    )


def apportion(parties: DataFrame, group: list[str], key: Column, target: str, seats: str, most: Column,
              out: str) -> DataFrame:
    """Add ``out``: the integer share of ``seats`` (equal within a group) by highest quotients, at most ``most`` each.

    Sainte-Laguë gives a party ``round(target / divisor)`` for one common divisor. The divisor differs from the fair one
    by less than two seats per party (half by rounding, one by ``most``), so a share lies within
    ``2 + 2 * fair * parties / seats`` of the fair one:
    seats below that are settled, and only quotients inside it are compared. Over a group these are a few per
    party, plus a constant. Equal quotients go to the smaller key.
    """
    whole = Window.partitionBy(*group)
    by_quotient = Window.partitionBy(*group).orderBy(F.col("_quotient").desc(), "_key", "_seat")
    marked = (
        parties.withColumn("_key", key).withColumn("_most", most.cast("long"))
        .withColumn("_sum", F.sum(target).over(whole)).withColumn("_n", F.count("*").over(whole))
        .withColumn("_fair", F.when(F.col("_sum") > 0, F.col(target) * F.col(seats) / F.col("_sum")).otherwise(0.0))
        .withColumn("_slack", 2 + F.col("_fair") * F.col("_n") * 2 / F.greatest(F.col(seats), F.lit(1)))
        .withColumn("_sure", F.least("_most", F.greatest(F.lit(0), F.floor(F.col("_fair") - F.col("_slack")))))
        .withColumn("_high", F.least("_most", F.ceil(F.col("_fair") + F.col("_slack"))))
    )
    tried = (
        marked
        .withColumn("_free", F.col(seats) - F.sum("_sure").over(whole))
        .withColumn("_seat", F.explode_outer(F.when(
            F.col("_high") > F.col("_sure"), F.sequence(F.col("_sure"), F.col("_high") - 1))))
        .withColumn("_quotient", F.when(F.col("_seat").isNotNull(), F.col(target) / (2 * F.col("_seat") + 1)))
        .withColumn("_won", (F.row_number().over(by_quotient) <= F.col("_free")) & F.col("_seat").isNotNull()
                    & (F.col("_quotient") > 0))
    )
    names = parties.columns
    return (
        tried.groupBy(*names, "_sure").agg(F.sum(F.col("_won").cast("long")).alias("_more"))
        .withColumn(out, F.col("_sure") + F.col("_more")).select(*names, out)
    )


def place(doc_id: Column, seed: int) -> Column:
    """The seeded order: hexadecimal digits of a hash of seed and document id. A null id hashes as an empty one."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def taken_words(sized: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS, max_epochs: int = MAX_EPOCHS,
                docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """Rows (doc_id, source, size) with ``source_size``, ``target`` and ``taken`` added. Any further columns are kept."""
    sized = sized.withColumn("__place", place(F.col("doc_id"), seed))
    by_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")),
                        max_epochs)
    # One row per source: stored, because quotas and documents must see the same numbers.
    sources = materialize(apportion(
        by_source.withColumn("__blocks", F.floor(F.sum("target").over(Window.partitionBy()) / block_words))
        .withColumn("__shards", F.ceil(F.col("n_docs") / docs_per_shard).cast("long")),
        [], F.col("source"), "target", "__blocks", F.floor(F.col("source_size") * max_epochs / block_words), "__quota",
    ).drop("__blocks"))
    known = sources.select(F.col("source").alias("__source"), "source_size", "target", "__quota", "__shards")
    # The sources are an aggregate of few rows; the runtime decides by their bytes whether to send them everywhere.
    dealt = (
        sized.join(known, sized["source"].eqNullSafe(known["__source"]), "left").drop("__source")
        .withColumn("__shard", F.pmod(_number(F.substring("__place", 1, 12)), F.col("__shards")))
    )
    shards = dealt.groupBy("source", "__quota", "__shard").agg(F.sum("size").alias("__ring"))
    quotas = materialize(apportion(
        shards, ["source", "__quota"], F.col("__shard"), "__ring", "__quota",
        F.floor(F.col("__ring") * max_epochs / block_words), "__blocks",
    )).select(F.col("source").alias("__source"), F.col("__shard").alias("__of"), "__ring", "__blocks")
    ring = Window.partitionBy("source", "__shard").orderBy("__place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    start = block_words * F.pmod(_number(F.substring(place(F.col("__shard"), seed), 1, 12)),
                                 F.greatest(F.floor(F.col("__ring") / block_words), F.lit(1)))

    def turns(words: Column) -> Column:
        """How many of the first ``words`` words of the endless ring are this document's."""
        rest = F.pmod(words, F.col("__ring"))
        part = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("__end") + F.col("size")))
        return F.floor(words / F.col("__ring")) * F.col("size") + part

    return (
        dealt.withColumn("__end", F.sum("size").over(ring))
        .join(quotas, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__shard") == F.col("__of")), "left")
        .withColumn("__from", start)
        .withColumn("taken", F.when(F.col("__ring") > 0, turns(F.col("__from") + F.col("__blocks") * block_words)
                                    - turns(F.col("__from"))).otherwise(0).cast("long"))
        .drop("__place", "__shard", "__source", "__of", "__ring", "__blocks", "__end", "__from", "__quota", "__shards")
    )


def mix_documents(docs: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All documents with ``size``, ``source_size``, ``target`` and ``taken`` (words to be read from it, with repeats)."""
    plain = docs.drop(*RESULT).withColumn("size", word_count(F.col("text")))
    return taken_words(plain, seed, block_words)
