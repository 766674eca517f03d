"""Documents drawn towards a target distribution by importance weights of hashed n-grams.

1. Features of a text are all runs of ``low`` to ``high`` consecutive words, lower-cased and joined by one space, repeats
   counted. A feature's bucket is the CRC-32 of its bytes modulo ``buckets``.
2. A batch of texts is interned in an open-addressed table of NumPy arrays: the xxhash64 of a feature is its first slot,
   equal keys are told apart by their bytes, and a slot taken by another feature sends it on to the next one. All features
   of the batch move at once, a step at a time. A slot holds the feature's bucket and its count, so that the CRC is taken
   once per different feature; the slot numbers of the occurrences stay for the second use.
3. Counts per bucket are summed in the task, so a task sends one row per bucket that it met, ``buckets`` at most.
4. A bucket's gain is ``floor(1000 * ln(((t + 1) (S + buckets)) / ((s + 1) (T + buckets))))`` for s of S features of the
   documents and t of T of the target. The gains (one number per bucket) go to the tasks, where the occurrences' slots
   gather them; their sum is a document's weight.
5. Weight plus seeded Gumbel noise is the score; the best ``share`` percent of the documents with ``min_words`` words are
   drawn, which draws without replacement in proportion to the exponential of the weights. Ranks come from range
   partitions of (score, id): numbers only, and no task holds more than a range.

Words are runs of ASCII letters and digits and of characters beyond ASCII. Null or empty text: no features, weight 0,
never drawn. Empty target or empty documents: all gains are those of empty counts, so the noise decides. Rows with equal
id have equal noise; equal scores go to the smaller id (null first), equal rows in any order, as they have the same
results but the rank. Very long texts are whole cells and counted whole; a text larger than a batch is a batch. All
columns are kept by ``resample``; those named as results are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.words import ALPHANUMERIC
from pairloom.operators.ordering import numbered
from pairloom.session import materialize

BUCKETS = 10_000
LOW = HIGH = 1
MIN_WORDS = 20
SHARE = 10
SEED = 2024
RESULT = ["n_features", "weight", "score", "rank"]
# Capitals to small letters, everything between words to blanks.
_PLAIN = bytes(c + 32 if ord("A") <= c <= ord("Z") else c if ALPHANUMERIC[c] else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


class Interned:
    """The n-grams of a batch: ``slot`` per occurrence; per used slot its first occurrence, bucket and count."""

    def __init__(self, grams: list[bytes], buckets: int):
        n = len(grams)
        size = 1 << max(4, (2 * n).bit_length())
        lengths = np.fromiter(map(len, grams), np.int64, n)
        keys = np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, n)
        self._bytes = np.frombuffer(b"".join(grams), np.uint8)
        self._lengths, self._starts = lengths, np.cumsum(lengths) - lengths
        owner = np.full(size, -1, np.int64)
        self.slot = np.empty(n, np.int64)
        waiting = np.arange(n)
        at = (keys & np.uint64(size - 1)).astype(np.int64)
        while len(waiting):
            free = owner[at] < 0
            # Of several that claim a slot at once one wins, and the others look at it like at any taken slot.
            owner[at[free]] = waiting[free]
            held = owner[at]
            same = keys[held] == keys[waiting]
            same[same] = self._equal(held[same], waiting[same])
            self.slot[waiting[same]] = at[same]
            waiting, at = waiting[~same], (at[~same] + 1) & (size - 1)
        used = np.flatnonzero(owner >= 0)
        self.bucket = np.zeros(size, np.int64)
        self.bucket[used] = [zlib.crc32(grams[i]) % buckets for i in owner[used].tolist()]
        self.count = np.bincount(self.slot, minlength=size)

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of two n-grams each are the same."""
        equal = self._lengths[a] == self._lengths[b]
        to_read = np.flatnonzero(equal & (a != b))
        length = self._lengths[a[to_read]]
        first = np.cumsum(length) - length
        within = np.arange(int(length.sum())) - np.repeat(first, length)
        differs = (self._bytes[np.repeat(self._starts[a[to_read]], length) + within]
                   != self._bytes[np.repeat(self._starts[b[to_read]], length) + within])
        equal[to_read[np.add.reduceat(differs, first) > 0] if len(to_read) else to_read] = False
        return equal


def grams_of(words: list[bytes], low: int, high: int) -> list[bytes]:
    if low == high == 1:
        return words
    return [b" ".join(words[i:i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def interned(texts: list[str | None], low: int, high: int, buckets: int) -> tuple[Interned, np.ndarray, np.ndarray]:
    """The table of a batch, and per text its number of features and of words."""
    words = [words_of(text) for text in texts]
    grams = [grams_of(own, low, high) for own in words]
    table = Interned(list(chain.from_iterable(grams)), buckets)
    return table, np.array([len(g) for g in grams], np.int64), np.array([len(w) for w in words], np.int64)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Rows (bucket, n): features of all texts of ``docs`` per bucket; buckets without any are left out."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            table, _, _ = interned(batch.column(0).to_pylist(), low, high, buckets)
            np.add.at(total, table.bucket, table.count)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    return docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, low: int = LOW, high: int = HIGH) -> np.ndarray:
    """One whole number per bucket. The driver gets ``buckets`` rows from each side, whatever their size."""
    def counted(df: DataFrame) -> np.ndarray:
        total = np.zeros(buckets, np.int64)
        for row in bucket_counts(df, buckets, low, high).collect():
            total[row["bucket"]] = row["n"]
        return total

    s, t = counted(docs), counted(target)
    here = (t + 1).astype(float) * float(int(s.sum()) + buckets)
    there = (s + 1).astype(float) * float(int(t.sum()) + buckets)
    return np.floor(1000 * np.log(here / there)).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``docs`` with ``n_features``, ``weight`` and ``__words``."""
    @F.pandas_udf("n_features long, weight long, words long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            table, features, words = interned(texts.tolist(), low, high, len(gain))
            upto = np.concatenate([[0], np.cumsum(gain[table.bucket[table.slot]])])
            ends = np.cumsum(features)
            yield pd.DataFrame({"n_features": features, "weight": upto[ends] - upto[ends - features], "words": words})

    found = docs.drop(*RESULT).withColumn("__weighed", weigh("text"))
    return found.select("*", "__weighed.n_features", "__weighed.weight", F.col("__weighed.words").alias("__words")) \
        .drop("__weighed")


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate that depends on seed and id only."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, min_words: int = MIN_WORDS, share: int = SHARE) -> DataFrame:
    """Add ``rank`` to rows with ``score``, ``doc_id`` and ``__words``; null for those not drawn. Takes out ``__words``."""
    long_enough = F.col("__words") >= min_words
    drawn = share * scored.where(long_enough).count() // 100
    placed = numbered(scored.where(long_enough).withColumn("__down", -F.col("score")), [], ["__down", "doc_id"], "__place")
    rank = F.when(F.col("__place") < drawn, F.col("__place") + 1).cast("long")
    rest = scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", rank).drop("__down", "__place").unionByName(rest).drop("__words")


def importance(docs: DataFrame, target: DataFrame, *, buckets: int = BUCKETS, low: int = LOW, high: int = HIGH,
               min_words: int = MIN_WORDS, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, weight, score and rank."""
    weights = weighed(docs.select("doc_id", "text"), gains(docs, target, buckets, low, high), low, high).drop("text")
    # Stored: the number drawn and the ranks must come from the same scores, and the texts are read once for them.
    scored = materialize(weights.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    return ranked(scored, min_words, share).select("doc_id", *RESULT)


def resample(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The drawn rows of ``docs``, with all columns. Rows with a drawn id and equal text are drawn together."""
    drawn = importance(docs, target, **parameters).where(F.col("rank").isNotNull() & F.col("doc_id").isNotNull())
    return docs.join(drawn.select("doc_id").distinct(), "doc_id", "left_semi")
