"""Quality rules from the frequency of lines across documents, with built-in functions only.

Lines are normalised (white space and case, digits to one digit) and hashed; for each host the different texts holding a
line are counted: copies of a document are one text, so a document is not boilerplate for being copied. A line is
boilerplate and is removed if at least ``MIN_TEXTS`` texts of its host hold it, and these are at least a share
``MIN_SHARE`` of the host's texts or more than ``MANY_TEXTS``: so the limit acts in small hosts, and does not grow without
end in very large ones. A document left with too few words, absolutely or as a share of what it had, is depleted and
rejected. Base counts of words, symbols,
repeated lines and repeated three-word windows are taken inside the row.

Host null: a host of its own. Null or empty text: no words, no lines; the base rule rejects it. Rows with equal id and
text are one document to the counts, and each gets its row in the result; rows with equal id and different text are
different documents. A hash of 64 bits stands for a line within its host and for a window within its document. Only the
named columns are read by ``judge``; ``remove_frequent_lines`` keeps all columns. Empty input: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import GAP, SPACES, let, null_safe, text_key, trimmed, without, word_list
from pairloom.session import materialize

# A line is boilerplate if so many different texts of its host hold it, and
MIN_TEXTS = 5
# these are such a share of the host's texts, or more than so many.
MIN_SHARE = 0.05
MANY_TEXTS = 200
# A document is depleted if fewer words, or a smaller share of its words, are left.
MIN_WORDS = 50
MIN_LEFT = 0.3
SYMBOLS = "#*$%&|<>"
KEY = ["doc_id", "__text_key"]


def normalised(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(trimmed(line)), "[0-9]+", "0"), GAP, " ")


def filled_lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.length(trimmed(line)) > 0)


def repeated_window_words(words: Column, size: int = 3) -> Column:
    """Words inside windows of ``size`` words that occur twice or more in the list."""
    def hashes(w: Column) -> Column:
        return F.when(F.size(w) >= size, F.transform(
            F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])))

    def covered(sorted_pairs: Column) -> Column:
        twice = F.filter(sorted_pairs, lambda x, i: F.coalesce(F.get(sorted_pairs, i + 1)["h"] == x["h"], F.lit(False))
                         | ((i > 0) & (F.get(sorted_pairs, F.greatest(i - 1, F.lit(0)))["h"] == x["h"])))
        start = F.struct(F.lit(-size).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            F.sort_array(F.transform(twice, lambda x: x["i"])), start,
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(size), i - acc["last"])).alias("n")),
            lambda acc: acc["n"])

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(pairs, covered)).otherwise(0)

    return F.coalesce(let(words, lambda w: let(hashes(w), count)), F.lit(0)).cast("long")


def base_counts(text: Column) -> dict[str, Column]:
    """Counts of one text, and ``base_failed``."""
    text = F.coalesce(text, F.lit(""))
    counts = let(word_list(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), repeated_window_words(w).alias("n_repeat_words")))
    lines = let(filled_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return {
        "counts": counts,
        "word_chars": F.length(without(text, SPACES)).cast("long"),
        "n_symbols": (F.length(text) - F.length(without(text, SYMBOLS))).cast("long"),
        "n_dup_lines": lines,
    }


def host_lines(docs: DataFrame, host: str) -> DataFrame:
    """Rows (host, line, doc_id, __text_key, words): a document's distinct normalised lines with the words they hold."""
    line = F.explode(F.transform(filled_lines(F.col("text")), lambda x: let(normalised(x), lambda n: F.struct(
        F.xxhash64(n).alias("line"), (F.length(n) - F.length(F.replace(n, F.lit(" "), F.lit(""))) + 1).alias("words")))))
    rows = docs.select(F.col(host).alias("host"), "doc_id", text_key(F.col("text")).alias("__text_key"), line.alias("l"))
    return rows.groupBy("host", "l.line", *KEY).agg(F.count("*").alias("copies"), F.first("l.words").alias("each")) \
        .select("host", "line", *KEY, (F.col("copies") * F.col("each")).alias("words"))


def frequent_lines(docs: DataFrame, host: str = "source", min_texts: int = MIN_TEXTS, min_share: float = MIN_SHARE,
                   many_texts: int = MANY_TEXTS) -> DataFrame:
    """Rows (host, line, doc_id, __text_key, words) of the lines to remove, by document.

    The lines of all documents are stored once, hashes only. A line's documents are counted with partial sums before the
    shuffle, and different texts only for lines that enough documents hold; a hot line's rows meet its single count in a
    join that the runtime splits.
    """
    lines = materialize(host_lines(docs, host))
    size = docs.groupBy(F.col(host).alias("host")).agg(F.count_distinct(text_key(F.col("text"))).alias("host_texts"))
    some = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_texts)
    repeated = materialize(null_safe(lines, some.select("host", "line"), ["host", "line"], "left_semi"))
    counted = repeated.groupBy("host", "line").agg(F.count_distinct("__text_key").alias("n_texts"))
    frequent = null_safe(counted, size, ["host"], "left").where(
        (F.col("n_texts") >= min_texts)
        & ((F.col("n_texts") >= min_share * F.col("host_texts")) | (F.col("n_texts") > many_texts)))
    return null_safe(repeated, frequent.select("host", "line"), ["host", "line"], "left_semi")


def judge(docs: DataFrame, host: str = "source", **limits: float) -> DataFrame:
    """Per row of ``docs``: doc_id, the base counts, base_failed, n_frequent_words and kept."""
    removed = frequent_lines(docs, host, **limits).groupBy(*KEY).agg(F.sum("words").alias("n_frequent_words"))
    text = F.col("text")
    counted = docs.select("doc_id", text_key(text).alias("__text_key"),
                          *[c.alias(name) for name, c in base_counts(text).items()])
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    base = counted.select(
        *KEY, F.col("counts.n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.col("counts.n_repeat_words").alias("n_repeat_words"),
    ).withColumn("base_failed", (n < 50) | (100 * repeated > 50 * n))
    left = n - F.col("n_frequent_words")
    return (
        null_safe(base, removed, KEY, "left")
        .withColumn("n_frequent_words", F.coalesce("n_frequent_words", F.lit(0)).cast("long"))
        .withColumn("kept", ~F.col("base_failed") & (left >= MIN_WORDS) & (left >= MIN_LEFT * n))
        .drop("__text_key")
    )


def remove_frequent_lines(docs: DataFrame, host: str = "source", **limits: float) -> DataFrame:
    """All rows and columns of ``docs`` with the frequent lines taken out of ``text``. Blank lines stay."""
    removed = frequent_lines(docs, host, **limits).groupBy(*KEY).agg(F.collect_set("line").alias("__removed"))
    keyed = docs.withColumn("__text_key", text_key(F.col("text")))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(
        F.col("__removed"), F.xxhash64(normalised(x)))), "\n")
    return (
        null_safe(keyed, removed, KEY, "left")
        .withColumn("text", F.when(F.col("__removed").isNull(), F.col("text")).otherwise(kept))
        .select(*[f"`{c}`" for c in docs.columns])
    )
