"""Operations on example sets: filters, slices, shuffles, splits, sorts, budgets and listings.

An example set carries its order in columns. The natural order is (repo if present, artifact, code_type, seq,
ident);
``seeded_shuffle`` adds ``shuffle_key`` and ``sort_by_length`` adds ``sort_len``, which come before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pairloom.code_types import CODE_TYPES, resolve
from pairloom.operators.ordering import equals, ordered_slice, ordered_split, precedes, running_total, with_place
from pairloom.operators.pairing import within
from pairloom.session import materialize

SHUFFLE_KEY = "shuffle_key"
SORT_LENGTH = "sort_len"


def order_of(examples: DataFrame) -> list[Column]:
    """The total order an example set is in."""
    extra = [F.col(c) for c in (SORT_LENGTH, SHUFFLE_KEY) if c in examples.columns]
    return [*extra, *[F.col(c) for c in within(examples, "artifact", "code_type")], F.col("seq.path"), F.col("seq.pos"), F.col("ident")]


def sort_length() -> Column:
    return F.greatest(F.length("source"), F.length("decompiled"))


def limit_code_types(examples: DataFrame, code_types) -> DataFrame:
    """Keep examples of the given code types (names, or a comma string)."""
    return examples.where(F.col("code_type").isin([ct.name for ct in resolve(code_types)]))


def limit_count(examples: DataFrame, count: int | None = None, skip: int = 0) -> DataFrame:
    """Rows ``[skip, skip + count)`` of the set's order; ``None`` means all. Large slices never pass through one task."""
    return ordered_slice(examples, order_of(examples), skip, count)


def seeded_shuffle(examples: DataFrame, seed: int) -> DataFrame:
    """Put the set into a pseudo-random order given by ``seed`` alone, whatever the partitioning; 0 means no shuffle."""
    if seed == 0:
        return examples
    text = F.concat_ws(":", F.lit(str(seed)), "artifact", "code_type", "ident")
    out = examples.drop(SORT_LENGTH) if SORT_LENGTH in examples.columns else examples
    return out.withColumn(SHUFFLE_KEY, F.md5(text))


PERMUTATION_ROUNDS = 64


def permuted(position: Column, n: Column | int, seed: int, inverse: bool = False) -> Column:
    """A bijection of the positions 0 to n - 1, chosen by ``seed``; with ``inverse`` the way back.

    A round swaps or does not swap each pair of positions that add up to the round's key, as a hash of the larger one
    says: so it is its own inverse, for any n, and the rounds backwards undo the whole.
    """
    n = F.lit(n).cast("long") if isinstance(n, int) else n.cast("long")
    last = PERMUTATION_ROUNDS - 1
    rounds = F.sequence(F.lit(last), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(last))

    def swapped(at: Column, turn: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(seed), turn), n) - at, n)
        return F.when(F.pmod(F.xxhash64(F.lit(seed), turn, F.greatest(at, other)), F.lit(2)) == 1, other).otherwise(at)

    return F.aggregate(rounds, position.cast("long"), swapped)


def shuffled_slice(numbered: DataFrame, n: int, seed: int, count: int, skip: int = 0, rank: str = "idx") -> DataFrame:
    """Places ``[skip, skip + count)`` of a shuffled set, with their ``place``, out of a set that has a dense ``rank``
    (``with_position``), stored once.

    The i-th shuffled example is the one of rank ``permuted(i, inverse)``: the wanted ranks are computed, nothing is sorted,
    and of the set only the rows of these ranks are kept. Another seed needs no other table.
    """
    places = numbered.sparkSession.range(min(skip, n), min(skip + count, n)).select(
        F.col("id").alias("place"), permuted(F.col("id"), n, seed, inverse=True).alias("_rank"))
    return numbered.join(places, F.col(rank) == F.col("_rank")).drop("_rank")


def sort_by_length(examples: DataFrame) -> DataFrame:
    """Order by the longer of the two texts; ties keep the order they had. Sorted over range partitions."""
    out = examples.withColumn(SORT_LENGTH, sort_length())
    return out.orderBy(*order_of(out))


def with_position(examples: DataFrame, out: str = "idx") -> DataFrame:
    """Add each row's 0-based position in the set's order: n rows get n numbers, equal rows too."""
    return with_place(examples, order_of(examples), out)


def split_off_end(examples: DataFrame, ratio: float) -> tuple[DataFrame, DataFrame]:
    """The first ``int(n * ratio)`` rows of the set's order, and the rest.

    The cut is found on the keys alone; both parts are then filters, so no text is shuffled. Among rows with equal keys the
    order is that of their content, so together the parts hold every row once.
    """
    return ordered_split(examples, order_of(examples), ratio)


def train_eval_split(examples: DataFrame, *, eval: DataFrame | float | None = None, code_types=None,
                     count: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Training and evaluation sets. Type filter and count limit come first.

    ``eval`` is a second example set, the fraction of rows kept for *training* (the rest evaluates), or none.
    """
    def limited(df: DataFrame) -> DataFrame:
        return limit_count(limit_code_types(df, code_types), count)

    train = limited(examples)
    if eval is None or (isinstance(eval, (int, float)) and eval == 0):
        return train, None
    if isinstance(eval, DataFrame):
        return train, limited(eval)
    # Saved sets are length-sorted, so the longest examples end up in the evaluation part.
    return split_off_end(train, float(eval))


def render_examples(examples: DataFrame) -> DataFrame:
    """(idx, rendered): position, ident, type and both bodies indented, in the set's order."""
    display = F.coalesce(
        *[F.when(F.col("code_type") == ct.name, F.lit(ct.display)) for ct in CODE_TYPES.values()], F.col("code_type")
    )

    def indented(column: str) -> Column:
        return F.concat(F.lit("      "), F.replace(F.col(column), F.lit("\n"), F.lit("\n      ")))

    rendered = F.concat(
        F.lit("  "), F.col("idx").cast("string"), F.lit(": "), "ident", F.lit(" ("), display, F.lit(")\n"),
        F.lit("    source:\n"), indented("source"), F.lit("\n    decompiled:\n"), indented("decompiled"),
    )
    return with_position(examples).select("idx", rendered.alias("rendered"))


def inspect_examples(examples: DataFrame, code_types=None, count: int | None = None, skip: int = 0,
                     seed: int = 0) -> DataFrame:
    """Shuffle, then type filter, then slice, then render."""
    shuffled = seeded_shuffle(examples, seed)
    chosen = limit_count(limit_code_types(shuffled, code_types), count, skip)
    return render_examples(materialize(chosen))


def soft_cap_files(files_with_new_ids: DataFrame, max_len: int) -> DataFrame:
    """Per artifact and side, the files taken before ``max_len`` new ids were reached; the crossing file is kept whole.

    Input: artifact, side, path, code_type, new_ids. Zero or less means no cap.
    """
    if max_len <= 0:
        return files_with_new_ids
    columns = files_with_new_ids.columns
    totals = running_total(
        files_with_new_ids, within(files_with_new_ids, "artifact", "side"), ["path", "code_type"], F.col("new_ids"), "_before"
    )
    return totals.where(F.col("_before") < max_len).select(*columns)


def artifact_cutoff(examples: DataFrame, max_len: int) -> DataFrame:
    """Artifacts in name order up to and including the one that makes the total exceed ``max_len``; 0 means all."""
    if max_len <= 0:
        return examples
    key = within(examples, "artifact")
    counts = examples.groupBy(*key).agg(F.count("*").alias("_n"))
    totals = materialize(running_total(counts, [], key, F.col("_n"), "_before"))
    # The kept artifacts are a prefix, so the last one's name is the whole answer: one row, one filter.
    last = totals.where(F.col("_before") <= max_len).agg(F.max(F.struct("_before", *key)).alias("last")).first()["last"]
    if last is None:
        return examples
    order = [F.col(c) for c in key]
    named = Row(*[last[c] for c in key])
    return examples.where(precedes(order, named) | equals(order, named))
