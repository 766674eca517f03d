"""Tokens, ids, padding and the accuracy metric."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.ordering import ordered_slice
from pairloom.session import materialize

# Special tokens with their ids, and the token pattern (names, numbers, single other characters).
PAD, BOS, EOS, UNK = 0, 1, 2, 3
SPECIAL_TOKENS = ("<pad>", "<s>", "</s>", "<unk>")
TOKEN_PATTERN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^ A-Za-z0-9_]"
# The same tokens in the words that Java's engine is quickest with: its \w and \d are ASCII, and nothing is given back.
_QUICK_PATTERN = r"(?!\d)\w++|\d++|[^ \w]"
DEFAULT_MAX_LEN = 512

# The caller may ask for a vocabulary to become a constant of the plan; a larger one than this is then an error.
LOOKUP_ROWS = 50_000

# A caller's tokenizer: texts to lists of ids; its counterpart: lists of ids to texts.
Tokenizer = Callable[[pd.Series], Sequence[Sequence[int]]]
Decoder = Callable[[pd.Series], Sequence[str]]


def tokens(text: Column | str) -> Column:
    """Tokens of a text; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_QUICK_PATTERN), F.lit(0))


def build_vocab(df: DataFrame, cols: Sequence[str], size: int) -> DataFrame:
    """(token, id) of the ``size`` most frequent tokens, ties by token; ids follow the special tokens."""
    return _vocab(df.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("_text")).select(
        tokens("_text").alias("_tokens")), ["_tokens"], size)


def _vocab(df: DataFrame, cols: Sequence[str], size: int) -> DataFrame:
    counts = materialize(
        df.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("_one")).select(F.explode("_one").alias("token"))
        .groupBy("token").agg(F.count("*").alias("n"))
    )
    frequent = ordered_slice(counts, [-F.col("n"), F.col("token")], 0, size)
    # At most ``size`` rows reach this window.
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "token"))
    return frequent.select("token", (rank + len(SPECIAL_TOKENS) - 1).cast("int").alias("id"))


def _lookup(vocab: DataFrame) -> Callable[[Column], Column]:
    """Token column to id column (null if unknown) without a join.

    A map is searched entry by entry, so the tokens are spread over many small maps by hash.
    """
    rows = vocab.select("token", "id").limit(LOOKUP_ROWS + 1).collect()
    if len(rows) > LOOKUP_ROWS:
        raise ValueError(f"a lookup takes at most {LOOKUP_ROWS} tokens; join a larger vocabulary")
    slots = 1 << max(len(rows) // 2, 1).bit_length()

    def slot(token: Column | str) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(slots)).cast("int")

    placed = vocab.select("token", "id", slot("token").alias("slot")).limit(LOOKUP_ROWS).collect()
    maps: list[dict[str, int]] = [{} for _ in range(slots)]
    for row in placed:
        maps[row["slot"]][row["token"]] = row["id"]
    table = F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")
    return lambda token: F.try_element_at(F.get(table, slot(token)), token)


def _framed(ids: Column) -> Column:
    return F.concat(F.array(F.lit(BOS)), ids, F.array(F.lit(EOS)))


def _ids(df: DataFrame, key: Sequence[str], texts: dict[str, Column], vocab: DataFrame, max_len: int,
         lookup: bool) -> DataFrame:
    """One row per row of ``df`` with an id array per entry of ``texts`` (output name to a column of token arrays)."""
    if max_len < 2:
        raise ValueError("max_len must leave room for the two sentence marks")
    cut = {name: F.slice(column, 1, max_len - 2) for name, column in texts.items()}
    if lookup:
        find = _lookup(vocab)
        return df.select(*key, *[
            _framed(F.transform(column, lambda t: F.coalesce(find(t), F.lit(UNK)))).alias(name)
            for name, column in cut.items()
        ])
    return _ids_by_join(df, key, cut, vocab)


def _ids_by_join(df: DataFrame, key: Sequence[str], texts: dict[str, Column], vocab: DataFrame) -> DataFrame:
    """The same by a join; a token found very often is split by the runtime. Arrays are cut already, so groups stay
    within the limit. Rows with one key are told apart by their tokens, and equal rows are counted and given back."""
    sides = F.array(*[F.struct(F.lit(name).alias("side"), F.col(name).alias("tokens")) for name in texts])
    exploded = (
        _rows_once(df.select(*key, *[column.alias(name) for name, column in texts.items()]), key, list(texts))
        .select(*key, "_row", "_copies", F.explode(sides).alias("_s"))
        # Taken out of the struct first: else every token would carry all tokens of its text along.
        .select(*key, "_row", "_copies", F.col("_s.side").alias("_side"), F.col("_s.tokens").alias("_tokens"))
        # The outer explode keeps empty texts.
        .select(*key, "_row", "_copies", "_side", F.posexplode_outer("_tokens").alias("_pos", "token"))
    )
    found = exploded.join(vocab.select("token", "id").distinct(), "token", "left")
    packed = _packed(F.col("_pos"), F.coalesce("id", F.lit(UNK)))
    collected = [F.array_sort(F.collect_list(F.when(F.col("_side") == name, packed))).alias(name) for name in texts]
    return (
        found.groupBy(*key, "_row").agg(F.first("_copies").alias("_copies"), *collected)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select(*key, *[_framed(F.transform(name, _unpacked)).alias(name) for name in texts])
    )


def _rows_once(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Every different row once, told apart by its key and the hash ``_row`` of ``columns``, with its number ``_copies``.

    The rows are dealt by what tells them apart, so their elements, once exploded, need no shuffle of their own to come
    together again, unless a join in between deals them anew.
    """
    return df.withColumn("_row", F.xxhash64(*columns)).groupBy(*key, "_row").agg(
        F.count("*").cast("int").alias("_copies"), *[F.first(c).alias(c) for c in columns])


def _packed(pos: Column, value: Column) -> Column:
    """A place and an id in one number that sorts by the place; null without a place."""
    return F.shiftleft(pos.cast("long"), 32) + value.cast("long")


def _unpacked(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def tokenize(df: DataFrame, col: str, vocab: DataFrame, max_len: int = DEFAULT_MAX_LEN,
             key: Sequence[str] = ("ident",), lookup: bool = False) -> DataFrame:
    """Ids of each text, framed by the sentence marks and cut to ``max_len``. A null text has the marks only.

    ``lookup`` makes a vocabulary of up to ``LOOKUP_ROWS`` tokens a constant of the plan, which saves the shuffle of a
    join; the rows are the same.
    """
    return _ids(df, list(key), {"input_ids": tokens(col)}, vocab, max_len, lookup)


def _called(fn: Callable | None, loader: Callable[[], Callable] | None, kind: str, column: Column) -> Column:
    """A caller's function over batches of the column, nulls left out and null in the result."""
    if (fn is None) == (loader is None):
        raise ValueError("give either fn or loader")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = loader() if loader is not None else fn  # loaded once per task
        for batch in batches:
            out = pd.Series([None] * len(batch), dtype=object)
            wanted = batch.dropna()
            if len(wanted):
                for at, value in zip(batch.notna().to_numpy().nonzero()[0], call(wanted)):
                    out.iat[at] = value
            yield out

    return F.pandas_udf(run, kind)(column)


def tokenize_with(df: DataFrame, col: str, fn: Tokenizer | None = None, max_len: int = DEFAULT_MAX_LEN,
                  key: Sequence[str] = ("ident",), *, loader: Callable[[], Tokenizer] | None = None) -> DataFrame:
    """Ids of each text by the caller's tokenizer, cut to ``max_len``; it sets its own sentence marks."""
    ids = _called(fn, loader, "array<int>", F.coalesce(col, F.lit("")))
    return df.select(*key, F.slice(ids, 1, max_len).alias("input_ids"))


def decode_with(df: DataFrame, ids_col: str, fn: Decoder | None = None, key: Sequence[str] = ("ident",), *,
                loader: Callable[[], Decoder] | None = None) -> DataFrame:
    """Ids back to text by the caller's tokenizer; null ids are no ids."""
    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    return df.select(*key, _called(fn, loader, "string", ids).alias("text"))


def _padded(ids: Column, length: Column, pad_id: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad_id), length - F.size(ids)))


def _mask(ids: Column, length: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), length - F.size(ids)))


def pad_longest(df: DataFrame, ids_col: str = "input_ids", pad_id: int = PAD, bucket: int | None = None,
                mask_col: str | None = "attention_mask") -> DataFrame:
    """Pad every row to the longest row of the set, and add the mask.

    With ``bucket`` rows are padded to the next multiple of it instead: no pass over the set, and one long row does
    not lengthen all others.
    """
    ids = F.col(ids_col)
    if bucket is not None:
        length = (F.ceil(F.size(ids) / bucket) * bucket).cast("int")
    else:
        length = df.agg(F.max(F.size(ids))).scalar()
    rows = df
    if mask_col:
        rows = df.withColumn("_mask", _mask(ids, length))
    out = rows.withColumn(ids_col, _padded(ids, length, pad_id))
    return out.withColumnRenamed("_mask", mask_col) if mask_col else out


def encode_dataset(examples: DataFrame, vocab: DataFrame | int, max_len: int = DEFAULT_MAX_LEN,
                   bucket: int | None = None, key: Sequence[str] = ("artifact", "code_type", "ident"),
                   lookup: bool = False) -> DataFrame:
    """Decompiled texts to padded ``input_ids`` and ``attention_mask``, sources to padded ``labels``.

    Texts are cut into tokens once and stored; ids and both lengths come from there. A number as ``vocab`` is the size
    of the vocabulary to build from the same tokens, before they are cut to ``max_len``.
    """
    cut = materialize(examples.select(*key, tokens("decompiled").alias("_in"), tokens("source").alias("_out")))
    if isinstance(vocab, int):
        vocab = materialize(_vocab(cut, ["_in", "_out"], vocab))

    def longest(column: str) -> Column:
        return F.max(F.least(F.size(column), F.lit(max_len - 2)) + 2)

    # One row: both lengths of the whole set.
    lengths = cut.agg(longest("_in").alias("inputs"), longest("_out").alias("labels")).first()
    if lengths["inputs"] is None:
        raise ValueError("no examples to encode")
    ids = _ids(cut, list(key), {"input_ids": F.col("_in"), "labels": F.col("_out")}, vocab, max_len, lookup)
    if bucket is not None:
        return pad_longest(pad_longest(ids, "input_ids", bucket=bucket), "labels", bucket=bucket, mask_col=None)
    inputs, labels = F.col("input_ids"), F.col("labels")
    input_length, label_length = F.lit(lengths["inputs"]), F.lit(lengths["labels"])
    return ids.select(
        *key,
        _padded(inputs, input_length, PAD).alias("input_ids"),
        _mask(inputs, input_length).alias("attention_mask"),
        _padded(labels, label_length, PAD).alias("labels"),
    )


def decode_tokens(df: DataFrame, ids_col: str, vocab: DataFrame, key: Sequence[str] = ("ident",),
                  lookup: bool = False) -> DataFrame:
    """Ids back to text, one space between tokens, special and unknown ids dropped; null ids give an empty text.

    ``lookup`` as for ``tokenize``. Rows with one key are told apart by their ids, and equal rows are given back.
    """
    key = list(key)
    wanted = F.filter(F.coalesce(F.col(ids_col), F.array().cast("array<int>")), lambda i: i >= len(SPECIAL_TOKENS))
    if lookup:
        rows = vocab.select("token", "id").limit(LOOKUP_ROWS + 1).collect()
        if len(rows) > LOOKUP_ROWS or any(not 0 <= r["id"] < 2 * LOOKUP_ROWS for r in rows):
            raise ValueError(f"a lookup takes at most {LOOKUP_ROWS} tokens; join a larger vocabulary")
        by_id: list[str | None] = [None] * (max((r["id"] for r in rows), default=0) + 1)
        for row in rows:
            by_id[row["id"]] = row["token"]
        table = F.from_json(F.lit(json.dumps(by_id)), "array<string>")
        return df.select(*key, F.array_join(F.transform(wanted, lambda i: F.get(table, i)), " ").alias("text"))
    exploded = _rows_once(df.select(*key, wanted.alias("_ids")), key, ["_ids"]).select(
        *key, "_row", "_copies", F.posexplode_outer("_ids").alias("_pos", "id"))
    found = exploded.join(vocab.select("id", "token").distinct(), "id", "left")
    entry = F.when(F.col("token").isNotNull(), F.struct(F.col("_pos").alias("p"), F.col("token").alias("t")))
    # A row holds at most the encoder's limit of ids.
    return (
        found.groupBy(*key, "_row").agg(
            F.first("_copies").alias("_copies"),
            F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]), " ").alias("text"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*key, "text")
    )


def argmax(logits: Column | str) -> Column:
    """Index of the largest logit, the first one on ties."""
    logits = F.col(logits) if isinstance(logits, str) else logits
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def token_accuracy(predictions: DataFrame, mask_pad: bool = False, pad_id: int = PAD) -> DataFrame:
    """Mean over examples of the share of right tokens, the share over all tokens, and the number of examples.

    ``predictions``: ident, pos, label_id and either pred_id or logits. Padding counts unless ``mask_pad``.
    """
    predicted = F.col("pred_id") if "pred_id" in predictions.columns else argmax("logits")
    rows = predictions.where(F.col("label_id") != pad_id) if mask_pad else predictions
    per_example = rows.groupBy("ident").agg(
        F.count_if(predicted == F.col("label_id")).alias("_right"), F.count("*").alias("_n")
    )
    return per_example.agg(
        F.avg(F.col("_right") / F.col("_n")).alias("accuracy"),
        (F.sum("_right") / F.sum("_n")).alias("micro_accuracy"),
        F.count("*").alias("examples"),
    )
