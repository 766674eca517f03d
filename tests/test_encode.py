import re

import pytest

from pairloom import schemas
from pairloom.operators import encode as E

TEXTS = {"1": "int a = 12;\n\tb(a)", "2": "", "3": "ß_x日本 99foo", "4": "a a a b"}
PATTERN = re.compile(E.TOKEN_PATTERN)


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(list(TEXTS.items()), "ident string, text string")


def test_vocab_and_tokenize(texts, rows):
    counts = {}
    for t in TEXTS.values():
        for token in PATTERN.findall(t):
            counts[token] = counts.get(token, 0) + 1
    ranked = sorted(counts, key=lambda t: (-counts[t], t.encode()))[:6]
    vocab = E.build_vocab(texts, ["text"], 6)
    ids = {t: 4 + i for i, t in enumerate(ranked)}
    assert {r.token: r.id for r in vocab.collect()} == ids
    got = {r.ident: r.input_ids for r in E.tokenize(texts, "text", vocab, max_len=7).collect()}
    assert got == {k: [1, *[ids.get(t, 3) for t in PATTERN.findall(v)][:5], 2] for k, v in TEXTS.items()}


def test_round_trip(texts):
    vocab = E.build_vocab(texts, ["text"], 1000)
    decoded = E.decode_tokens(E.tokenize(texts, "text", vocab), "input_ids", vocab)
    assert {r.ident: r.text for r in decoded.collect()} == {k: " ".join(PATTERN.findall(v)) for k, v in TEXTS.items()}


def test_padding(spark, rows):
    df = spark.createDataFrame([("a", [1, 2]), ("b", [1, 5, 6, 7, 2])], "ident string, input_ids array<int>")
    assert rows(E.pad_longest(df), "ident", "input_ids", "attention_mask") == [
        ("a", [1, 2, 0, 0, 0], [1, 1, 0, 0, 0]), ("b", [1, 5, 6, 7, 2], [1, 1, 1, 1, 1])]
    assert rows(E.pad_longest(df, bucket=4), "ident", "input_ids") == [("a", [1, 2, 0, 0]), ("b", [1, 5, 6, 7, 2, 0, 0, 0])]


def test_encode_dataset(spark):
    data = [("a", "c", "x", "int s", "undefined d d", ("p", 0)), ("a", "c", "y", "s", "d", ("p", 1))]
    examples = spark.createDataFrame(data, schemas.EXAMPLES)
    vocab = E.build_vocab(examples, ["source", "decompiled"], 100)
    ids = {r.token: r.id for r in vocab.collect()}
    got = {r.ident: r for r in E.encode_dataset(examples, vocab).collect()}
    assert got["y"].input_ids == [1, ids["d"], 2, 0, 0] and got["y"].attention_mask == [1, 1, 1, 0, 0]
    assert got["x"].labels == [1, ids["int"], ids["s"], 2] and got["y"].labels == [1, ids["s"], 2, 0]
    bucketed = {r.ident: r for r in E.encode_dataset(examples, vocab, bucket=8).collect()}
    assert len(bucketed["x"].input_ids) == len(bucketed["x"].labels) == 8
    with pytest.raises(ValueError):
        E.encode_dataset(examples.limit(0), vocab)


def test_lookup_and_join_give_the_same_rows(spark, texts, rows, monkeypatch):
    more = texts.unionByName(spark.createDataFrame(
        [("5", None), ("1", "int b"), ("1", "int b"), ("6", "  "), (None, "a")], "ident string, text string"))
    vocab = E.build_vocab(texts, ["text"], 100)
    ids = E.tokenize(more, "text", vocab, lookup=True)
    assert rows(ids) == rows(E.tokenize(more, "text", vocab)) and ids.count() == 9
    assert [r.input_ids for r in ids.where("ident = '5'").collect()] == [[1, 2]]
    holes = ids.unionByName(spark.createDataFrame([("7", None), ("8", [])], "ident string, input_ids array<int>"))
    text = rows(E.decode_tokens(holes, "input_ids", vocab, lookup=True))
    assert text == rows(E.decode_tokens(holes, "input_ids", vocab)) and ("7", "") in text and ("8", "") in text
    monkeypatch.setattr(E, "LOOKUP_ROWS", 2)
    for call in (lambda: E.tokenize(more, "text", vocab, lookup=True),
                 lambda: E.decode_tokens(ids, "input_ids", vocab, lookup=True)):
        with pytest.raises(ValueError, match="lookup"):
            call()


def test_tokenizer_of_the_caller(spark, rows):
    df = spark.createDataFrame([("a", "one three"), ("b", ""), ("c", None)], "ident string, text string")
    call = lambda texts: [[len(w) for w in t.split()] for t in texts]
    ids = E.tokenize_with(df, "text", call, max_len=1)
    assert rows(ids) == [("a", [3]), ("b", []), ("c", [])]
    back = lambda ids: ["-".join(map(str, i)) for i in ids]
    assert rows(E.decode_with(ids, "input_ids", loader=lambda: back)) == [("a", "3"), ("b", ""), ("c", "")]
    with pytest.raises(ValueError):
        E.tokenize_with(df, "text")


def test_accuracy(spark):
    data = [("a", 0, 1, 1), ("a", 1, 2, 1), ("a", 2, 0, 0), ("b", 0, 3, 3)]
    predictions = spark.createDataFrame(data, schemas.PREDICTIONS)
    got = E.token_accuracy(predictions).first()
    assert (round(got.accuracy, 9), got.micro_accuracy, got.examples) == (round((2 / 3 + 1) / 2, 9), 0.75, 2)
    assert E.token_accuracy(predictions, mask_pad=True).first().accuracy == 0.75
    logits = spark.createDataFrame([("a", 0, [0.1, 0.9], 1), ("a", 1, [0.5, 0.5], 1)],
                                   "ident string, pos int, logits array<double>, label_id int")
    assert E.token_accuracy(logits).first().accuracy == 0.5


def test_join_carries_no_arrays_with_each_token(spark):
    """An exploded token has its row's key and place, not the text's whole array; one shuffle deals the rows."""
    vocab = spark.createDataFrame([("a", 4), ("b", 5)], "token string, id int")
    df = spark.createDataFrame([(1, "a b a"), (1, "a b a"), (1, "b"), (None, ""), (2, None)], "ident int, text string")
    ids = E.tokenize(df, "text", vocab, lookup=False)
    assert sorted((r["ident"] or 0, r["input_ids"]) for r in ids.collect()) == [
        (0, [1, 2]), (1, [1, 4, 5, 4, 2]), (1, [1, 4, 5, 4, 2]), (1, [1, 5, 2]), (2, [1, 2])]
    plan = ids._jdf.queryExecution().executedPlan().toString()
    carried = [line for line in plan.splitlines() if "Generate posexplode" in line]
    assert carried and all("_s#" not in line.split("), [", 1)[1] and "_tokens#" not in line.split("), [", 1)[1]
                           for line in carried)
    back = E.decode_tokens(ids, "input_ids", vocab, lookup=False)
    assert sorted((r["ident"] or 0, r["text"]) for r in back.collect()) == [
        (0, ""), (1, "a b a"), (1, "a b a"), (1, "b"), (2, "")]


def test_quick_pattern_cuts_the_same_tokens(spark):
    from pyspark.sql import functions as F
    texts = ["a1_b 12ab _9 9_ x", "\u00e9t\u00e9 \u0663\u0664 \U0001f600ab\n\r\t\u2028 12\u00bd", "", " ", "__a__0 0x1F;{}()''", "\u00aa\u0130k\u017f9"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.regexp_extract_all("text", F.lit(E.TOKEN_PATTERN), F.lit(0))
    assert df.where(E.tokens("text") != plain).count() == 0
