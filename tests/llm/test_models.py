"""Language id, secrets and personal data: held-out accuracy, base spans against plain patterns, edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import brute
from pairloom.llm import language_id, pii, secrets
from pairloom.llm.spans import Cover, sample_bound

# Language id


def test_language_of_held_out_documents(spark, sf):
    got = entry.queries()["op1_language_id"](spark, sf).collect()
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and {r["held_out"] == brute.held_out(r["doc_id"]) for r in got} == {True}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_window_vectors_are_bound_and_bundled():
    v = {c: language_id._letter_vector(ord(c)).astype(int) for c in " ab"}
    grams = [" ab", "ab "]
    want = sum(np.roll(v[g[0]], 2) * np.roll(v[g[1]], 1) * v[g[2]] for g in grams)
    for text in ("ab", "AB", "  a9b".replace("9", ""), "ab!?"):
        (_, got), = language_id.vectors([text])
        assert (got == want).all()


def test_long_text_is_the_sum_of_its_parts(monkeypatch):
    text = " ".join(random.Random(1).choice(["lorem", "ipsum", "dolor"]) for _ in range(200))
    (_, whole), = language_id.vectors([text])
    monkeypatch.setattr(language_id, "GROUP_CHARS", 100)
    (_, cut), = language_id.vectors([text])
    assert float(whole @ cut / np.linalg.norm(whole) / np.linalg.norm(cut)) > 0.99
    assert [i for i, _ in language_id.vectors(["a", text, None, "b"])] == sorted([0, 1, 2, 3])


def test_language_edges(spark, frame):
    rows = [(1, "the cat and the hat", "en", "s", 1), (2, "le chat et le chapeau", "fr", "s", 1), (3, None, "en", "s", 1),
            (4, "123 !?", "en", "s", 1), (5, "the dog", None, "s", 1), (None, "le chien", "fr", "s", 1), (1, "the cat", "en", "s", 1)]
    docs = frame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("x"))
    profile = language_id.learn(language_id.training_rows(docs))
    got = language_id.predict(docs, profile)
    assert got.count() == len(rows) and dict(got.dtypes)["score"] == "double"
    by = {r["doc_id"]: r["lang_pred"] for r in got.collect()}
    assert by[3] == by[4] == "und" and by[5] == "en" and by[None] == "fr"
    assert language_id.learn(docs.limit(0)) == {}
    assert {r["lang_pred"] for r in language_id.predict(docs, {}).collect()} == {"und"}
    with pytest.raises(ValueError):
        language_id.learn(docs.select("lang", "text").where("lang is not null"), max_languages=1)


def test_sample_is_bounded(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"))
    assert 800 < docs.where(sample_bound(4000, 1000)).count() < 1200
    assert docs.where(sample_bound(4000, 5000)).count() == 4000


# Base spans

SECRET_TEXTS = ["token = 'abcdef123'", "API_KEY:\"x\" secret= abc", "AKIA" + "A" * 16 + " AKIAB", "f" * 24 + "g" + "0" * 23,
                "paſſword=abcdefgh", "toKen=tokentoken=abcdefg", "password password=123456", "x" * 500 + "deadbeef" * 5, ""]
PERSONAL_TEXTS = ["a@b.c a@b @c.d x@y.z@w.v", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111-1111 1111 5", "+1 (234) 555-0199 +12 +1--",
                  "9" * 5000 + ".1.1.1", "é@x.de ü.a@b-c.d-e.f", "1" * 16 + " +" + "1" * 20, ""]


@pytest.mark.parametrize("module,plain,texts", [(secrets, brute.secret_spans, SECRET_TEXTS),
                                                (pii, brute.personal_spans, PERSONAL_TEXTS[:4] + PERSONAL_TEXTS[5:])])
def test_base_spans_equal_plain_patterns(module, plain, texts):
    r = random.Random(3)
    alphabet = "aAfF019.@+-_ ()=:\"'é" + "token"
    texts = texts + ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 60))) for _ in range(3000)]
    for text in texts:
        assert sorted(module.base_spans(text)) == sorted(plain(text)), text


def test_base_spans_are_linear():
    for text in ("9" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "a@" * 100_000, "+1" + " " * 200_000):
        pii.base_spans(text)
        secrets.base_spans(text)
        list(secrets.candidates(text))


def test_base_digests_over_the_whole_table(spark, sf, documents):
    texts = dict(documents)
    for name, plain in (("op4_secrets", brute.secret_spans), ("op9_personal_data", brute.personal_spans)):
        got = entry.queries()[name](spark, sf).collect()
        assert len(got) == len(texts)
        for r in got:
            base = plain(texts[r["doc_id"]] or "")
            assert r["base_sha256"] == brute.span_digest(base)
            assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r["spans"].split(","))


# Networks


def test_convolution_learns_to_tell_keys_from_words(spark, frame):
    r = random.Random(7)
    rows = []
    for i in range(300):
        key = "".join(r.choice("0123456789abcdef") for _ in range(32))
        prose = " ".join("".join(r.choice("aeioulmnrst") for _ in range(r.randrange(3, 12))) for _ in range(60))
        rows.append((i, f"{prose} token = {key} {prose} ref-2020-section-{i:04d}-of-the-manual {prose}"))
    net = secrets.fit(frame(rows))
    assert np.isfinite(net.threshold) and net.threshold >= secrets.LEAST
    extra = [(1000, "see aB3dE5fG7hJ9kL2mN4pQ6rS8 here"), (1001, None), (1002, "plain words only")]
    got = {r["doc_id"]: r for r in secrets.find_secrets(frame(extra).withColumn("spans", F.lit(1)), net).collect()}
    assert got[1001]["spans"] == got[1002]["spans"] == ""
    codes, mark = secrets.encoded(secrets.windows("key 0123456789abcdef0123456789abcdee x", 4, 36))
    assert net.probability(net.forward(codes, mark)[0].astype(float)).max() > 0.5


def test_all_findings_of_all_documents_are_learnt_from(spark):
    n = 52_000  # more than were ever drawn before
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("token=k"), F.lpad("id", 6, "0"), F.lit(" some words and a-long-other-word "), "id").alias("text"))
    by = {r["label"]: r["count"] for r in secrets.findings(docs).groupBy("label").count().collect()}
    assert by == {0: n, 1: n}


def test_shards_learn_together_whatever_the_partitions(frame, monkeypatch):
    monkeypatch.setattr(secrets, "SHARD_ROWS", 150)
    r = random.Random(3)
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(32))
    rows = [(i, f"we set token = {key()} and see ref-2020-section-{i:04d}-of-the-manual") for i in range(300)]
    one, other = secrets.fit(frame(rows)), secrets.fit(frame(rows[::-1]).repartition(7))
    assert all((one.w[k] == other.w[k]).all() for k in one.w) and one.threshold == other.threshold
    seen = secrets.windows(f"key {key()} x", 4, 36) + secrets.windows("by ref-2021-section-0001-of-the-manual", 3, 38)
    score = one.probability(one.scores(seen))
    assert one.threshold >= secrets.LEAST and score[0] > secrets.LEAST > score[-1]


def test_calibration_counts_every_finding():
    net = secrets.Network()
    net.calibrate(np.array([-2.0, -1.0, 1.0, 2.0, 3.0]), np.array([0, 0, 1, 1, 1.0]), np.array([900, 50, 1, 99, 900.0]))
    assert net.probability(1.0) < net.threshold == net.probability(2.0)


def test_long_words_are_whole_words():
    text = "é a-very-long-word-of-text\u00a0x \n\tshort " + "x" * 16 + "\x0b" + "y" * 15
    assert [text[s:e] for s, e in secrets.long_words(text)] == ["a-very-long-word-of-text\u00a0x", "x" * 16]


def test_convolution_gradients():
    net = secrets.Network()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    codes, mark = secrets.encoded([("x" * 24 + "abc123" + " " * 20, 24, 30), ("hello", 0, 5)])
    label = np.array([1.0, 0.0])

    def loss():
        s = net.forward(codes, mark)[0]
        return float(np.sum(np.logaddexp(0, s) - label * s))

    score, kept = net.forward(codes, mark)
    grads = net.gradients(codes, kept, 1 / (1 + np.exp(-score)) - label)
    for name in ("filter", "out", "shift", "embed"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        net.w[name][at] += 1e-5
        up = loss()
        net.w[name][at] -= 2e-5
        down = loss()
        net.w[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-3 * max(1, abs(grads[name][at]))


def test_windows_cover_a_long_candidate():
    text = "a1" * 300
    seen = set()
    for chars, start, end in secrets.windows(text, 0, len(text)):
        assert end <= len(chars)
        seen.add(end - start)
    assert len(secrets.windows(text, 0, len(text))) >= len(text) // secrets.MIDDLE


def test_nothing_to_learn_from(spark, frame):
    docs = frame([(1, "plain words"), (2, None)])
    assert secrets.find_secrets(docs, secrets.fit(docs)).count() == 2
    assert pii.find_personal(docs, pii.fit(docs)).count() == 2
    none = docs.limit(0)
    assert secrets.find_secrets(none, secrets.fit(none)).count() == pii.find_personal(none, pii.fit(none)).count() == 0


def test_crf_gradients():
    tagger = pii.Tagger()
    tagger.w = {k: v.astype(np.float64) for k, v in tagger.w.items()}
    codes = pii.encoded(["mail me 12@x.de now", "call +1 234"])
    tags, mask = np.zeros((2, pii.WINDOW), int), np.zeros((2, pii.WINDOW), bool)
    tags[0, 8:15], tags[0, 8] = 2, 1
    mask[0, :19], mask[1, :11] = True, True

    def loss():
        score = tagger.scores(codes)[0]
        total = 0.0
        for b in range(2):
            n = int(mask[b].sum())
            s, path = score[b, :n].astype(np.float64), tags[b, :n]
            ahead = s[0] + tagger.w["first"]
            gold = ahead[path[0]]
            for t in range(1, n):
                ahead = pii._logsum(ahead[:, None] + tagger.w["step"], 0) + s[t]
                gold += tagger.w["step"][path[t - 1], path[t]] + s[t, path[t]]
            total += pii._logsum(ahead, 0) - gold
        return total / 2

    grads = tagger.gradients(codes, tags, mask)
    for name in ("step", "first", "out", "hf", "xb", "embed"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        before = tagger.w[name][at]
        tagger.w[name][at] = before + 1e-3
        up = loss()
        tagger.w[name][at] = before - 1e-3
        down = loss()
        tagger.w[name][at] = before
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-2 * max(0.05, abs(grads[name][at])), name


def test_best_path_equals_all_paths():
    import itertools
    tagger, r = pii.Tagger(), np.random.default_rng(1)
    tagger.w["step"] = r.normal(size=(pii.TAGS, pii.TAGS))
    score = r.normal(size=(4, pii.TAGS))

    def value(path):
        return tagger.w["first"][path[0]] + sum(score[t, p] for t, p in enumerate(path)) + sum(
            tagger.w["step"][a, b] for a, b in zip(path, path[1:]))

    best = max(itertools.product(range(pii.TAGS), repeat=4), key=value)
    assert tuple(tagger.decode(score)) == best


def test_tagger_finds_held_out_addresses(spark, frame):
    r = random.Random(5)

    def document(i):
        prose = [" ".join("".join(r.choice("aeioulmnrst") for _ in range(r.randrange(2, 9))) for _ in range(20)) for _ in range(3)]
        return f"{prose[0]} {r.randrange(90)}@mail{i % 9}.example.com {prose[1]} +1 ({r.randrange(100, 999)}) 555-{r.randrange(1000, 9999)} {prose[2]}"

    tagger = pii.fit(frame([(i, document(i)) for i in range(250)]))
    texts = [document(i) for i in range(40)]
    right = total = 0
    for text, found in zip(texts, tagger.spans(texts)):
        base = set(pii.base_spans(text))
        total += len(base)
        right += len(base & set(found))
    assert right >= 0.8 * total


def test_cover():
    cover = Cover([("a", 5, 8), ("b", 1, 3), ("c", 7, 12)])
    for s in range(15):
        for e in range(s + 1, 16):
            assert cover.meets(s, e) == any(s < y and x < e for x, y in ((5, 12), (1, 3)))
