"""Periodic runs against brute force over all periods."""

import hashlib
import random
import zlib

import pytest

from pairloom.llm import periodic_runs
from pairloom.llm.queries import QUERIES


def brute_runs(words):
    """(start, length, period) of every run, by trying every period."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)  # the smallest period comes first
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_words(text):
    return (text or "").encode("utf-8", "surrogatepass").split()


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone).decode("utf-8", "surrogatepass")


def brute_digest(doc_id, text):
    words = brute_words(text)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = None
    for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(brute_collapsed(words, runs).encode("utf-8", "surrogatepass")).hexdigest())


def some_text(seed):
    draw = random.Random(seed)
    words = []
    while len(words) < draw.choice([5, 60, 400]):
        kind = draw.random()
        if kind < 0.4:
            words += [draw.choice("abcdefgh") for _ in range(draw.randint(1, 30))]
        elif words and kind < 0.6:
            at = draw.randrange(len(words))
            words += words[at:at + draw.randint(1, 40)]
        else:
            unit = [draw.choice("ab") for _ in range(draw.randint(1, 14))]
            words += (unit * 40)[:draw.randint(10, 90)]
    return " ".join(words)


@pytest.mark.parametrize("block", range(6))
def test_equals_brute_force_on_random_texts(block):
    texts = [some_text(block * 100 + i) for i in range(60)]
    for text, (runs, rest) in zip(texts, periodic_runs.periodic(texts)):
        words = brute_words(text)
        assert runs == brute_runs(words)
        assert rest == brute_collapsed(words, runs)


@pytest.mark.parametrize("text", [
    "a " * 24, "a " * 23, "a b " * 12, "a b c d e f g h i " * 3, "a b c d e f g h i " * 2 + "a b c d e f g h",
    "x " + "a b a b a b a b " * 9 + "y", "a " * 30 + "b " * 30, ("a " * 24 + "b ") * 4, "a a b " * 5 + "a a c " * 4 + "a a b " * 20,
    "", " \n\t", "w", "    " * 20, "a\x0bb\x0cc\rd " * 9, "a " * 5000 + "b " * 5000,
])
def test_edges(text):
    [(runs, rest)] = periodic_runs.periodic([text])
    words = brute_words(text)
    assert runs == brute_runs(words)
    assert rest == brute_collapsed(words, runs)


def test_thue_morse_words_and_long_text():
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    morse = " ".join("ab"[b] for b in bits)
    long = " ".join(str(i % 997) for i in range(60_000)) + " " + " ".join(str(i) for i in range(60_000))
    (none, same), (one, _) = periodic_runs.periodic([morse, long])
    assert (none, same) == ([], morse)
    assert one == [(0, 60_000, 997)]


def test_texts_of_a_batch_do_not_meet():
    half = "a b c " * 6
    assert [runs for runs, _ in periodic_runs.periodic([half, half, half * 2, None, half])] == [[], [], [(0, 36, 3)], [], []]


def test_no_texts():
    assert periodic_runs.periodic([]) == []


def test_columns_rows_and_nulls(frame):
    rows = [(1, "a " * 24, "x"), (1, "a " * 24, "x"), (None, "b c " * 20, "y"), (2, None, "z"), (3, "", None)]
    docs = frame(rows, "doc_id long, text string, runs string")
    found = periodic_runs.find_runs(docs)
    assert found.columns == ["doc_id", "text", "runs", "collapsed"]
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()), key=repr)
    assert got == sorted([(1, [(0, 24, 1)], "a"), (1, [(0, 24, 1)], "a"), (None, [(0, 40, 2)], "b c"), (2, [], ""), (3, [], "")], key=repr)
    kept = periodic_runs.collapse_runs(docs)
    assert kept.columns == docs.columns
    assert sorted((r.text for r in kept.collect()), key=repr) == sorted(["a", "a", "b c", None, ""], key=repr)


def test_empty_table(frame, spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.digests(periodic_runs.find_runs(periodic_runs.planted(docs))).count() == 0


def test_query_equals_brute_force(spark, sf, documents):
    got = [tuple(r) for r in QUERIES["op11_periodic_runs"](spark, sf).collect()]
    assert sum(r[1] > 0 for r in got) > 5
    assert sorted(got, key=repr) == sorted((brute_digest(i, t) for i, t in documents), key=repr)
