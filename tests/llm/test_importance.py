"""Importance weights against plain counting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pairloom.llm import importance
from pairloom.llm.queries import QUERIES

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def brute_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_grams(text, low=1, high=1):
    words = brute_words(text)
    return [" ".join(words[i:i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def brute(documents, targets, buckets=10_000, low=1, high=1, min_words=20, share=10, seed=2024):
    def counts(texts):
        return Counter(zlib.crc32(g.encode()) % buckets for text in texts for g in brute_grams(text, low, high))

    s, t = counts(text for _, text in documents), counts(targets)
    total_s, total_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in documents:
        grams = brute_grams(text, low, high)
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
            for b in (zlib.crc32(g.encode()) % buckets for g in grams))
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), text))
    able = sorted((r for r in rows if len(brute_words(r[4])) >= min_words),
                  key=lambda r: (-r[3], r[0] is not None, r[0]))
    rank = {r[0]: n for n, r in enumerate(able[:share * len(able) // 100], 1)}
    return sorted((r[:4] + (rank.get(r[0]),) for r in rows), key=repr)


def test_query_equals_plain_counting(spark, sf, documents):
    targets = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op12_importance"](spark, sf).collect()]
    assert sorted(got, key=repr) == brute(documents, targets)
    assert sum(r[4] is not None for r in got) > 10


def test_longer_runs_and_other_parameters(frame):
    draw = random.Random(3)
    documents = [(i, " ".join(draw.choice("a b c D é Z9".split()) for _ in range(draw.randrange(40)))) for i in range(60)]
    targets = [(1, "a b c"), (2, "é z9 é z9"), (3, None)]
    parameters = {"buckets": 97, "low": 1, "high": 3, "min_words": 5, "share": 50, "seed": 5}
    got = importance.importance(frame(documents), frame(targets), **parameters).collect()
    assert sorted(map(tuple, got), key=repr) == brute(documents, [t for _, t in targets], **parameters)


def test_table_interns_by_bytes():
    draw = random.Random(1)
    grams = [bytes(draw.choices(b"ab", k=draw.randrange(1, 7))) for _ in range(5_000)]
    table = importance.Interned(grams, 50)
    slots = {}
    for gram, slot in zip(grams, table.slot.tolist()):
        assert slots.setdefault(gram, slot) == slot
    assert len(set(slots.values())) == len(slots)
    assert all(table.count[slots[g]] == n and table.bucket[slots[g]] == zlib.crc32(g) % 50 for g, n in Counter(grams).items())


def test_equal_keys_with_other_bytes_get_other_slots(monkeypatch):
    monkeypatch.setattr(importance.xxhash, "xxh64_intdigest", lambda gram: len(gram) % 2)
    grams = [b"a", b"b", b"aa", b"a", b"c", b"bb", b"aa"] * 3
    table = importance.Interned(grams, 10)
    assert len(set(zip(grams, table.slot.tolist()))) == len(set(grams)) == len(set(table.slot.tolist()))


def test_nothing_to_intern():
    assert importance.Interned([], 10).count.sum() == 0


@pytest.mark.parametrize("documents, targets", [
    ([], [(1, "a b")]), ([(1, "w " * 30), (2, None), (3, ""), (4, "!?"), (None, "w " * 25)], []),
])
def test_empty_tables_and_texts(frame, documents, targets):
    got = importance.importance(frame(documents), frame(targets), share=100).collect()
    assert sorted(map(tuple, got), key=repr) == brute(documents, [t for _, t in targets], share=100)


def test_ties_go_to_the_smaller_id_and_repeated_rows_are_rows(frame):
    rows = [(7, "x " * 20)] * 3 + [(3, "x " * 20)] * 2
    got = sorted((r.rank, r.doc_id) for r in importance.importance(frame(rows), frame([(1, "y")]), share=100).collect())
    assert [n for n, _ in got] == [1, 2, 3, 4, 5]
    assert [i for _, i in got] in ([7, 7, 7, 3, 3], [3, 3, 7, 7, 7])


def test_resample_prefers_the_target_and_keeps_columns(frame):
    rows = [(i, ("target words here " if i % 4 == 0 else "other noise there ") * 20, "r") for i in range(80)]
    docs = frame(rows, "doc_id long, text string, rank string")
    kept = importance.resample(docs, frame([(1, "target words here " * 50)]), share=25)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(80) if i % 4 == 0]


def test_gains_of_all_buckets(frame):
    gain = importance.gains(frame([(1, "a a b")]), frame([(1, "a")]), buckets=11)
    assert gain.shape == (11,) and gain.dtype == np.int64
