"""Packing: nothing lost, nothing twice, no padding, and neighbours by BM25."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from pairloom.llm import retrieval_packing as packing
from pairloom.llm.queries import QUERIES

PATH = packing.tokenizer_path()


PLAIN = Tokenizer.from_file(PATH)


def plain_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [1]


def check_pieces(rows, ids_of, length):
    """Every id of every document in one piece; sequences gapless and full, or of a power of two."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length > 0
        ids = ids_of[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids_of)
    for doc_id, own in pieces.items():
        assert tiled(own) == len(ids_of[doc_id])
    for own in sequences.values():
        size = tiled(own)
        assert size == length or (size < length and size & (size - 1) == 0)
    return sequences


def tiled(parts):
    end = 0
    for start, size in sorted(parts):
        assert start == end
        end += size
    return end


def test_query_holds_all_ids_once(spark, sf, documents):
    rows = QUERIES["op13_retrieval_packing"](spark, sf).collect()
    sequences = check_pieces(rows, {i: plain_ids(t) for i, t in documents}, 2048)
    tokens = sum(r.length for r in rows)
    assert sum(sum(n for _, n in own) == 2048 for own in sequences.values()) * 2048 > 0.8 * tokens


@pytest.mark.parametrize("text", [
    None, "", " \t", "Hello, World. It's 'S mr. X.", "a,b ,. .,x ,x. x,. 1, 2.5.", "É,é é, İ ́a ﬁ K",
    "x<|endoftext|>Y <|ENDOFTEXT|> z", "a.. b., c,. d.\te,\rf.", "end.", "3.14, 2,5. x.y,z.", "no break em\u0085next\x1cunit", "ß ſ Σίσυφος ΣΊΣΥΦΟΣ, 東京。", "\U0001f600, \U0001f468‍\U0001f469.",
])
def test_ids_equal_the_tokenizers(text):
    [data] = packing.Tokens(PATH).encode([None if text is None else text.encode()])
    assert np.frombuffer(data, "<u2").tolist() == plain_ids(text)


def test_words_of_latin_letters_take_a_shorter_way_to_the_same_ids():
    tokens = packing.Tokens(PATH)
    assert tokens.short
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    words = letters + [a + b for a in "az\u00e9\u00df\u0130" for b in letters] + ["".join(letters[i:i + 7]) for i in range(0, len(letters), 3)]
    for data, word in zip(tokens.encode([w.encode() for w in words]), words):
        assert np.frombuffer(data, "<u2").tolist() == plain_ids(word)


def test_remembered_words_do_not_change_ids(documents, monkeypatch):
    tokens = packing.Tokens(PATH)
    texts = [t for _, t in documents]
    for remembered in (10**6, 500, 500, 500):  # few, so that words are forgotten and met again
        monkeypatch.setattr(packing, "REMEMBERED", remembered)
        for data, text in zip(tokens.encode([(t or "").encode() for t in texts]), texts):
            assert np.frombuffer(data, "<u2").tolist() == plain_ids(text)


def brute_score(rests, query, k):
    n, mean = len(rests), sum(map(len, rests)) / len(rests)
    total = 0.0
    for term in set(query):
        holding = sum(term in r for r in rests)
        times = rests[k].count(term)
        rare = math.log(1 + (n - holding + 0.5) / (holding + 0.5))
        total += rare * times * 2.2 / (times + 1.2 * (1 - 0.75 + 0.75 * len(rests[k]) / mean))
    return total


def test_scores_are_bm25():
    draw = random.Random(4)
    rests = [[draw.randrange(30) for _ in range(draw.randint(1, 20))] for _ in range(25)]
    index = packing.Index([np.array(r, np.uint16) for r in rests])
    query = [3, 7, 29, 500]
    want = [brute_score(rests, query, k) for k in range(25)]
    assert np.allclose(index.scores(np.array(query)), want)
    unused = np.arange(25) % 3 == 0
    index.keep(unused)
    assert np.allclose(index.scores(np.array(query)), np.array(want)[unused])


def brute_windows(rests, length):
    """The greedy rule, one window after the other, over one shard."""
    unused, done, window, room, query = set(range(len(rests))), [], [], length, None

    def close():
        nonlocal window, room
        done.append(window)
        window, room = [], length

    while unused:
        if not window:
            seed = min(unused)
            unused.discard(seed)
            window, room, query = [(seed, 0, len(rests[seed]))], length - len(rests[seed]), rests[seed]
        order = sorted(unused, key=lambda k: (-round(brute_score(rests, query, k), 9), k))
        for k in order:
            unused.discard(k)
            cut = min(room, len(rests[k]))
            window.append((k, 0, cut))
            room -= cut
            if cut < len(rests[k]):
                close()
                window, room, query = [(k, cut, len(rests[k]))], length - len(rests[k]) + cut, rests[k][cut:]
                break
            if not room:
                close()
                break
    return done, window


@pytest.mark.parametrize("seed", range(4))
def test_windows_follow_the_greedy_rule(seed):
    draw = random.Random(seed)
    rests = [[draw.randrange(200) for _ in range(draw.randint(1, 15))] for _ in range(90)]
    packer = packing.Packer(16)
    done = list(packer.pack(list(range(90)), [np.array(r, np.uint16) for r in rests]))
    want, open_window = brute_windows(rests, 16)
    # A cut of exactly nothing does not occur: a rest that no longer fits opens the next window whole.
    assert [[p for p in w if p[1] < p[2]] for w in done] == [[p for p in w if p[1] < p[2]] for w in want]
    assert packer.window == open_window


def test_open_window_becomes_powers_of_two():
    packer = packing.Packer(16)
    packer.window, packer.room = [("a", 0, 6), ("b", 2, 7)], 5
    assert list(packer.rest()) == [[("a", 0, 6), ("b", 2, 4)], [("b", 4, 6)], [("b", 6, 7)]]


def test_shards_ties_repeats_nulls_and_other_columns(spark, frame):
    texts = ["", None, "one word", "w " * 700, "same text here " * 9] * 6
    rows = [(n // 2, t, "z") for n, t in enumerate(texts)] + [(None, "null id " * 5, None)]
    docs = frame(rows, "doc_id long, text string, ids string")
    got = packing.pack(docs, length=64, shard=5).collect()
    tokens = Counter()
    for r in got:
        tokens.update(np.frombuffer(bytes(r.ids), "<u4").tolist())
    want = Counter()
    for _, t, _ in rows:
        want.update(plain_ids(t))
    assert tokens == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert all((n := tiled(own)) == 64 or n & (n - 1) == 0 for own in sequences.values())


def test_neighbours_share_windows(frame):
    draw = random.Random(8)
    topics = [[f"{'abcdefgh'[t] * 3}{w}x" for w in "klmnopqr"] for t in range(8)]
    rows = [(n, " ".join(draw.choice(topics[n % 8]) for _ in range(40))) for n in range(160)]
    got = packing.pack(frame(rows).coalesce(1), length=512).collect()
    sequences = defaultdict(Counter)
    for r in got:
        sequences[r.sequence_id][r.doc_id % 8] += r.length
    pure = sum(max(c.values()) for c in sequences.values()) / sum(sum(c.values()) for c in sequences.values())
    assert pure > 0.6  # an eighth if documents were packed as they come


def test_empty_table_and_wrong_length(frame):
    assert packing.pack(frame([])).count() == 0
    with pytest.raises(ValueError):
        packing.pack(frame([]), length=100)
