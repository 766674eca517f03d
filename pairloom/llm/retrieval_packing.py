"""Documents packed into sequences of ``LENGTH`` tokens, each window filled with what is lexically closest to its seed.

1. Every whole text is turned into token ids by the given tokenizer, and an end id is added. Whole windows of a long
   document are sequences of their own; the rest, shorter than a window, is to be packed.
2. Rests are put in the order of two min-hashes of their sets of ids, so that texts with much in common are neighbours,
   and cut into ranges of that order, one per task. Equal texts may be cut anywhere, so a range is never one text's.
3. A task packs ``SHARD`` rests at a time. A shard has an inverted index: per id the rests that hold it, each with its
   BM25 weight. A window's seed asks the index with all its ids; the unused rests, best first, are put into the window
   while they fit, and the next one is cut to fill it. What was cut off seeds the next window; without it the next unused
   rest does. The last window of a shard stays open for the next shard of the task.
4. Sequences have ``LENGTH`` tokens. The open window at the end of a task is cut into sequences of powers of two, so no
   sequence needs padding.

Text null or empty: only the end id, packed like any other. Repeated rows, or rows with equal ids: each is packed. Equal
scores go to the rest that comes first in the order. Very long texts: one row per whole window, no other limit; the
tokenizer gets each different word of a batch once and a worker remembers up to twice ``REMEMBERED`` words. Texts that hold
a special token's mark are tokenized whole. Empty input: empty result. Columns other than ``doc_id`` and
``text`` are not read. Sequence numbers are unique, not dense; they depend on the partitioning.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.llm.words import mixed
from pairloom.session import materialize

LENGTH = 2048
END = 1
SHARD = 4_096
# Of BM25: how soon repeats of a word count for less, and how much length counts.
K1, B = 1.2, 0.75
REMEMBERED = 500_000
TOKENIZER = "word_bpe_49k.json"

CUT = "doc_id {id}, start long, length long, doc_tokens long, number long, whole boolean, near_a long, near_b long, ids binary"
PIECE = "doc_id {id}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def names_of(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def numbers(data: bytes, length: int) -> np.ndarray:
    """So many ids from their bytes."""
    return np.frombuffer(data, "<u2" if len(data) == 2 * length else "<u4")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Tokens:
    """Ids of texts as bytes of 16-bit numbers (32-bit for a large vocabulary). Words between ASCII blanks are tokenized
    independently of each other, and small ASCII letters stand for capitals, which the tokenizer must allow
    (``independent``); otherwise whole texts are given to it."""

    _loaded: dict[str, "Tokens"] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one of many on its machine
        self.tokenizer = Tokenizer.from_file(path)
        self.kind, self.code = ("<u2", "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        self.known = Words()
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.independent = self._independent()
        # Latin letters may take the shorter way if the tokenizer does the same with them.
        self.short = all(self._short(w) == self._ids(w) for w in ("a", "word", "Gr\u00f6\u00dfe", "\u00c9t\u00e9s", "\u0141\u00f3d\u017a", "na\u00efvet\u00e9xq"))

    @classmethod
    def of(cls, path: str) -> "Tokens":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _independent(self) -> bool:
        """Whether blanks only separate, capitals do not matter, and a last comma or full stop is a token of its own."""
        probe = "Ab cd, É1x.\n\tAb  cd"
        whole = self._ids(probe)
        parts = ["ab", "cd", ",", "É1x", ".", "ab", "cd"]
        return whole == [i for part in parts for i in self._ids(part)]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _short(self, word: str) -> list[int]:
        """The ids of a word of Latin letters: one piece, whose bytes the model reads as the characters of ``BYTES``."""
        return [t.id for t in self.tokenizer.model.tokenize(word.lower().encode().decode("latin-1").translate(BYTES))]

    def _learn(self, words: list[bytes]) -> None:
        rest = []
        for word in words:
            text = word.decode("utf-8", "replace")
            if self.short and text.isalpha() and (text.isascii() or max(text) < "\u0250" and "\u0130" not in text):
                self.known[word] = array(self.code, self._short(text)).tobytes()
            else:
                rest.append((word, text))
        if rest:
            found = self.tokenizer.encode_batch_fast([text for _, text in rest], add_special_tokens=False)
            for (word, _), ids in zip(rest, found):
                self.known[word] = array(self.code, ids.ids).tobytes()

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of UTF-8 texts, each followed by the end id."""
        end = array(self.code, [END]).tobytes()
        known, held, out = self.known, [], []
        known.turn()
        for data in texts:
            small = (data or b"").lower()  # ASCII only
            if not self.independent or any(mark in small for mark in self.marks):
                ids = self._ids((data or b"").decode("utf-8", "replace"))
                held.append((None, [array(self.code, ids).tobytes()]))
                continue
            words = small.split()
            held.append((words, list(map(known.__getitem__, words))))
        if known.missed:
            self._learn(list(known.missed))
            known.missed.clear()
        for words, parts in held:
            if None in parts:
                at = -1
                try:
                    while True:
                        at = parts.index(None, at + 1)
                        parts[at] = known[words[at]]
                except ValueError:  # no further one
                    pass
            parts.append(end)
            out.append(b"".join(parts))
        return out


# How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on, in order.
_PLAIN_BYTES = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = {b: b if b in _PLAIN_BYTES else 256 + sum(c not in _PLAIN_BYTES for c in range(b)) for b in range(256)}


class Words(dict):
    """Ids of words as bytes. Of the words before the last ``REMEMBERED`` those met again move up; others are forgotten. A
    word that is not known is noted, and has no ids yet. One with a comma or full stop at its end has the ids of the word
    and of that sign."""

    def __init__(self) -> None:
        super().__init__()
        self.older: dict[bytes, bytes] = {}
        self.missed: set[bytes] = set()

    def __missing__(self, word: bytes) -> bytes | None:
        ids = self.older.get(word)
        if ids is None and len(word) > 1 and word[-1] in b",." and (97 <= word[-2] <= 122 or 48 <= word[-2] <= 57):
            parts = self[word[:-1]], self[word[-1:]]
            ids = parts[0] + parts[1] if None not in parts else None
        elif ids is None:
            self.missed.add(word)
        if ids is not None:
            self[word] = ids
        return ids

    def turn(self) -> None:
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()


def min_hashes(ids: np.ndarray) -> tuple[int, int]:
    """The least hash of the ids, and the least of another one: the halves of 64 bits."""
    hashed = mixed(ids + np.uint64(1 << 32))
    return int((hashed >> np.uint64(32)).min()), int(hashed.astype(np.uint32).min())


def cut_documents(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """One row per whole window and per rest of a document: doc_id, start, length, doc_tokens, a number of its own,
    ``whole``, two min-hashes of a rest, and the ids as bytes."""
    schema = CUT.format(id=docs.schema["doc_id"].dataType.simpleString())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, number = Tokens.of(path), TaskContext.get().partitionId() << 33
        size = np.dtype(tokens.kind).itemsize
        for batch in batches:
            row, out = [], [[] for _ in range(8)]
            for n, data in enumerate(tokens.encode(batch.column(1).cast(pa.binary()).to_pylist())):
                total = len(data) // size
                for start in range(0, total, length):
                    part = data[start * size:(start + length) * size]
                    whole = len(part) == length * size
                    near = (None, None) if whole else min_hashes(np.frombuffer(part, tokens.kind))
                    row.append(n)
                    for column, value in zip(out, (start, len(part) // size, total, number, whole, *near, part)):
                        column.append(value)
                    number += 1
            kinds = [pa.int64()] * 4 + [pa.bool_()] + [pa.int64()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), *map(pa.array, out, kinds)],
                names=names_of(CUT))

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


class Index:
    """Inverted index of a shard: per id the rests that hold it, with BM25 weights. The lists of frequent ids, which hold
    most of the entries, are kept as rows over all rests."""

    FREQUENT = 16  # an id is frequent if a rest in so many holds it

    def __init__(self, rests: list[np.ndarray]):
        n = len(rests)
        lengths = np.array([len(r) for r in rests], np.int64)
        key = np.concatenate(rests).astype(np.int64) * n + np.repeat(np.arange(n), lengths)
        key, times = np.unique(key, return_counts=True)
        term, self.rest = key // n, key % n
        self.first = np.concatenate([[0], np.cumsum(np.bincount(term))])
        holding = np.diff(self.first)
        rare = np.log1p((n - holding + 0.5) / (holding + 0.5))
        self.weight = rare[term] * times * (K1 + 1) / (times + K1 * (1 - B + B * lengths[self.rest] / lengths.mean()))
        self.n = n
        frequent = holding * self.FREQUENT > n
        self.row = np.where(frequent, np.cumsum(frequent) - 1, -1)
        self.rows = np.zeros((int(frequent.sum()), n))
        dense = frequent[term]
        self.rows[self.row[term[dense]], self.rest[dense]] = self.weight[dense]
        self._leave(~dense)

    def _leave(self, held: np.ndarray) -> None:
        self.first = np.concatenate([[0], np.cumsum(held)])[self.first]
        self.rest, self.weight = self.rest[held], self.weight[held]

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """The BM25 score of every rest that is left for a query of different ids."""
        ids = ids[ids < len(self.first) - 1]
        low, many = self.first[ids], self.first[ids + 1] - self.first[ids]
        at = np.arange(int(many.sum())) + np.repeat(low - np.cumsum(many) + many, many)
        rows = self.row[ids]
        # Rounded, so that equal scores are equal in whatever order they were added up.
        return np.round(np.bincount(self.rest[at], self.weight[at], self.n) + self.rows[rows[rows >= 0]].sum(axis=0), 9)

    def keep(self, kept: np.ndarray) -> None:
        """Leave the other rests out; those kept are numbered anew, in the same order."""
        self._leave(kept[self.rest])
        self.rest = (np.cumsum(kept) - 1)[self.rest]
        self.rows, self.n = np.compress(kept, self.rows, axis=1), int(kept.sum())


Piece = tuple[object, int, int]  # key of a rest, start in it, end in it


class Packer:
    """Fills windows from shard after shard. ``window`` is the open one."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.window: list[Piece] = []
        self.room = length
        self.query = np.zeros(0, np.int64)

    def _put(self, piece: Piece, ids: np.ndarray) -> None:
        if not self.window:
            self.query = np.unique(ids).astype(np.int64)
        self.window.append(piece)
        self.room -= piece[2] - piece[1]

    def _full(self) -> list[Piece]:
        done, self.window, self.room = self.window, [], self.length
        return done

    def pack(self, keys: list, rests: list[np.ndarray]) -> Iterator[list[Piece]]:
        """The windows filled with a shard's rests, each shorter than a window."""
        index, unused = Index(rests), np.ones(len(rests), bool)
        lengths = np.array([len(r) for r in rests], np.int64)
        alive = np.arange(len(rests))  # what the index holds
        left, seed = len(rests), 0
        while left:
            if not self.window:
                while not unused[seed]:
                    seed += 1
                unused[seed] = False
                left -= 1
                self._put((keys[seed], 0, int(lengths[seed])), rests[seed])
            if left < 0.9 * len(alive):
                kept = unused[alive]
                index.keep(kept)
                alive = alive[kept]
            scores = np.where(unused[alive], index.scores(self.query), -1.0)
            best = alive[self._best(scores, lengths[alive], left)]
            fitting = int(np.searchsorted(np.cumsum(lengths[best]), self.room, side="right"))
            for k in best[:fitting].tolist():
                self._put((keys[k], 0, int(lengths[k])), rests[k])
            unused[best[:fitting]] = False
            left -= fitting
            if not self.room:
                yield self._full()
            elif fitting < len(best):
                k, end = int(best[fitting]), self.room
                unused[k] = False
                left -= 1
                self._put((keys[k], 0, end), rests[k])
                yield self._full()
                self._put((keys[k], end, int(lengths[k])), rests[k][end:])

    def _best(self, scores: np.ndarray, lengths: np.ndarray, left: int) -> np.ndarray:
        """Unused rests by score, then place: as many as overflow the window, or all. A used one has a score below 0."""
        take = 32
        while take < left:
            among = np.flatnonzero(scores >= np.partition(scores, len(scores) - take)[len(scores) - take])
            if lengths[among].sum() > self.room:
                return among[np.argsort(-scores[among], kind="stable")]
            take *= 8
        return np.argsort(-scores, kind="stable")[:left]

    def rest(self) -> Iterator[list[Piece]]:
        """The open window as sequences of powers of two."""
        size, waiting = self.length, list(self.window)
        while waiting:
            while size > sum(end - start for _, start, end in waiting):
                size //= 2
            need, out = size, []
            while need:
                key, start, end = waiting.pop(0)
                taken = min(need, end - start)
                out.append((key, start, start + taken))
                need -= taken
                if taken < end - start:
                    waiting.insert(0, (key, start + taken, end))
            yield out
        self._full()


class Rows:
    """Pieces on their way to Spark."""

    def __init__(self, doc_id: pa.DataType):
        self.kinds = [doc_id, *[pa.int64()] * 5, pa.binary()]
        self.columns: list[list] = [[] for _ in self.kinds]

    def add(self, *values) -> None:
        for column, value in zip(self.columns, values):
            column.append(value)

    def taken(self) -> pa.RecordBatch:
        columns, self.columns = self.columns, [[] for _ in self.kinds]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns, self.kinds)), names=names_of(PIECE))


def packed_range(batches: Iterator[pa.RecordBatch], length: int, shard: int) -> Iterator[pa.RecordBatch]:
    """The pieces of one task's rests, given as (doc_id, start, length, doc_tokens, ids)."""
    packer, sequence = Packer(length), TaskContext.get().partitionId() << 33
    held: dict[int, tuple] = {}  # what the open window or the shard still needs
    fresh: list[int] = []
    out, number = None, 0

    def written(windows: Iterator[list[Piece]]) -> Iterator[pa.RecordBatch]:
        nonlocal sequence
        for window in windows:
            offset = 0
            for key, start, end in window:
                doc_id, first, total, ids = held[key]
                out.add(doc_id, first + start, end - start, total, 2 * sequence + 1, offset, ids[start:end].astype("<u4").tobytes())
                offset += end - start
            sequence += 1
            if len(out.columns[0]) >= 1_000:
                yield out.taken()
        yield out.taken()

    def shard_packed() -> Iterator[pa.RecordBatch]:
        yield from written(packer.pack(fresh, [held[k][-1] for k in fresh]))
        waiting = {key for key, _, _ in packer.window}
        for key in [k for k in held if k not in waiting]:
            del held[key]
        fresh.clear()

    for batch in batches:
        out = out or Rows(batch.column(0).type)
        for doc_id, start, size, total, data in zip(*(column.to_pylist() for column in batch.columns)):
            held[number] = (doc_id, start, total, numbers(data, size))
            fresh.append(number)
            number += 1
            if len(fresh) == shard:
                yield from shard_packed()
    if fresh:
        yield from shard_packed()
    if packer.window:
        yield from written(packer.rest())


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, start (in its document), length, doc_tokens, sequence_id, offset (in its sequence), and
    the ids as little-endian 32-bit numbers. ``length`` is a power of two."""
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Stored: ranges are drawn from a sample of the order, and texts must not be tokenized for that as well.
    cut = materialize(cut_documents(docs, path or tokenizer_path(), length))
    names, order = ["doc_id", "start", "length", "doc_tokens", "ids"], ["near_a", "near_b", "number"]
    ranges = cut.where(~F.col("whole")).select(*names, *order).repartitionByRange(*order).sortWithinPartitions(*order)
    rests = ranges.select(*names).mapInArrow(lambda batches: packed_range(batches, length, shard), PIECE.format(id=kind))

    @F.pandas_udf("binary")
    def widened(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield pd.Series([numbers(data, length).astype("<u4").tobytes() for data in column.tolist()], dtype=object)

    # Sequences of rests have odd numbers.
    windows = cut.where("whole").select(
        *names[:4], (2 * F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        widened("ids").alias("ids"))
    return windows.unionByName(rests)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
