"""Benchmark decontamination with suffix arrays over the training documents.

The training texts are cut into shards of bounded size; a shard is one or more whole documents (a longer document is cut
into overlapping pieces). A shard's words, lower-cased, are numbered, and the positions of its words are put in the
order of the words that follow them: a suffix array, by doubling the compared length until it exceeds the window. Every
suffix of every benchmark item is looked up by binary search, word by word: the range of equal training suffixes narrows
until it is empty, which gives the longest verbatim match and, at ``WINDOW`` words (or a whole shorter item), all its
places. Words inside a place are hit. Documents with hits are contaminated. Neighbouring places of neighbouring suffixes
are one verbatim match, also across the pieces of a long document; ``longest`` is the longest of them in words, and
``places`` are all of them as runs (start, end, item) of word numbers, joined where matches of one item meet.

The benchmark reaches the tasks in blocks of at most ``BLOCK_BYTES`` of words and item ids (one item at least): each
block is collected, sent, and used in one pass over the documents, whose rows carry what earlier blocks found. So neither
driver nor tasks hold a whole large benchmark, and no documents are shuffled.

Words are runs of ASCII letters and digits and of any characters beyond ASCII. Null or empty text: no words, no hits. An
item without words is ignored; items with equal ids are parts of one item; a null item id is written as an empty string.
Repeated rows have equal results. Empty benchmark: nothing is hit. Words are compared by two 64-bit sums of their bytes.
All columns are kept; those named as results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.words import ALPHANUMERIC, hashed_words
from pairloom.session import materialize

WINDOW = 10
BLOCK_BYTES = 16 * 1024 * 1024
SHARD_WORDS = 250_000
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
RESULT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "places"]

def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``words`` (small whole numbers, 0 for a border) in the order of their first ``depth`` words or more."""
    rank, done = words.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while done < depth:
        follow = np.zeros_like(rank)
        follow[:-done] = rank[done:]
        key = rank * (int(rank.max()) + 1) + follow
        order = np.argsort(key, kind="stable")
        change = np.concatenate([[1], (np.diff(key[order]) != 0)])
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(change)
        done *= 2
        if rank[order[-1]] == len(rank):
            break
    return order


class Block:
    """A part of the benchmark: hashed words of its items, one after the other."""

    def __init__(self, items: list[tuple[str, str]]):
        parts = [(item, hashed_words(text.encode("utf-8", "surrogatepass"), ALPHANUMERIC)) for item, text in items]
        parts = [(item, w) for item, w in parts if len(w)]
        self.items = [item for item, _ in parts]
        sizes = np.array([len(w) for _, w in parts], np.int64)
        self.words = np.concatenate([w for _, w in parts]) if parts else np.zeros(0, np.uint64)
        self.item_of = np.repeat(np.arange(len(parts)), sizes)
        ends = np.repeat(np.cumsum(sizes), sizes)
        self.left = ends - np.arange(len(self.words))  # words from here to the end of the item
        self.window = np.minimum(WINDOW, np.repeat(sizes, sizes))


def search(words: np.ndarray, borders: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches of a shard with a block: (position, words, number of the benchmark's suffix), each a whole window, and the
    longest match per position. ``borders`` marks the last word of each document."""
    distinct, shard = np.unique(words, return_inverse=True)
    shard = np.insert(shard.astype(np.int64) + 1, np.flatnonzero(borders) + 1, 0)  # 0 ends a document
    asked = np.searchsorted(distinct, block.words)
    known = (asked < len(distinct)) & (distinct[np.minimum(asked, len(distinct) - 1)] == block.words)
    asked = np.where(known, asked + 1, -1)
    alive = np.flatnonzero(known & (block.left >= block.window))
    nothing = np.zeros(0, np.int64)
    if not len(alive):
        return nothing, nothing, nothing
    order = suffix_array(shard, WINDOW)
    padded = np.concatenate([shard, np.zeros(WINDOW, np.int64)])
    low, high = np.zeros(len(alive), np.int64), np.full(len(alive), len(order))
    found = []
    for k in range(WINDOW):
        whole = block.window[alive] == k
        found.append((alive[whole], low[whole], high[whole]))
        alive, low, high = alive[~whole], low[~whole], high[~whole]
        want = asked[alive + k]
        low, high = _narrow(padded, order, low, high, want, k, False), _narrow(padded, order, low, high, want, k, True)
        some = (low < high) & (want > 0)
        alive, low, high = alive[some], low[some], high[some]
        if not len(alive):
            break
    found.append((alive, low, high))
    suffix, low, high = (np.concatenate(x) for x in zip(*found))
    sizes = high - low
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place, suffix = order[np.repeat(low, sizes) + within], np.repeat(suffix, sizes)
    before = np.cumsum(shard == 0)  # border marks in front of a position
    return place - before[place], block.window[suffix], suffix


def _narrow(padded: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, want: np.ndarray, k: int,
            after: bool) -> np.ndarray:
    """Binary search of all suffixes at once: the first place in [low, high) whose word ``k`` is not before (or is after)
    the wanted one."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        word = padded[order[np.minimum(middle, len(order) - 1)] + k]
        go_on = open_ & ((word <= want) if after else (word < want))
        low = np.where(go_on, middle + 1, low)
        high = np.where(open_ & ~go_on, middle, high)
    return low


def matches_of(row: np.ndarray, start: np.ndarray, suffix: np.ndarray, block: Block) -> tuple[np.ndarray, ...]:
    """(row, first word, end, number of the item) of each verbatim match: places of one item that go on word by word."""
    item = block.item_of[suffix]
    order = np.lexsort((start, start - suffix, item, row))
    row, start, suffix, item = row[order], start[order], suffix[order], item[order]
    new = np.ones(len(row), bool)
    # Pieces overlap, so a place may be there twice.
    new[1:] = ((np.diff(row) != 0) | (np.diff(item) != 0) | (np.diff(start - suffix) != 0) | (np.diff(start) > 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first], start[first], start[last] + block.window[suffix[last]], item[first]


def joined(matches: list[tuple[str, int, int]]) -> list[dict]:
    """Matches of one text, (item, start, end), as runs in their order; those of one item that meet are one run."""
    out: list[dict] = []
    for item, start, end in sorted(matches):
        if out and out[-1]["item"] == item and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end, "item": item})
    return sorted(out, key=lambda r: (r["start"], r["end"], r["item"]))


def _shards(texts: list[bytes | None]) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray]]:
    """Groups of (row, first word, words) with their words. A long document's pieces overlap by a window less one."""
    held, parts, size = [], [], 0
    for row, data in enumerate(texts):
        words = hashed_words(data or b"", ALPHANUMERIC)
        for first in range(0, max(len(words), 1), SHARD_WORDS):
            piece = words[first:first + SHARD_WORDS + WINDOW - 1]
            held.append((row, first, len(piece)))
            parts.append(piece)
            size += len(piece)
            if size >= SHARD_WORDS:
                yield held, np.concatenate(parts)
                held, parts, size = [], [], 0
    if held:
        yield held, np.concatenate(parts)


def find_in_texts(texts: list[bytes | None], block: Block) -> pd.DataFrame:
    """Per text: n_words, the hit words as runs, the items found, the longest match, and the matches by item."""
    n = len(texts)
    n_words, longest = np.zeros(n, np.int64), np.zeros(n, np.int64)
    runs: list[list[list[int]]] = [[] for _ in range(n)]
    items: list[set[str]] = [set() for _ in range(n)]
    seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for held, words in _shards(texts):
        ends = np.cumsum([size for _, _, size in held])
        for row, first, size in held:
            n_words[row] = max(n_words[row], first + size)
        if not len(words) or not len(block.words):
            continue
        borders = np.zeros(len(words), bool)
        borders[[e - 1 for e, (_, _, size) in zip(ends, held) if size]] = True
        place, size, suffix = search(words, borders, block)
        if not len(place):
            continue
        which = np.searchsorted(ends, place, side="right")
        in_row, in_text, in_shard = (np.array(x, np.int64) for x in zip(*held))
        begins = ends - in_shard
        seen.append((in_row[which], in_text[which] + place - begins[which], suffix))
        for at in np.lexsort((size, place)):
            row, first, count = held[which[at]]
            p, begin = int(place[at]), int(ends[which[at]]) - count
            items[row].add(block.items[block.item_of[suffix[at]]])
            start, end = first + p - begin, first + p - begin + int(size[at])
            if runs[row] and start <= runs[row][-1][1]:
                runs[row][-1][1] = max(runs[row][-1][1], end)
            else:
                runs[row].append([start, end])
    places: list[list[tuple[str, int, int]]] = [[] for _ in range(n)]
    if seen:
        for row, start, end, item in zip(*(x.tolist() for x in matches_of(*(np.concatenate(x) for x in zip(*seen)), block))):
            longest[row] = max(longest[row], end - start)
            places[row].append((block.items[item], start, end))
    return pd.DataFrame({"n_words": n_words, "runs": runs, "items": [sorted(x) for x in items], "longest": longest,
                         "places": [joined(x) for x in places]})


_PLACES = "array<struct<start: long, end: long, item: string>>"
_FOUND = f"n_words long, runs array<array<long>>, items array<string>, longest long, places {_PLACES}"


def _finder(block: Block, spark):
    sent = spark.sparkContext.broadcast(block)

    @F.pandas_udf(_FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield find_in_texts([t.encode("utf-8", "surrogatepass") if t else None for t in texts.tolist()], sent.value)

    return find


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The items in blocks of bounded bytes, one at a time. Items are dealt by hash; an item is never cut."""
    rows = benchmark.where(F.col("text").rlike(WORD)).select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text") + F.octet_length("item_id") + 64)).first()[0] or 0
    n = -(-2 * size // block_bytes)  # half full on the average, so that chance does not fill one beyond its bound
    stored = materialize(rows.withColumn("b", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1))))) if n > 1 else rows
    for b in range(n):
        part = stored.where(F.col("b") == b) if n > 1 else stored
        yield Block([(r["item_id"], r["text"]) for r in part.select("item_id", "text").orderBy("item_id", "text").collect()])


def find_contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` with n_words, n_hit, n_items, items_sha256, contaminated, longest and places."""
    kept = [f"`{c}`" for c in docs.columns if c not in (*RESULT, "__found", "__more")]
    found = None
    for block in blocks(benchmark, block_bytes):
        source = docs if found is None else materialize(found)
        previous = [] if found is None else ["__found"]
        found = source.select(*kept, *previous, _finder(block, docs.sparkSession)(F.col("text")).alias("__more"))
        found = found.select(*kept, (_merged() if previous else F.col("__more")).alias("__found"))
    if found is None:
        found = docs.select(*kept, F.struct(
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"),
            F.lit(None).cast("array<array<long>>").alias("runs"), F.array().cast("array<string>").alias("items"),
            F.lit(0).cast("long").alias("longest"), F.array().cast(_PLACES).alias("places")).alias("__found"))
    return found.select(
        *kept, "__found.n_words", hit_words(F.col("__found.runs")).alias("n_hit"),
        F.size("__found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__found.items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit_words(F.col("__found.runs")) > 0).alias("contaminated"), "__found.longest", "__found.places",
    )


def hit_words(runs: Column) -> Column:
    """Words in runs that may overlap when they come from several blocks."""
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    return F.coalesce(F.aggregate(
        F.sort_array(runs), start,
        lambda acc, r: F.struct(
            F.greatest(acc["upto"], r[1]).alias("upto"),
            (acc["n"] + F.greatest(F.lit(0).cast("long"), r[1] - F.greatest(acc["upto"], r[0]))).alias("n")),
        lambda acc: acc["n"]), F.lit(0).cast("long"))


def _merged() -> Column:
    old, new = F.col("__found"), F.col("__more")
    return F.struct(
        old["n_words"].alias("n_words"), F.concat(old["runs"], new["runs"]).alias("runs"),
        F.array_sort(F.array_union(old["items"], new["items"])).alias("items"),
        F.greatest(old["longest"], new["longest"]).alias("longest"),
        F.array_sort(F.array_union(old["places"], new["places"])).alias("places"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit, with their columns."""
    clashing = [c for c in docs.columns if c in RESULT]
    named = docs.select("*", *[F.col(f"`{c}`").alias(f"__own_{c}") for c in clashing])
    found = find_contamination(named, benchmark).where(~F.col("contaminated"))
    return found.select(*[F.col(f"`__own_{c}`" if c in clashing else f"`{c}`").alias(c) for c in docs.columns])
