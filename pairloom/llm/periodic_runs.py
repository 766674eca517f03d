"""Periodic runs of words, found on a Re-Pair grammar of the texts.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are equal) and at least
``max(MIN_WORDS, REPEATS * q)`` words that cannot be made longer keeping the period.

1. The words of a batch of whole texts are numbered. A run holds only words of 8-word windows that occur twice in their
   text (a window at the place one period on, or back, is equal), so stretches of other words hold no part of a run and
   are left out. The rest, with a border between stretches, is one sequence.
2. Re-Pair: the most frequent pair of neighbouring symbols becomes a new symbol until no pair occurs twice. What is left
   of each stretch is joined by a balanced tree, so that every boundary between two words belongs to one node.
3. For each node, in its first place only, the runs that cross the boundary between its two halves are computed. One half
   holds at least half of the run, so the four words at the boundary are found again one period away inside it: the
   places of those words inside the node are the periods to try. How far a period holds is measured for all tries at
   once, by ranks of blocks of 1, 2, 4, ... words.
4. Runs are translated to all places where their symbol is derived. A run that ends at the edge of its node may go on
   beyond it; then the node above the edge found the longer one. So of stretches of equal period those inside another
   are left out, and of the same stretch the smallest period is its period.

``collapsed`` text: without the words that some run holds after its first period, joined by one space.

Null or empty text, or one without words: no runs, empty collapsed text. A text is the unit of work and is never cut;
cost grows with its words times their logarithm at most. Repeated rows have equal results. Runs of equal exponent: the
one that starts first, then the one with the smaller period, is reported as the greatest. All columns are kept; those
named as results are replaced. Empty input: empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.words import mixed

MIN_WORDS = 24
REPEATS = 3
WINDOW = 8   # any window of so many words inside a run occurs twice: 2 * q + WINDOW <= run for q < WINDOW
ANCHOR = 4   # words at a boundary that occur again one period away
LEVELS = 10  # blocks of up to 2 ** LEVELS words have ranks
RESULT = "runs array<struct<start:long,length:long,period:long>>, collapsed string"


def repeated_windows(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which words lie in a window that occurs twice in their text."""
    n = len(words) - WINDOW + 1
    inside = np.zeros(len(words), bool)
    if n <= 0:
        return inside
    total = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        total += mixed(words[k:n + k].astype(np.uint64) + np.uint64((k + 1) << 40))
    total = mixed(total + text[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    whole = np.flatnonzero(text[:n] == text[WINDOW - 1:])
    order = whole[np.argsort(total[whole], kind="stable")]
    same = total[order][1:] == total[order][:-1]
    twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    starts = np.zeros(len(words) + 1, np.int64)
    np.add.at(starts, twice, 1)
    np.add.at(starts, twice + WINDOW, -1)
    return np.cumsum(starts[:-1]) > 0


class Grammar:
    """Re-Pair over a list of numbers. ``rules[x - first]`` are the two halves of symbol ``x``; ``left`` is what remains
    of the list, as (place, symbol)."""

    def __init__(self, words: list[int], borders: set[int]):
        self.first = (max(words) + 1) if words else 0
        self.rules: list[tuple[int, int]] = []
        n = len(words)
        symbol: list[int] = list(words)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[tuple[int, int], list[int]] = {}
        for i in range(n - 1):
            if i not in borders and i + 1 not in borders:
                places.setdefault((symbol[i], symbol[i + 1]), []).append(i)
        queue = [(-len(p), pair) for pair, p in places.items() if len(p) > 1]
        heapq.heapify(queue)
        border = {words[i] for i in borders}
        while queue:
            count, pair = heapq.heappop(queue)
            a, b = pair
            found, last = [], -1
            for i in places[pair]:  # ascending; overlapping or gone places are left out
                if i != last and symbol[i] == a and after[i] < n and symbol[after[i]] == b:
                    found.append(i)
                    last = after[i]
            places[pair] = found
            if len(found) < 2:
                del places[pair]
                continue
            if queue and len(found) < -queue[0][0]:
                heapq.heappush(queue, (-len(found), pair))
                continue
            new = self.first + len(self.rules)
            self.rules.append(pair)
            made: dict[tuple[int, int], list[int]] = {}
            for i in found:
                j = after[i]
                symbol[i], symbol[j] = new, -1
                k = after[j]
                after[i] = k
                if k < n:
                    before[k] = i
                    if symbol[k] not in border:
                        made.setdefault((new, symbol[k]), []).append(i)
                h = before[i]
                if h >= 0 and symbol[h] not in border:
                    made.setdefault((symbol[h], new), []).append(h)
            del places[pair]
            for fresh, at in made.items():
                if len(at) > 1:
                    places[fresh] = at
                    heapq.heappush(queue, (-len(at), fresh))
        self.left = [(i, x) for i, x in enumerate(symbol) if x >= 0 and x not in border]
        self.size = np.ones(self.first + len(self.rules), np.int64)
        for k, (a, b) in enumerate(self.rules):
            self.size[self.first + k] = self.size[a] + self.size[b]

    def derivations(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(middle, length, all places) of every rule; the middle counts from a place."""
        at: dict[int, list[np.ndarray]] = {}
        for i, x in self.left:
            if x >= self.first:
                at.setdefault(x, []).append(np.array([i]))
        for k in range(len(self.rules) - 1, -1, -1):
            x = self.first + k
            if x not in at:
                continue
            places = np.concatenate(at.pop(x))
            a, b = self.rules[k]
            middle = int(self.size[a])
            yield middle, int(self.size[x]), places
            if a >= self.first:
                at.setdefault(a, []).append(places)
            if b >= self.first:
                at.setdefault(b, []).append(places + middle)

    def upper_nodes(self) -> Iterator[tuple[int, int, int]]:
        """(start, middle, end) of the nodes of the balanced trees over what is left of each stretch."""
        starts = [i for i, _ in self.left]
        ends = [i + int(self.size[x]) for i, x in self.left]
        gaps = [k for k in range(1, len(starts)) if ends[k - 1] != starts[k]]
        waiting = [(i, j) for i, j in zip([0, *gaps], [*gaps, len(starts)])]
        while waiting:
            i, j = waiting.pop()
            if j - i < 2 or ends[j - 1] - starts[i] < MIN_WORDS:
                continue
            middle = (i + j) // 2
            yield starts[i], starts[middle], ends[j - 1]
            waiting += [(i, middle), (middle, j)]


class Ranks:
    """Equality of blocks of a sequence of numbers in constant time."""

    def __init__(self, words: np.ndarray, longest: int):
        self.levels = [words.astype(np.int64)]
        while len(self.levels) <= LEVELS and 1 << len(self.levels) <= longest:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            key = last[:-half] * (int(last.max()) + 1) + last[half:]
            self.levels.append(np.unique(key, return_inverse=True)[1])

    def extent(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """For how many words, ``most`` at most, the sequence goes on (or back) equally from places x and y."""
        done = np.zeros(len(x), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            rank, step = self.levels[level], 1 << level
            top = level == len(self.levels) - 1
            going = np.flatnonzero(done + step <= most)
            while len(going):
                shift = -done[going] - step if back else done[going]
                equal = rank[x[going] + shift] == rank[y[going] + shift]
                going = going[equal]
                done[going] += step
                # A level below the top fits once at most: two steps would have been one of the level above.
                going = going[done[going] + step <= most[going]] if top else going[:0]
        return done


def crossing(words: np.ndarray, ranks: Ranks, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(node, start, end, period) of all periodic stretches that meet the boundary ``middle`` of the nodes [start, end)."""
    gram = ranks.levels[2]  # blocks of ANCHOR words; a node has MIN_WORDS at least
    place = np.argsort(gram, kind="stable")
    key = gram[place] * len(words) + place
    out = []
    for forward in (True, False):
        own = middle if forward else middle - ANCHOR
        fits = np.flatnonzero((own + ANCHOR <= end) & (own >= start))
        of, lowest = gram[own[fits]] * len(words), own[fits]
        # One period is at most a third of the node.
        reach = (end[fits] - start[fits]) // REPEATS
        if forward:
            low, high = of + lowest + 1, of + np.minimum(lowest + reach, end[fits] - ANCHOR) + 1
        else:
            low, high = of + np.maximum(lowest - reach, start[fits]), of + lowest
        first, last = np.searchsorted(key, low), np.searchsorted(key, high)
        many = np.maximum(last - first, 0)
        node = np.repeat(fits, many)
        if not len(node):
            continue
        nth = np.arange(len(node)) - np.repeat(np.cumsum(many) - many, many)
        other = place[np.repeat(first, many) + nth]
        mine = own[node]
        period = np.abs(other - mine)
        x = middle[node] if forward else middle[node] - period
        y = x + period
        begin = x - ranks.extent(x, y, x - start[node], back=True)
        stop = y + ranks.extent(x, y, end[node] - y)
        long = stop - begin >= np.maximum(MIN_WORDS, REPEATS * period)
        out.append((node[long], begin[long], stop[long], period[long]))
    if not out:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(part) for part in zip(*out))


def widest(begin: np.ndarray, stop: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of the stretches not inside another of the same period, each with its smallest one."""
    order = np.lexsort((-stop, begin, period))
    begin, stop, period = begin[order], stop[order], period[order]
    best: dict[tuple[int, int], int] = {}
    last, reach = -1, -1
    for s, e, q in zip(begin.tolist(), stop.tolist(), period.tolist()):
        if q != last:
            last, reach = q, -1
        if e > reach:
            reach = e
            best.setdefault((s, e), q)  # periods ascend
    return np.array(sorted((s, e, q) for (s, e), q in best.items()), np.int64).reshape(-1, 3)


def runs_of(words: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs in a sequence of numbers; a place in ``borders`` holds a number of its own."""
    grammar = Grammar(words.tolist(), set(borders.tolist()))
    nodes, derived = [], []
    for middle, length, places in grammar.derivations():
        if length >= MIN_WORDS:
            nodes.append((int(places[0]), int(places[0]) + middle, int(places[0]) + length))
            derived.append(places)
    for start, middle, end in grammar.upper_nodes():
        nodes.append((start, middle, end))
        derived.append(np.array([start]))
    if not nodes:
        return np.zeros((0, 3), np.int64)
    start, middle, end = np.array(nodes, np.int64).T
    ranks = Ranks(words, int((end - start).max()))
    node, begin, stop, period = crossing(words, ranks, start, middle, end)
    if not len(node):
        return np.zeros((0, 3), np.int64)
    many = np.array([len(derived[k]) for k in node.tolist()])
    shift = np.concatenate([derived[k] - start[k] for k in node.tolist()])
    return widest(np.repeat(begin, many) + shift, np.repeat(stop, many) + shift, np.repeat(period, many))


def blank_separated(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes are split at the six blanks of ASCII


def joined(words: list[bytes]) -> str:
    return b" ".join(words).decode("utf-8", "surrogatepass")


def periodic(texts: list[str | None]) -> list[tuple[list[tuple[int, int, int]], str]]:
    """Per text its runs (start, length, period), by start and period, and the collapsed text."""
    words = [blank_separated(text) for text in texts]
    every = list(chain.from_iterable(words))
    numbers = {w: i for i, w in enumerate(dict.fromkeys(every))}
    sizes = np.array([len(own) for own in words], np.int64)
    first = np.cumsum(sizes) - sizes
    ids = np.fromiter(map(numbers.__getitem__, every), np.int64, len(every))
    text_of = np.repeat(np.arange(len(words)), sizes)
    edges = np.zeros(len(ids) + 1, bool)
    edges[first] = True
    # Stretches of repeated windows, cut at the edges of texts.
    held = repeated_windows(ids, text_of)
    no = np.zeros(1 if len(ids) else 0, bool)
    starts = np.flatnonzero(held & (~np.concatenate([no, held[:-1]]) | edges[:-1]))
    ends = np.flatnonzero(held & (~np.concatenate([held[1:], no]) | edges[1:])) + 1
    enough = ends - starts >= MIN_WORDS
    starts, ends = starts[enough], ends[enough]
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    if len(starts):
        lengths = ends - starts
        place = np.cumsum(lengths + 1) - lengths - 1  # in the sequence, each stretch followed by a border
        sequence = np.empty(int((lengths + 1).sum()), np.int64)
        inside = np.ones(len(sequence), bool)
        borders = place + lengths
        inside[borders] = False
        sequence[inside] = ids[np.concatenate([np.arange(s, e) for s, e in zip(starts, ends)])]
        _, sequence[inside] = np.unique(sequence[inside], return_inverse=True)
        sequence[borders] = int(sequence[inside].max()) + 1 + np.arange(len(borders))
        for s, e, q in runs_of(sequence, borders).tolist():
            k = int(np.searchsorted(place, s, side="right")) - 1
            at = int(starts[k]) + s - int(place[k])
            t = int(text_of[at])
            out[t].append((at - int(first[t]), e - s, q))
    return [(own, collapsed(w, own)) for w, own in zip(words, out)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        keep = np.cumsum(gone[:-1]) == 0
        words = [w for w, k in zip(words, keep.tolist()) if k]
    return joined(words)


def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame(periodic(texts.tolist()), columns=["runs", "collapsed"])


def find_runs(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` with ``runs`` (by start, then period) and the ``collapsed`` text."""
    found = docs.drop("runs", "collapsed").withColumn("__found", F.pandas_udf(find, RESULT)("text"))
    return found.select("*", "__found.runs", "__found.collapsed").drop("__found")


def collapse_runs(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` with runs cut down to their first period; texts without a run stay as they are."""
    found = docs.withColumn("__found", F.pandas_udf(find, RESULT)("text"))
    text = F.when(F.size("__found.runs") > 0, F.col("__found.collapsed")).otherwise(F.col("text"))
    return found.withColumn("text", text).drop("__found")


def greatest_run(runs: Column) -> Column:
    """The run with the greatest length / period; null if there is none. Products of two lengths fit in a long."""
    def better(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, better)  # runs ascend, so the first of equal ones stays


def digests(found: DataFrame) -> DataFrame:
    """Per row: doc_id, n_runs, the greatest run's start, length, period and exponent_milli, and digests of the runs and of
    the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"),
        F.lit("\n"))), "")
    best = found.withColumn("__best", greatest_run(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "__best.start", "__best.length", "__best.period",
        F.expr("(1000 * __best.length) div __best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.coalesce(F.col("collapsed"), F.lit("")), 256).alias("collapsed_sha256"))


def made_periodic(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for ids, texts in batches:
        out = []
        for doc_id, text in zip(ids.tolist(), texts.tolist()):
            h = zlib.crc32((doc_id or "").encode())
            words = blank_separated(text) if h % 10 == 0 else []
            if words:
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                unit = words[a:a + p]
                text = joined(words[:a] + (unit * ((n - a) // p + 1))[:n - a])
            out.append(text)
        yield pd.Series(out, dtype=object)


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts of a tenth of the documents made periodic from a word on, as the query's contract states."""
    text = F.pandas_udf(made_periodic, "string")(F.col("doc_id").cast("string"), F.col("text"))
    return docs.withColumn("text", text)
