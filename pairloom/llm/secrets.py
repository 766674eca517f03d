"""Secrets found by rules and by a character convolutional network.

The base rules find assignments to secret names, access keys and long hexadecimal runs. The network looks at every other
candidate, a maximal run of 16 or more characters of ``[A-Za-z0-9+/_=-]`` with a digit and a letter, with the
characters around it: characters are embedded, with a channel that marks the candidate; one convolution, the largest and
mean value per filter, one output. A candidate longer than a window is seen in overlapping windows and has its highest
score.

It is trained on labelled findings of all documents: all of the base rules' findings against all other candidates and
all other words of a candidate's length or more (shorter ones are never judged), both labels with the same total weight.
The findings are dealt by hash to shards of about ``SHARD_ROWS``; in each of ``ROUNDS`` rounds every shard trains the
network in a task of its own, starting from the same weights, and the driver gets and averages only the weights. Small
sets are seen more often. A fifth is held back: all of it is scored in tasks and counted by label and output (in steps of
1 / ``STEPS``); on these counts the outputs are calibrated (a logistic fit of the label on the output), and the threshold
is the highest step that still finds ``RECALL`` of the held-back findings, but not under ``LEAST``. A candidate above it
is added as kind ``net``; the base spans stay as they are. Without findings to learn from, nothing is added; without other
words and candidates there is nothing to judge.

Null or empty text: no spans. Empty table: empty result, nothing learned. Spans are in code points, end exclusive. Repeated rows have equal results. Each text is
scanned once in linear time. ``find_secrets`` keeps all columns and replaces those it adds.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.spans import Cover, Span, finder
from pairloom.session import materialize

# Kinds in the order of the contract, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run has no longer neighbour, so this is the run rule with its length

RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
RUN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
DIGIT, LETTER, SPACE = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]"), re.compile(r"[\x20\x09-\x0D]")
LEAST_LENGTH = 16

# Findings of one shard, rounds over all shards, findings a small set is repeated to, passes in a round at most.
SHARD_ROWS, ROUNDS, SEEN, PASSES = 20_000, 3, 60_000, 4
STEPS, FARTHEST = 1_000, 30  # steps of the output's counts in 1, and the output where they end
RECALL, LEAST = 0.98, 0.5
BEFORE, MIDDLE, AFTER = 24, 40, 16
WINDOW = BEFORE + MIDDLE + AFTER
CODES, EMBED, WIDTH, FILTERS = 97, 8, 5, 24


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def in_order(span: Span) -> tuple:
    return span[1], KINDS.index(span[0]) if span[0] in KINDS else len(KINDS), span[2]


def candidates(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := DIGIT.search(text, at):
        start = m.start()
        while start > at and text[start - 1] in RUN_CHARS:
            start -= 1
        at = RUN.match(text, m.start()).end()
        if at - start >= LEAST_LENGTH and LETTER.search(text, start, at):
            yield start, at


def long_words(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for word in SPACE.split(text):
        if len(word) >= LEAST_LENGTH:
            yield at, at + len(word)
        at += len(word) + 1


def windows(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """(characters, start and end of the candidate in them), as many as it takes to see all of the candidate."""
    out = []
    for at in range(start, max(end - MIDDLE, start) + MIDDLE, MIDDLE // 2):
        if at > start and at + MIDDLE // 2 >= end:
            break
        left = text[max(0, at - BEFORE):at]
        out.append((left.rjust(BEFORE, "\0") + text[at:at + MIDDLE + AFTER], BEFORE, BEFORE + min(MIDDLE, end - at)))
    return out


def encoded(rows: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    codes, mark = np.zeros((len(rows), WINDOW), np.int64), np.zeros((len(rows), WINDOW), np.float32)
    for i, (chars, start, end) in enumerate(rows):
        x = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32)[:WINDOW].astype(np.int64)
        codes[i, :len(x)] = np.where(x == 0, 0, np.where((x >= 32) & (x < 127), x - 31, CODES - 1))
        mark[i, start:end] = 1
    return codes, mark


class Network:
    """Embedding, convolution, largest and mean value per filter, one output; trained by Adam on the log loss."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.w = {
            "embed": r.normal(0, 0.3, (CODES, EMBED)).astype(np.float32),
            "filter": r.normal(0, 0.2, (WIDTH * (EMBED + 1), FILTERS)).astype(np.float32),
            "shift": np.zeros(FILTERS, np.float32),
            "out": r.normal(0, 0.2, 2 * FILTERS).astype(np.float32),
            "bias": np.zeros(1, np.float32),
        }
        self.slope, self.offset, self.threshold = 1.0, 0.0, np.inf

    def forward(self, codes: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, tuple]:
        x = np.concatenate([self.w["embed"][codes], mark[:, :, None]], axis=2)
        n = WINDOW - WIDTH + 1
        patches = np.concatenate([x[:, k:k + n] for k in range(WIDTH)], axis=2)
        h = np.maximum(patches @ self.w["filter"] + self.w["shift"], 0)
        top = h.argmax(axis=1)
        pooled = np.concatenate([h.max(axis=1), h.mean(axis=1)], axis=1)
        return pooled @ self.w["out"] + self.w["bias"][0], (patches, h, top, pooled)

    def gradients(self, codes: np.ndarray, kept: tuple, error: np.ndarray) -> dict[str, np.ndarray]:
        patches, h, top, pooled = kept
        b, n, _ = h.shape
        d_pool = error[:, None] * self.w["out"]
        d_h = np.repeat(d_pool[:, None, FILTERS:] / n, n, axis=1)
        rows, cols = np.arange(b)[:, None], np.arange(FILTERS)[None, :]
        d_h[rows, top, cols] += d_pool[:, :FILTERS]
        d_h *= h > 0
        d_patch = d_h @ self.w["filter"].T
        d_embed, step = np.zeros_like(self.w["embed"]), EMBED + 1
        for k in range(WIDTH):
            np.add.at(d_embed, codes[:, k:k + n].ravel(), d_patch[:, :, k * step:k * step + EMBED].reshape(-1, EMBED))
        return {
            "embed": d_embed, "filter": np.tensordot(patches, d_h, axes=([0, 1], [0, 1])), "shift": d_h.sum((0, 1)),
            "out": pooled.T @ error, "bias": error.sum(keepdims=True),
        }

    def train(self, codes: np.ndarray, mark: np.ndarray, label: np.ndarray, rounds: int = 12, rate: float = 3e-3,
              seed: int = 5, weight: tuple[float, float] = (1.0, 1.0)) -> None:
        r, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for _ in range(rounds):
            for part in np.array_split(r.permutation(len(label)), max(1, len(label) // 64)):
                c, marked = codes[part].copy(), mark[part]
                # Half of the time the surroundings are hidden, so that a candidate can be told by itself.
                hidden = (r.random(len(part)) < 0.5)[:, None] & (marked == 0)
                c[hidden] = 0
                score, kept = self.forward(c, marked)
                error = ((1 / (1 + np.exp(-np.clip(score, -30, 30)))) - label[part]).astype(np.float32) / len(part)
                error *= np.where(label[part] == 1, *weight[::-1]).astype(np.float32)
                step += 1
                for k, g in self.gradients(c, kept, error).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, score: np.ndarray, label: np.ndarray, count: np.ndarray, recall: float = RECALL) -> None:
        """Logistic fit with a small penalty, then the highest threshold that keeps the recall. Each score and label
        stands for ``count`` findings; both labels have the same weight in the fit."""
        a, b = 1.0, 0.0
        positive = np.where(label == 1, count, 0)
        share = np.where(label == 1, positive.sum(), (count - positive).sum())
        each = count * (count.sum() / 2 / np.maximum(share, 1))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
            w = each * p * (1 - p)
            d = each * (p - label)
            g = np.array([(d * score).sum() + 1e-2 * (a - 1), d.sum() + 1e-2 * b])
            h = np.array([[(w * score * score).sum() + 1e-2, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-2]])
            a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -1, 1)
        self.slope, self.offset = float(a), float(b)
        order = np.argsort(score)
        if positive.sum():
            lost = int(np.floor((1 - recall) * positive.sum()))
            lowest = score[order][np.searchsorted(np.cumsum(positive[order]), lost, side="right")]
            self.threshold = max(LEAST, float(self.probability(lowest)))

    def scores(self, rows: list[tuple[str, int, int]]) -> np.ndarray:
        parts = [self.forward(*encoded(rows[at:at + 512]))[0] for at in range(0, len(rows), 512)]
        return np.concatenate(parts).astype(np.float64) if parts else np.zeros(0)

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.offset, -30, 30)))


def findings(docs: DataFrame) -> DataFrame:
    """Labelled windows (label, chars, first, last, draw) of all documents, each different one once."""
    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = set()
            for text in batch["text"].tolist():
                text = text or ""
                base = base_spans(text)
                cover = Cover(base)
                for kind, start, end in base:
                    if kind == "assign":
                        start = end - len(ASSIGN.match(text, start)[1])
                    rows.update((1, *w) for w in windows(text, start, end))
                others = {*candidates(text), *long_words(text)}
                rows.update((0, *w) for s, e in others if not cover.meets(s, e) for w in windows(text, s, e))
            yield pd.DataFrame(list(rows), columns=["label", "chars", "first", "last"])

    found = docs.select("text").mapInPandas(label, "label int, chars string, first int, last int")
    return found.distinct().withColumn("draw", F.xxhash64("label", "chars", "first", "last"))


def fit(docs: DataFrame) -> Network:
    """A trained and calibrated network; its threshold is infinite if there was nothing to learn."""
    rows = materialize(findings(docs).withColumn("held", F.pmod("draw", F.lit(5)) == 0))
    counts = {(r["label"], r["held"]): r["count"] for r in rows.groupBy("label", "held").count().collect()}
    net = Network()
    if len({label for label, _ in counts}) < 2:
        return net
    if all((label, part) in counts for label in (0, 1) for part in (True, False)):
        learn, held = rows.where(~F.col("held")), rows.where("held")
        n = [counts[label, False] for label in (0, 1)]
    else:  # too few to hold some of them back
        learn = held = rows
        n = [counts.get((label, True), 0) + counts.get((label, False), 0) for label in (0, 1)]
    _train(net, learn, n)
    _calibrate(net, held)
    return net


def _encoded(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return encoded(list(zip(rows["chars"], rows["first"], rows["last"])))


def _train(net: Network, learn: DataFrame, n: list[int]) -> None:
    """Rounds over all of ``learn``, which has ``n`` findings of each label; results do not depend on partitions."""
    shards = -(-sum(n) // SHARD_ROWS)
    passes = min(PASSES, max(1, -(-SEEN // (ROUNDS * sum(n)))))
    weight = (sum(n) / 2 / n[0], sum(n) / 2 / n[1])
    dealt = learn.withColumn("shard", F.pmod(F.xxhash64("draw", F.lit("shard")), F.lit(shards)).cast("int"))
    for turn in range(ROUNDS):
        def train(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["draw", "chars", "first", "last"])
            own = copy.deepcopy(net)
            own.train(*_encoded(rows), rows["label"].to_numpy(np.float32), passes, seed=5 + turn, weight=weight)
            flat = np.concatenate([own.w[k].ravel() for k in sorted(own.w)]).astype(np.float32)
            return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "n": [len(rows)], "weights": [flat.tobytes()]})

        trained = dealt.groupBy("shard").applyInPandas(train, "shard int, n long, weights binary").collect()
        parts = sorted(trained, key=lambda r: r["shard"])
        flat = np.average([np.frombuffer(r["weights"], np.float32) for r in parts], axis=0, weights=[r["n"] for r in parts])
        at = 0
        for k in sorted(net.w):
            net.w[k] = flat[at:at + net.w[k].size].reshape(net.w[k].shape).astype(np.float32)
            at += net.w[k].size


def _calibrate(net: Network, held: DataFrame) -> None:
    @F.pandas_udf("long")
    def step(chars: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        score = net.scores(list(zip(chars, first, last)))
        return pd.Series(np.floor(np.clip(score, -FARTHEST, FARTHEST) * STEPS).astype(np.int64))

    counts = held.groupBy("label", step("chars", "first", "last").alias("step")).count().orderBy("label", "step").collect()
    net.calibrate(*[np.array([r[c] for r in counts], np.float64) / d for c, d in (("step", STEPS), ("label", 1), ("count", 1))])


def find_secrets(docs: DataFrame, net: Network) -> DataFrame:
    """All rows and columns of ``docs`` with n_assign, n_access, n_hex, base_sha256, spans and n_added."""
    def added(texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
        out: list[list[Span]] = [[] for _ in texts]
        if not np.isfinite(net.threshold):
            return out
        found = []
        for i, (text, base) in enumerate(zip(texts, bases)):
            cover = Cover(base)
            found += [(i, *c) for c in candidates(text) if not cover.meets(*c)]
        seen = [(n, w) for n, (i, start, end) in enumerate(found) for w in windows(texts[i], start, end)]
        best = np.zeros(len(found))
        if seen:
            np.maximum.at(best, [n for n, _ in seen], net.probability(net.scores([w for _, w in seen])))
        for (i, start, end), p in zip(found, best):
            if p >= net.threshold:
                out[i].append(("net", start, end))
        return out

    result = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    kept = [f"`{c}`" for c in docs.columns if c not in (*result, "__found")]
    find = finder(KINDS, base_spans, added, in_order)
    return docs.select(*kept, find(F.col("text")).alias("__found")).select(*kept, *[f"__found.{c}" for c in result])
