"""Personal data found by rules and by a character-level bidirectional LSTM with a CRF on top.

The base rules find e-mail and IP addresses, card numbers and phone numbers. Every kind contains a digit or an ``@``, so
the network reads exactly the surroundings of these characters: their merged neighbourhoods are cut into overlapping
windows, each window gets scores per character and tag, scores of the windows over one character are averaged with more
weight for a window that has it near its middle, and one best path by the CRF's transitions is decoded over the whole
neighbourhood. So windows never disagree, and a span may be longer than a window. A decoded span that meets no base span,
cuts no run of letters and digits, and holds an ``@`` or four digits is added under its kind; the base spans stay as they are.

It is trained in numpy from labelled spans: windows of the base rules' findings, and as many without one, in a sample of
at most ``SAMPLE_DOCS`` documents in expectation (chosen by hashed id), at most ``SAMPLE_ROWS`` windows each. Without
labelled spans nothing is added.

Null or empty text: no spans. Empty table: empty result, nothing learned. Spans are in code points, end exclusive. Repeated rows have equal results. Rules run in
linear time, also on endless runs of digits or of address characters. ``find_personal`` keeps all columns and replaces
those it adds.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.spans import Cover, Span, finder, sample_bound
from pairloom.session import materialize

# Kinds in the order of the contract, and their patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a run of digits cannot match later if it does not from its start
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TRIGGER = re.compile(r"[0-9@]")
WINDOW, STRIDE = 40, 20
CODES, EMBED, HIDDEN = 97, 12, 20
TAGS = 1 + 2 * len(KINDS)  # 0 outside; 1 + 2k begins kind k, 2 + 2k goes on with it
SAMPLE_DOCS, SAMPLE_ROWS = 50_000, 1_500


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield "email", start, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    found = list(emails(text))
    if not re.search("[0-9]", text):
        return found
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = _digits(m[0]) if m.end() - m.start() >= 16 else []
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


def in_order(span: Span) -> tuple:
    return KINDS.index(span[0]), span[1], span[2]


def neighbourhoods(text: str) -> list[tuple[int, int]]:
    """Merged ranges around digits and ``@``."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        start, end = max(0, m.start() - STRIDE), min(len(text), m.start() + STRIDE)
        if out and start <= out[-1][1]:
            out[-1][1] = end
        else:
            out.append([start, end])
    return [(s, e) for s, e in out]


def window_starts(start: int, end: int) -> range:
    return range(start, max(start + 1, end - STRIDE), STRIDE)


def encoded(rows: list[str]) -> np.ndarray:
    codes = np.zeros((len(rows), WINDOW), np.int64)
    for i, chars in enumerate(rows):
        x = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes[i, :len(x)] = np.where((x >= 32) & (x < 127), x - 31, CODES - 1)
    return codes


def tags_of(spans: list[Span], start: int, end: int) -> str:
    tags = ["0"] * (end - start)
    for kind, s, e in spans:
        for i in range(max(s, start), min(e, end)):
            tags[i - start] = str(1 + 2 * KINDS.index(kind) + (i > s))
    return "".join(tags)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Embedding, one LSTM per direction, scores per tag, CRF transitions; trained by Adam on the CRF's likelihood."""

    def __init__(self, seed: int = 9):
        r = np.random.default_rng(seed)
        self.trained = False
        self.w = {"embed": r.normal(0, 0.3, (CODES, EMBED)), "out": r.normal(0, 0.2, (2 * HIDDEN, TAGS)),
                  "bias": np.zeros(TAGS), "step": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS)}
        for d in ("f", "b"):
            self.w[f"x{d}"] = r.normal(0, 0.2, (EMBED, 4 * HIDDEN))
            self.w[f"h{d}"] = r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            self.w[f"s{d}"] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])  # forget gates start open
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        inner = x @ self.w[f"x{d}"] + self.w[f"s{d}"]
        b, n, _ = x.shape
        h, c = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        out, kept = np.zeros((b, n, HIDDEN), np.float32), [None] * n
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            z = inner[:, t] + h @ self.w[f"h{d}"]
            gates, new = _sigmoid(z[:, :3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN:])
            f, i, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            before, c = c, f * c + i * new
            squashed = np.tanh(c)
            kept[t] = (h, before, f, i, o, new, squashed)
            h = o * squashed
            out[:, t] = h
        return out, kept

    def scores(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        x = self.w["embed"][codes]
        (forward, kf), (back, kb) = self._run(x, "f"), self._run(x, "b")
        hidden = np.concatenate([forward, back], axis=2)
        return hidden @ self.w["out"] + self.w["bias"], (x, hidden, kf, kb)

    def _back(self, d_out: np.ndarray, x: np.ndarray, kept: list, d: str, g: dict[str, np.ndarray]) -> np.ndarray:
        b, n, _ = d_out.shape
        d_h, d_c = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        d_z, wh = np.zeros((b, n, 4 * HIDDEN), np.float32), self.w[f"h{d}"]
        for t in range(n - 1, -1, -1) if d == "f" else range(n):
            h, before, f, i, o, new, squashed = kept[t]
            d_h = d_h + d_out[:, t]
            d_c = d_c + d_h * o * (1 - squashed**2)
            z = d_z[:, t]
            z[:, :HIDDEN] = d_c * before * f * (1 - f)
            z[:, HIDDEN:2 * HIDDEN] = d_c * new * i * (1 - i)
            z[:, 2 * HIDDEN:3 * HIDDEN] = d_h * squashed * o * (1 - o)
            z[:, 3 * HIDDEN:] = d_c * i * (1 - new**2)
            g[f"h{d}"] += h.T @ z
            d_h, d_c = z @ wh.T, d_c * f
        g[f"x{d}"] += np.tensordot(x, d_z, axes=([0, 1], [0, 1]))
        g[f"s{d}"] += d_z.sum((0, 1))
        return d_z @ self.w[f"x{d}"].T

    def gradients(self, codes: np.ndarray, tags: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log likelihood; windows shorter than WINDOW are masked at their end."""
        score, (x, hidden, kf, kb) = self.scores(codes)
        b, n, _ = score.shape
        step, g = self.w["step"], {k: np.zeros_like(v) for k, v in self.w.items()}
        score, rows = score.astype(np.float64), np.arange(b)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0] + self.w["first"]
        for t in range(1, n):
            new = _logsum(ahead[:, t - 1, :, None] + step, 1) + score[:, t]
            ahead[:, t] = np.where(mask[:, t, None], new, ahead[:, t - 1])
        total = _logsum(ahead[:, -1], 1)
        for t in range(n - 2, -1, -1):
            new = _logsum(step + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(mask[:, t + 1, None], new, behind[:, t + 1])
        d_score = np.exp(ahead + behind - total[:, None, None]) * mask[:, :, None]
        g["first"] += d_score[:, 0].sum(0) / b
        for t in range(1, n):
            both = np.exp(ahead[:, t - 1, :, None] + step + (score[:, t] + behind[:, t])[:, None, :]
                          - total[:, None, None]) * mask[:, t, None, None]
            g["step"] += both.sum(0) / b
            np.add.at(g["step"], (tags[:, t - 1], tags[:, t]), -(mask[:, t] / b))
            d_score[rows, t, tags[:, t]] -= mask[:, t]
        d_score[rows, 0, tags[:, 0]] -= 1
        np.add.at(g["first"], tags[:, 0], -1 / b)
        d_score = (d_score / b).astype(np.float32)
        g["out"] += np.tensordot(hidden, d_score, axes=([0, 1], [0, 1]))
        g["bias"] += d_score.sum((0, 1))
        d_hidden = d_score @ self.w["out"].T
        d_x = self._back(d_hidden[:, :, :HIDDEN], x, kf, "f", g) + self._back(d_hidden[:, :, HIDDEN:], x, kb, "b", g)
        np.add.at(g["embed"], codes.ravel(), d_x.reshape(-1, EMBED))
        return g

    def train(self, codes: np.ndarray, tags: np.ndarray, mask: np.ndarray, rounds: int = 6, rate: float = 8e-3) -> None:
        r, step = np.random.default_rng(9), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for _ in range(rounds):
            for part in np.array_split(r.permutation(len(codes)), max(1, len(codes) // 64)):
                step += 1
                for k, g in self.gradients(codes[part], tags[part], mask[part]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = (self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (
                        np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self.trained = True

    def decode(self, score: np.ndarray) -> np.ndarray:
        """The best path over one neighbourhood."""
        n, step = len(score), self.w["step"]
        best, came = score[0] + self.w["first"], np.zeros((n, TAGS), np.int64)
        for t in range(1, n):
            ways = best[:, None] + step
            came[t] = ways.argmax(0)
            best = ways.max(0) + score[t]
        path = np.zeros(n, np.int64)
        path[-1] = best.argmax()
        for t in range(n - 1, 0, -1):
            path[t - 1] = came[t, path[t]]
        return path

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """Of each text. The windows of all texts are scored in groups; every neighbourhood is decoded as one."""
        weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)
        places = [(i, start, end) for i, text in enumerate(texts) for start, end in neighbourhoods(text)]
        total = [np.zeros((end - start, TAGS), np.float32) for _, start, end in places]
        seen = [np.zeros((end - start, 1), np.float32) for _, start, end in places]
        windows = [(p, s, min(s + WINDOW, end)) for p, (_, start, end) in enumerate(places)
                   for s in window_starts(start, end)]
        for k in range(0, len(windows), 512):
            part = windows[k:k + 512]
            scores, _ = self.scores(encoded([texts[places[p][0]][s:e] for p, s, e in part]))
            for (p, s, e), score in zip(part, scores):
                at = s - places[p][1]
                total[p][at:at + e - s] += score[:e - s] * weight[:e - s, None]
                seen[p][at:at + e - s] += weight[:e - s, None]
        found: list[list[Span]] = [[] for _ in texts]
        for (i, start, _), t, n in zip(places, total, seen):
            found[i] += spans_of(self.decode(t / n), start)
        return found


def spans_of(path: np.ndarray, start: int) -> list[Span]:
    """Spans of a path of tags; a continuation of another kind begins a span of its own."""
    out: list[Span] = []
    at, kind = 0, -1
    for i, tag in enumerate([*path.tolist(), 0]):
        now = (tag - 1) // 2 if tag else -1
        if kind >= 0 and (now != kind or tag % 2 == 1):
            out.append((KINDS[kind], start + at, start + i))
            kind = -1
        if now >= 0 and kind < 0:
            at, kind = i, now
    return out


def whole(text: str, span: Span) -> bool:
    """False if the span begins or ends inside a run of letters and digits."""
    _, start, end = span
    return not any(0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum() for at in (start, end))


def labelled_windows(docs: DataFrame) -> DataFrame:
    """(chars, tags, draw) of the sampled documents: windows around digits and ``@``, and a few of other places."""
    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"].tolist():
                text = text or ""
                base = sorted(base_spans(text), key=lambda s: s[1]) if TRIGGER.search(text) else []
                begins, longest = [s[1] for s in base], max([s[2] - s[1] for s in base], default=0)
                ranges = neighbourhoods(text) + [(s, min(len(text), s + WINDOW)) for s in range(0, len(text), 2000)]
                for start, end in ranges:
                    near = base[bisect_left(begins, start - longest):bisect_left(begins, end)]
                    for s in window_starts(start, end):
                        e = min(s + WINDOW, end)
                        rows.append((text[s:e], tags_of(near, s, e)))
            yield pd.DataFrame(rows, columns=["chars", "tags"])

    sampled = docs.where(sample_bound(docs.count(), SAMPLE_DOCS)).select("text")
    return sampled.mapInPandas(label, "chars string, tags string").distinct().withColumn(
        "draw", F.xxhash64("chars", "tags"))


def fit(docs: DataFrame) -> Tagger:
    rows, tagger = materialize(labelled_windows(docs)), Tagger()
    holds = F.col("tags").rlike("[1-9]")
    picked = [r for some in (holds, ~holds) for r in rows.where(some).orderBy("draw", "chars").limit(SAMPLE_ROWS).collect()]
    if not any(r["tags"].strip("0") for r in picked):
        return tagger
    picked.sort(key=lambda r: (r["draw"], r["chars"]))
    picked = [r for r in picked if r["chars"]]
    tags, mask = np.zeros((len(picked), WINDOW), np.int64), np.zeros((len(picked), WINDOW), bool)
    for i, r in enumerate(picked):
        tags[i, :len(r["tags"])] = [int(c) for c in r["tags"]]
        mask[i, :len(r["tags"])] = True
    tagger.train(encoded([r["chars"] for r in picked]), tags, mask)
    return tagger


def find_personal(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """All rows and columns of ``docs`` with n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added."""
    def added(texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
        if not tagger.trained:
            return [[] for _ in texts]
        covers = [Cover(base) for base in bases]
        return [
            [s for s in own if not cover.meets(s[1], s[2]) and whole(text, s)
             and ("@" in text[s[1]:s[2]] or len(_digits(text[s[1]:s[2]])) >= 4)]
            for text, cover, own in zip(texts, covers, tagger.spans(texts))
        ]

    result = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    kept = [f"`{c}`" for c in docs.columns if c not in (*result, "__found")]
    find = finder(KINDS, base_spans, added, in_order)
    return docs.select(*kept, find(F.col("text")).alias("__found")).select(*kept, *[f"__found.{c}" for c in result])
