"""Spans found in texts: how they are written down and joined."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Span = tuple[str, int, int]  # kind, start, end (exclusive), in code points


def written(spans: Sequence[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def digest(spans: Sequence[Span]) -> str:
    return hashlib.sha256(written(spans).encode()).hexdigest()


class Cover:
    """The characters that spans cover, as merged intervals; asks in logarithmic time whether a range meets them."""

    def __init__(self, spans: Sequence[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, start, end in sorted(spans, key=lambda s: s[1]):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start


def finder(kinds: Sequence[str], base: Callable[[str], list[Span]], added: Callable[[list[str], list[list[Span]]], list[list[Span]]],
           order: Callable[[Span], tuple]):
    """A column function: text to counts per kind of the base spans, their digest, all spans, and how many were added.

    ``added`` gets a batch of texts with their base spans, so that a model sees many windows at once.
    """
    fields = ", ".join(f"n_{k} long" for k in kinds)

    @F.pandas_udf(f"{fields}, base_sha256 string, spans string, n_added long")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            whole = [text or "" for text in texts.tolist()]
            fixed = [sorted(base(text), key=order) for text in whole]
            rows = [
                [*(sum(s[0] == k for s in own) for k in kinds), digest(own), written(sorted([*own, *more], key=order)),
                 len(more)]
                for own, more in zip(fixed, added(whole, fixed))
            ]
            yield pd.DataFrame(rows, columns=[*(f"n_{k}" for k in kinds), "base_sha256", "spans", "n_added"])

    return find


def sample_bound(n: int, most: int) -> Column:
    """True for a part of the documents, chosen by hashed id, of ``most`` in expectation (all if there are fewer)."""
    drawn = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("sample")), F.lit(2**31))
    return drawn < int(2**31 * min(1.0, most / max(n, 1)))
