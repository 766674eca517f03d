"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A window of three letters (runs of other characters count as one
blank, also at both ends) is bound into one vector: the first letter's vector rotated twice, times the second's rotated
once, times the third's. A text is the sum of its windows' vectors, a language the sum of the normalised vectors of its
training texts, and a text is given the language whose vector has the largest cosine.

The profile is fitted on a sample of labelled documents: all of a language if there are at most ``per_language``,
otherwise those whose hashed id falls below a bound, ``per_language`` of them in expectation. Sums are integers, so the
profile does not depend on the order of the rows. At most ``max_languages`` languages, else ValueError.

Null text, or no letter: ``und`` with score 0; so is everything if nothing was labelled. Null language: not learned from.
Ties: the first language by name. A negative cosine has score 0. Repeated rows are predicted alike and learned from
twice. A null id takes no part in learning. Long texts are cut after so many characters, at a blank if there is one, and
their parts' vectors added. Only named columns are read; ``predict`` keeps all columns and replaces those it adds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
PER_LANGUAGE = 2_000
MAX_LANGUAGES = 1_000
UNKNOWN = "und"
# A text is in no known language if its best cosine is not above what vectors that have nothing in common reach: their
# cosine has a standard deviation of 1 / sqrt(DIMENSIONS), and this is twice that. Fewer letters cannot tell.
FLOOR = 2 / DIMENSIONS ** 0.5
LEAST_LETTERS = 8
# Texts whose vectors are made together, and where a long text is cut.
GROUP_TEXTS, GROUP_CHARS = 256, 1_000_000
_BLANK = ord(" ")
_ALL = 0x110000


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(_ALL)), bool, _ALL)


@cache
def _letter_vector(code: int) -> np.ndarray:
    bits = np.random.Generator(np.random.Philox(key=[code, 2024])).integers(0, 2, DIMENSIONS, dtype=np.int8)
    return (2 * bits - 1).astype(np.int8)


def _pieces(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > GROUP_CHARS:
        cut = text.rfind(" ", start + GROUP_CHARS // 2, start + GROUP_CHARS) + 1 or start + GROUP_CHARS
        yield text[start:cut]
        start = cut
    yield text[start:]


def _vectors_of(texts: list[str]) -> np.ndarray:
    """One row per text: the sum of its windows' vectors."""
    raw = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    codes = np.concatenate(raw)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in raw])
    codes = np.where(_is_letter()[codes], codes, _BLANK)
    blank = codes == _BLANK
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (row[1:] == row[:-1]))
    codes, row = codes[keep], row[keep]
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    if len(codes) < 3:
        return out
    seen = np.zeros(_ALL, bool)
    seen[codes] = True
    letters = np.flatnonzero(seen)
    number = np.zeros(_ALL, np.int64)
    number[letters] = np.arange(len(letters))
    n, at = len(letters), number[codes]
    inside = row[2:] == row[:-2]
    grams = ((at[:-2] * n + at[1:-1]) * n + at[2:])[inside]
    row = row[:-2][inside]
    if n ** 3 <= 8_000_000:  # the same distinct windows, by a table instead of a sort
        there = np.zeros(n ** 3, bool)
        there[grams] = True
        distinct = np.flatnonzero(there)
        place = np.zeros(n ** 3, np.int32)
        place[distinct] = np.arange(len(distinct))
        grams = place[grams]
    else:
        distinct, grams = np.unique(grams, return_inverse=True)
    if not len(distinct):
        return out
    table = np.stack([_letter_vector(int(c)) for c in letters])
    once, twice = np.roll(table, 1, axis=1), np.roll(table, 2, axis=1)
    step = 8192
    for start in range(0, len(distinct), step):  # bounds the matrices when there are very many distinct windows
        part = distinct[start:start + step]
        mine = (grams >= start) & (grams < start + step)
        counts = np.bincount(row[mine] * len(part) + (grams[mine] - start), minlength=len(texts) * len(part))
        bound = twice[part // (n * n)] * once[part // n % n] * table[part % n]
        out += counts.reshape(len(texts), len(part)).astype(np.float32) @ bound.astype(np.float32)
    return out


def vectors(texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(position, vector) of every text, in groups of bounded size."""
    group, where, held = [], [], 0

    def flush() -> Iterator[tuple[int, np.ndarray]]:
        whole: dict[int, np.ndarray] = {}
        for i, v in zip(where, _vectors_of(group)):
            whole[i] = whole[i] + v if i in whole else v
        yield from whole.items()

    for i, text in enumerate(texts):
        parts = list(_pieces(text or ""))
        if group and (len(group) >= GROUP_TEXTS or held + len(text or "") > GROUP_CHARS):
            yield from flush()
            group, where, held = [], [], 0
        if len(parts) > 1:
            yield i, np.sum([_vectors_of([p])[0] for p in parts], axis=0)
            continue
        group.append(parts[0])
        where.append(i)
        held += len(parts[0])
    if group:
        yield from flush()


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """(lang, text) of the sample to learn from. Texts are filtered where they are read, and not shuffled."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    shares = [(r["lang"], min(1.0, per_language / r["n"])) for r in counts]
    known = F.broadcast(docs.sparkSession.createDataFrame(shares, "_l string, _p double"))  # at most max_languages rows
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(2**31)) / 2**31
    return labelled.join(known, F.col("lang") == F.col("_l")).where(drawn < F.col("_p")).select("lang", "text")


def learn(rows: DataFrame, max_languages: int = MAX_LANGUAGES) -> dict[str, np.ndarray]:
    """Unit vectors by language. Tasks bundle what they hold; sums of whole numbers meet in one aggregation."""
    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch["lang"].tolist()
            for i, v in vectors(batch["text"].tolist()):
                size = float(np.linalg.norm(v))
                if size:
                    unit = np.rint(1e4 * v / size).astype(np.int64)
                    sums[langs[i]] = sums.get(langs[i], 0) + unit
        if sums:
            yield pd.DataFrame({"lang": list(sums), "sums": [v.tolist() for v in sums.values()]})

    parts = rows.mapInPandas(bundle, "lang string, sums array<long>").select("lang", F.posexplode("sums"))
    by_place = parts.groupBy("lang", "pos").agg(F.sum("col").alias("v"))
    profile = by_place.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("v"))
    found = profile.limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    out = {}
    for r in sorted(found, key=lambda r: r["lang"]):
        v = np.array([x["v"] for x in r["v"]], np.float64)
        if np.linalg.norm(v):
            out[r["lang"]] = (v / np.linalg.norm(v)).astype(np.float32)
    return out


def predictor(profile: dict[str, np.ndarray]):
    """A column function: text to struct(lang_pred, score)."""
    names = list(profile)
    matrix = np.stack(list(profile.values())) if names else np.zeros((0, DIMENSIONS), np.float32)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for i, v in vectors(texts.tolist()):
                size = float(np.linalg.norm(v))
                if size and names:
                    cosines = matrix @ v
                    best = int(np.argmax(cosines))
                    langs[i], scores[i] = names[best], min(1.0, max(0.0, float(cosines[best]) / size))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0


def predict(docs: DataFrame, profile: dict[str, np.ndarray]) -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred`` and ``score``."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "__found")]
    return (
        docs.select(*[f"`{c}`" for c in kept], predictor(profile)(F.col("text")).alias("__found"))
        .select(*[f"`{c}`" for c in kept], "__found.lang_pred", "__found.score")
    )


def fit(docs: DataFrame) -> dict[str, np.ndarray]:
    """The profile of the documents that are not held out."""
    return learn(training_rows(docs.where(~held_out())))


def in_known_language(text: str = "text") -> Column:
    """Of a row with ``lang_pred`` and ``score``: whether the text is in one of the languages learned. False for texts
    without a letter, and for texts of ``LEAST_LETTERS`` letters or more whose score is below ``FLOOR``."""
    letters = F.length(F.regexp_replace(text, "\\P{L}", ""))
    return (F.col("lang_pred") != UNKNOWN) & ((F.col("score") >= FLOOR) | (letters < LEAST_LETTERS))
