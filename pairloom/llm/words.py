"""Words of UTF-8 texts as 64-bit hashes, by whole-array operations. ASCII capitals count as small letters."""

from __future__ import annotations

import numpy as np

BLANK_SEPARATED = np.ones(256, bool)
BLANK_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.ones(256, bool)
ALPHANUMERIC[:128] = False
for _first, _last in ("09", "az", "AZ"):
    ALPHANUMERIC[ord(_first):ord(_last) + 1] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A"):ord("Z") + 1] += np.uint64(32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(data: bytes, in_word: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, in order: the sum over its bytes of a hash of byte and place, so cost is linear."""
    raw = np.frombuffer(data, np.uint8)
    inside = in_word[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    letters = raw[inside]
    place = (np.arange(len(letters)) - np.repeat(firsts, lengths)).astype(np.uint64)
    value = mixed((_LOWER[letters] << np.uint64(32)) + place + np.uint64(1))
    return mixed(np.add.reduceat(value, firsts) + lengths.astype(np.uint64))
