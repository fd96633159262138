"""Word shingles of whole texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from vellumspark.llm.kept import kept

#: A worker keeps the hashes of so many words.
KEPT_WORDS = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """The distinct shingles of ``words`` words, sorted. A-Z are lowered; words are what the six ASCII spaces
    (x20, x09-x0D) part, just as bytes.split() does. A text of fewer words is one shingle; without words: none."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(kept("shingles", _Hashes).__getitem__, parts), np.uint64, len(parts))
    width = min(words, len(h))
    with np.errstate(over="ignore"):
        total = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            total = mixed(total * _ODD + h[k : len(h) - width + 1 + k])
    return np.unique(total)


def shared_count(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
