"""Word runs and their hashes, shared by the operators on text similarity."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Maximal runs of letters and numbers.
WORD = re.compile(r"[^\W_]+")


class WordHashes(dict):
    """word -> 64-bit hash. Emptied when it grows beyond `most` words, which changes no value."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(words: list[str], size: int, table: WordHashes) -> np.ndarray:
    """64-bit hashes of all runs of `size` consecutive words, in order, repeats kept; empty when there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out
