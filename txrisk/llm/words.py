"""Words and word runs as 64-bit hashes, for many texts at once.

A word is ``[^\\x20\\x09-\\x0D]+``, which is how ``bytes.split()`` cuts. A run of words has a
polynomial of its words' hashes; two multipliers give two independent hashes of a run.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
from xxhash import xxh3_64_intdigest

FIRST = np.uint64(0x9E3779B97F4A7C15)
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and the number of words of each."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(texts)), np.uint64, sizes.sum()), sizes


def runs(hashes: np.ndarray, width: int, factor: np.uint64 = FIRST) -> np.ndarray:
    """The hash of every run of ``width`` hashes."""
    count = max(0, len(hashes) - width + 1)
    out = hashes[:count].copy()
    for k in range(1, width):
        out = out * factor + hashes[k : count + k]
    return out


def starts_of_runs(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a run of ``width`` words lies within one text, and that text."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    count = max(0, len(owner) - width + 1)
    at = np.flatnonzero(owner[:count] == owner[len(owner) - count :]) if count else np.zeros(0, np.int64)
    return at, owner[at]


def shingle_sets(texts: list[list[bytes]], width: int) -> list[np.ndarray]:
    """The ascending distinct run hashes of each text; a shorter text is one run as a whole."""
    hashes, sizes = word_hashes(texts)
    ends = np.cumsum(sizes)
    return [
        np.unique(runs(hashes[end - n : end], min(n, width)) + np.uint64(max(0, width - n)))
        if n
        else np.zeros(0, np.uint64)
        for n, end in zip(sizes.tolist(), ends.tolist(), strict=True)
    ]
