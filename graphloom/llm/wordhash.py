"""Hashed words and word n-grams of UTF-8 bytes, vectorised per text."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

_PRIME = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive values, by row; empty where there are fewer."""
    m = h.shape[-1] - n + 1
    if m <= 0:
        return np.zeros((*h.shape[:-1], 0), np.uint64)
    out = h[..., :m].copy()
    for j in range(1, n):
        out = out * np.uint64(_PRIME) + h[..., j : j + m]
    return mixed(out)


def among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in ``values``, a short array next to it."""
    if not len(values):
        return np.zeros(len(x), bool)
    values = np.sort(values)
    at = np.searchsorted(values, x)
    at[at == len(values)] = 0
    return values[at] == x


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles of a text.

    A-Z are lowered (bytes.lower touches nothing else) and words end at space
    and \\t \\n \\v \\f \\r, just what bytes.split() takes. Fewer words than
    ``n`` count as one shingle; no words as none.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    return np.unique(gram_hashes(h, min(n, len(h))))
