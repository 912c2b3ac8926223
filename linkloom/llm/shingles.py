"""Word shingles of whole texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
_U = np.uint64
#: Odd multipliers, one for each word of a shingle, from a fixed generator.
_rng = np.random.default_rng(20240501)


def odd(count: int, rng=_rng) -> np.ndarray:
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * _U(2) + _U(1)


_PLACES = odd(64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Distinct shingles of a text: A-Z lower-cased, words between ASCII white space; of a shorter text the whole sequence."""
    tokens = text.encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and ASCII white space only
    m = len(tokens)
    if not m:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, m)
    size = min(words, m)
    total = np.full(m - size + 1, size, np.uint64)
    for n in range(size):
        total += h[n : m - size + 1 + n] * _PLACES[n]
    return np.unique(mix(total))
