"""Words of many texts at once: folded bytes, where words start and end, and a 64-bit hash per word."""

from __future__ import annotations

import hashlib

import numpy as np

_CODE = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LONG = 64


def hash_words(folded: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes (never 0) of the runs of word bytes."""
    edge = np.flatnonzero(np.diff(is_word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[0::2], edge[1::2]
    size, h = end - start, np.zeros(len(start), np.uint64)
    live = np.flatnonzero(size <= _LONG)
    for j in range(int(size[live].max(initial=0))):
        live = live[size[live] > j]
        h[live] = h[live] * _BASE + _CODE[folded[start[live] + j]]
    for i in np.flatnonzero(size > _LONG):
        h[i] = int.from_bytes(hashlib.blake2b(folded[start[i]:end[i]].tobytes(), digest_size=8).digest(), "little")
    return start, end, np.maximum(h, np.uint64(1))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
