"""Runs of bytes (words, units) of many texts at once: their hashes and which of them are distinct, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, for 2**bits places."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(1 << bits, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


#: Bytes that are hashed at once, at most (or one run).
PART = 1 << 20


def hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:stop] for each run, in ascending order; it depends on the run's bytes alone."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        first = int(start[i])
        j = max(i + 1, int(np.searchsorted(stop, first + PART, side="right")))
        out[i:j] = _hashes(data[first : int(stop[j - 1])], start[i:j] - first, stop[i:j] - first)
        i = j
    return out


def _hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    power, inverse = _powers(max(20, int(len(data)).bit_length()))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    part = data.astype(np.uint64)
    part += np.uint64(1)
    part *= power[: len(data)]
    np.cumsum(part, out=total[1:])
    h = total[stop]
    h -= total[start]
    h *= inverse[start]
    h += (stop - start).astype(np.uint64) << np.uint64(48)
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct value, in order of the values, and each place's number among the distinct values."""
    order = np.argsort(h)
    own = h[order]
    fresh = np.empty(len(h), bool)
    fresh[:1] = True
    np.not_equal(own[1:], own[:-1], out=fresh[1:])
    number = np.empty(len(h), np.int32)
    number[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    return order[fresh], number
