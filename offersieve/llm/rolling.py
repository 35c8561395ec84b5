"""Hashes of any span of a sequence from one prefix sum, with numpy inside tasks."""

from __future__ import annotations

import numpy as np

from offersieve.llm.hashing import mix

_BASE = 0xAF251AF3B0F025B5
_POWER = _INVERSE = np.ones(1, np.uint64)


def _grown(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def sums(values: np.ndarray) -> np.ndarray:
    """The running polynomial sum of 64-bit values, one longer than they are."""
    global _POWER, _INVERSE
    n = len(values)
    if len(_POWER) <= n:
        size = max(n + 1, 1 << 15, 2 * len(_POWER))
        _POWER, _INVERSE = _grown(_BASE, size), _grown(pow(_BASE, -1, 1 << 64), size)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _POWER[:n], out=out[1:])
    return out


def spans(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span [start, end), whatever its place."""
    return mix((running[ends] - running[starts]) * _INVERSE[starts])
