"""64-bit hashes of words and word shingles, computed with numpy inside tasks.

A word is a run of bytes other than 20 and 09-0D; A-Z count as a-z.  Word
hashes are differences of a running polynomial sum, brought back to the start
of the word, so a text of any length is hashed in bounded pieces.
"""

from __future__ import annotations

import numpy as np

_PIECE = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def series(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(seed))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = series(256, 7)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]
_POW = _INV = np.ones(1, np.uint64)


def _tables(n: int) -> None:
    global _POW, _INV
    if len(_POW) < n:
        n = max(n, 1 << 15, 2 * len(_POW))
        _POW, _INV = _powers(_BASE, n), _powers(_INVERSE, n)


def _hashes(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    n = len(a)
    _tables(n + 1)
    padded = np.ones(n + 2, bool)
    padded[1:-1] = _SPACE[a]
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[a] * _POW[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _INV[starts])


def word_hashes(text: str | None) -> np.ndarray:
    """One hash for each word, in order."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if len(data) <= _PIECE:
        return _hashes(data) if data else np.zeros(0, np.uint64)
    out, at = [], 0
    while at < len(data):
        to = min(at + _PIECE, len(data))
        while to < len(data) and not _SPACE[data[to]]:  # a piece ends at white space
            to += 1
        out.append(_hashes(data[at:to]))
        at = to
    return np.concatenate(out)


_PLACES = series(64, 11) | np.uint64(1)


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive words, in order; none for fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * _PLACES[0]
    for i in range(1, k):
        out += words[i : n + i] * _PLACES[i]
    return mix(out)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; fewer words are one shingle; none without words."""
    words = word_hashes(text)
    if 0 < len(words) < k:
        return windows(words, len(words))
    return np.unique(windows(words, k))
