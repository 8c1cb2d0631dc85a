"""Vectorised byte and word work on many texts at once: prefix polynomial hashes, words, shingles."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    have = _powers.get(0)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        up, down = np.full(size, BASE), np.full(size, INVERSE)
        up[0] = down[0] = 1
        have = _powers[0] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a polynomial hash can be compared."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of (values[j] + 1) * BASE**j over j < i."""
    out = np.zeros(len(values) + 1, np.uint64)
    up, _ = powers(len(values))
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unmixed polynomial hash of values[start:end] for arrays of starts and ends."""
    _, down = powers(len(p))
    return (p[end] - p[start]) * down[start]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD[_lo:_hi] = True


def fold(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with A-Z and the capitals of Latin-1 lower-cased, whether each belongs to a word).

    Letters, digits and all characters beyond ASCII count as parts of words, but for U+0080-00BF and
    U+2000-207F (spaces, quotes, dashes).
    """
    low, word = LOWER[data], WORD[data]
    if len(data) > 1 and (data >= 0x80).any():
        c3 = np.flatnonzero(data[:-1] == 0xC3) + 1
        up = c3[(data[c3] >= 0x80) & (data[c3] <= 0x9E) & (data[c3] != 0x97)]
        low[up] += 0x20
        c2 = np.flatnonzero(data[:-1] == 0xC2)
        word[c2] = word[c2 + 1] = False
        e2 = np.flatnonzero((data[:-1] == 0xE2) & (data[1:] >> 1 == 0x40))
        word[e2] = word[e2 + 1] = False
        word[np.minimum(e2 + 2, len(data) - 1)] = False
    return low, word


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts: (64-bit hash, byte start, byte end, first word of each text plus the total)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(off), np.int64)
    low, word = fold(data)
    start = word.copy()
    start[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    inner = off[(off > 0) & (off < n)]
    start[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return mix(span_hash(prefix(low), s, e)), s, e, np.searchsorted(s, off)


def shingles(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i:i+k] at each i; the last k - 1 places are left out."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * BASE + w[j : j + n]
    return mix(h)
