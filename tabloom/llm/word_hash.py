"""Words of a text and their 64-bit hashes, vectorised over the text's bytes.

A word is a run of bytes other than the space and the control characters 9 to 13. All of these
are ASCII, so words of bytes are words of characters. Hashes depend on the word alone.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLOCK = 1 << 16
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _BLOCK + 1), _powers(_INVERSE, _BLOCK + 1)


def bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[np.frombuffer(raw, dtype=np.uint8)]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends): a polynomial of the word's bytes, mixed with its length."""
    starts, ends = bounds(raw)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts, ends
    up, down = (_UP, _DOWN) if len(raw) <= _BLOCK else (_powers(_BASE, len(raw) + 1), _powers(_INVERSE, len(raw) + 1))
    values = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(raw)], out=sums[1:])
    found = (sums[ends] - sums[starts]) * down[starts]
    return mix(found + (ends - starts).astype(np.uint64) * _INVERSE), starts, ends


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` neighbouring words, in order."""
    n = len(hashes) - width + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(width if n > 0 else 0):
        out = mix(out * _BASE + hashes[k : k + n])
    return out


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` neighbouring words by differences of a running polynomial."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    up, down = (_UP, _DOWN) if n <= _BLOCK else (_powers(_BASE, n + 1), _powers(_INVERSE, n + 1))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: n - width + 1])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbouring values, by doubling."""
    covered, out = 1, values
    while covered < width:
        step = min(covered, width - covered)
        out = np.minimum(out[:-step], out[step:])
        covered += step
    return out
