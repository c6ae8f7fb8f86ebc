"""Hashes of words and word shingles of whole texts, in numpy, without an object for each word."""

from __future__ import annotations

import numpy as np

_U = np.uint64
GOLD = _U(0x9E3779B97F4A7C15)
_BASE, _BASE_INVERSE = 0x9DDFEA08EB382D69, pow(0x9DDFEA08EB382D69, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Word characters: ASCII letters and digits, and every byte of other characters.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BYTE = mix(np.arange(1, 257, dtype=_U) * GOLD)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(max(n, 1 << 19), base, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in a row, and where each text's begin (one more at the end)."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    inside = _WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * up, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of ``size`` words; a shorter text with a word is one shingle."""
    n = np.diff(bounds)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    of = np.repeat(np.arange(len(n)), count)
    first = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(of))
    out, padded = np.zeros(len(of), _U), np.append(words, np.zeros(size, _U))
    last = bounds[1:][of]
    for j in range(size):
        at = first + j
        out = mix(out * GOLD + np.where(at < last, padded[at], _U(j)))
    return out, of
