"""Vectorised hashes of words and n-grams of a text held as an array of bytes or code points."""

from __future__ import annotations

import numpy as np

# A 64-bit value for each byte, and powers of an odd number and of its inverse modulo 2^64.
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 2**64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(which: int, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            _powers[which] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, (_P, _P_INVERSE)[which], np.uint64)]))
    return _powers[which][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finisher: every bit of the input touches every bit of the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class SpanHashes:
    """64-bit hashes of any spans of a byte string, each from two prefix sums of a polynomial modulo 2^64."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _power(0, len(data)))])
        self.back = _power(1, len(data) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def span_hashes(words: np.ndarray):
    """A function of ranges [a, b) of words, given as 64-bit hashes, to 64-bit hashes of the ranges' words in order."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _power(0, len(words)))])

    def of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((sums[b] - sums[a]) * _power(1, len(words) + 1)[a] + (b - a).astype(np.uint64))

    return of


def word_spans(data: np.ndarray, is_space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes for which is_space (a table of 256) is false."""
    inside = np.concatenate([[False], ~is_space[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


#: Tables for the white space of the contracts: blank, and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
