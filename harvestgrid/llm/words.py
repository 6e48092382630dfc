"""Words of a text as 64-bit hashes, in numpy.

A word is a run of letters and digits (as ``str.isalnum`` has it) of the lower-cased text. All functions take
one whole text, or arrays made from it.
"""

from __future__ import annotations

import functools

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


@functools.cache
def _word_chars() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def _power_tables(size: int) -> list[np.ndarray]:
    if len(_powers[0]) < size:
        size = max(size, 1 << 17)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased text, and the start and end of each word in them."""
    points = code_points(text.lower())
    edge = np.diff(_word_chars()[points].astype(np.int8), prepend=0, append=0)
    return points, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word, in order; none for null or empty text."""
    if not text:
        return np.empty(0, np.uint64)
    points, starts, ends = word_spans(text)
    powers, inverse = _power_tables(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points + np.uint64(1)) * powers[: len(points)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words, in order. Fewer words than that are one run; no words, none."""
    n = min(n, len(words))
    if n == 0:
        return np.empty(0, np.uint64)
    out = words[: len(words) - n + 1]
    for k in range(1, n):
        out = mix(out * np.uint64(_BASE) + words[k : len(words) - n + 1 + k])
    return out


def hash_of(name: str) -> int:
    """The hash that ``word_hashes`` gives to a text that is one word."""
    return int(word_hashes(name)[0])
