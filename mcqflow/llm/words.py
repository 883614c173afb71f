"""Digests of words and of stretches of words, by array operations.

A digest is a polynomial modulo 2**64 over random numbers, read off prefix sums and mixed. Such
polynomials have texts that collide whatever the base, from a thousand bytes on; words above
``LONG_WORD`` bytes are therefore digested one by one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

U = np.uint64
SLICE = 1 << 20  # bytes for which arrays are made at a time
LONG_WORD = 48
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; wraps around."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name for the pair of two names."""
    return mix(a * U(_BASE) + mix(b + U(0x632BE59BD9B4E019)))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    steps = [np.full(n, b, dtype=U) for b in (_BASE, pow(_BASE, -1, 2**64))]
    for s in steps:
        s[0] = 1
    return np.cumprod(steps[0]), np.cumprod(steps[1])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = _powers(1 << max(n, 1024).bit_length())
    return a[:n], b[:n]


def stretches(names: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int = 3) -> np.ndarray:
    """A digest of names [low, high) for each pair."""
    n = len(names)
    power, back = powers(n + 1)
    sums = np.zeros(n + 1, dtype=U)
    np.cumsum(mix(names + U(seed)) * power[:n], out=sums[1:])
    return mix((sums[high] - sums[low]) * back[low] + (high - low).astype(U))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = mix(np.arange(256, dtype=U) + U(0xD1B54A32D192ED03))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _slices(data: bytes) -> Iterator[tuple[int, int]]:
    """Slices that end at white space."""
    begin = 0
    while begin < len(data):
        end = begin + SLICE
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield begin, min(end, len(data))
        begin = end


def word_names(data: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Digest and start of each word, a run of anything but ASCII white space; ``lower`` takes
    A-Z for a-z."""
    table, names, starts = _LOWER if lower else _BYTE, [], []
    for begin, end in _slices(data):
        chars = np.frombuffer(data, np.uint8, end - begin, begin)
        n = len(chars)
        space = np.ones(n + 2, dtype=np.int8)
        space[1:-1] = _SPACE[chars]
        edge = space[1:] - space[:-1]
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        power, back = powers(n)
        sums = np.zeros(n + 1, dtype=U)
        np.cumsum(table[chars] * power, out=sums[1:])
        made = mix((sums[stop] - sums[start]) * back[start] + (stop - start).astype(U) * U(0x8CB92BA72F3D8DD7))
        for i in np.flatnonzero(stop - start > LONG_WORD).tolist():
            word = chars[start[i] : stop[i]].tobytes()
            made[i] = int.from_bytes(blake2b(word.translate(_LOWER_BYTES) if lower else word, digest_size=8).digest(), "little")
        names.append(made)
        starts.append(start + begin)
    if not names:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    return np.concatenate(names), np.concatenate(starts)


def words_of_texts(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the words of all texts, and where the words of each text start and stop."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    names, start = word_names(b" ".join(texts), lower)
    return names, np.searchsorted(start, np.r_[0, np.cumsum(sizes)])
