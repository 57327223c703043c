"""Vectorised hashes of words and byte ranges, on numpy arrays inside tasks.

A range hash is the difference of two prefix sums of ``T[byte] * P**i`` modulo 2**64, moved back to exponent 0 and
mixed. Any range of a buffer costs O(1) once the prefix sums are there, which is what sliding windows need.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

#: Bytes that part words: space and 0x09-0x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base, or of its inverse, modulo 2**64; kept per worker in steps of 64 Ki."""
    key = "inverse" if inverse else "base"
    if len(_powers.get(key, ())) < n:
        a = np.full(max(-(-n // 65536) * 65536, 1 << 19), _INVERSE if inverse else _BASE, np.uint64)
        a[0] = 1
        _powers[key] = np.multiply.accumulate(a)
    return _powers[key][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base**i, with a leading 0; uint64, wrapping."""
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTES[data]


def byte_prefix(data: np.ndarray) -> np.ndarray:
    return prefix(byte_values(data))


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each [start, end) of the sequence that ``sums`` came from; the length takes part."""
    h = (sums[end] - sums[start]) * powers(len(sums), True)[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """Hashes of byte ranges whose starts ascend. Prefix sums are made for about ``step`` bytes at a time."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + step, "left")))
        low = int(start[i])
        out[i:j] = ranges(byte_prefix(data[low : int(end[i:j].max())]), start[i:j] - low, end[i:j] - low)
        i = j
    return out


def windows(sums: np.ndarray, size: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The hash of every window of ``size`` that starts in [first, last)."""
    last = max(first, len(sums) - size) if last is None else last
    h = (sums[first + size : last + size] - sums[first:last]) * powers(len(sums), True)[first:last]
    return mix(h + np.uint64(size * 0xA0761D6478BD642F % (1 << 64)))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer."""
    gap = np.empty(len(data) + 2, bool)
    gap[0] = gap[-1] = True
    gap[1:-1] = SEPARATOR[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, step: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a buffer. Prefix sums are made for about ``step`` bytes at a time."""
    start, end = words(data)
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + step, "right")))
        low = int(start[i])
        out[i:j] = ranges(byte_prefix(data[low : int(end[j - 1])]), start[i:j] - low, end[i:j] - low)
        i = j
    return start, end, out


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` neighbours: block-wise running minima from both sides (van Herk)."""
    n = len(x) - size + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // size) * size, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, size)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[size - 1 : size - 1 + n])
