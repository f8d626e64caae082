"""Words and word hashes of a whole Arrow batch at once, by numpy.

A text is its UTF-8 bytes. Words are runs of bytes outside space and 0x09-0x0D, so a hash per word needs two
array lookups: the difference of a prefix sum of `table[byte] * base**i` at both ends, shifted back by the
inverse power. All arithmetic is modulo 2**64; the byte table is random, so equal hashes mean equal words but
for a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PIECE = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.Generator(np.random.PCG64(20240917)).integers(1, 1 << 63, 256, np.uint64)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row begins; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def row_chunks(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + 1)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences, times base**-start, hash any byte range."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end)."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about PIECE bytes that end between rows or after a space."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + PIECE, n)
        if end < n:
            row = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            spaces = np.flatnonzero(SPACE[data[at:end]])
            best = max(row, at + int(spaces[-1]) + 1 if len(spaces) else 0)
            if best <= at:  # one word longer than a piece
                row = int(offsets[np.searchsorted(offsets, end, "left")])
                spaces = np.flatnonzero(SPACE[data[end:row]])
                best = end + int(spaces[0]) + 1 if len(spaces) else row
            end = best
        yield at, end
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word, and where each row's words begin among them. `fold` maps bytes first."""
    hashes, starts = [], []
    for a, b in _cuts(data, offsets):
        part = data[a:b] if fold is None else fold[data[a:b]]
        first = np.zeros(b - a + 1, bool)
        cut = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a
        first[cut] = True
        inside = ~SPACE[part]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | first[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:-1]
        s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
        hashes.append(range_hashes(prefix_hashes(part), s, e))
        starts.append(s + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row, the sum of `flags` over its range."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
