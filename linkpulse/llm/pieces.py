"""Bounded pieces of an Arrow text column, and where the words of each lie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .words import _cuts, row_chunks


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of about 1 MB; a longer row comes in several pieces, cut after a space."""
    for i, j in row_chunks(offsets):
        own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if j > i + 1:
            yield i, own, at
            continue
        for a, b in _cuts(own, at):
            yield i, own[a:b], np.array([0, b - a], np.int64)
        if not len(own):
            yield i, own, at


def word_ranges(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of `inside` bytes within a row, and where each row's words begin."""
    n = len(inside)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)
