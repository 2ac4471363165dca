"""Vectorised words, word hashes and shingles over Arrow string arrays.

All work is on the UTF-8 bytes: the word separators are ASCII, so byte
positions and code points agree on where words begin and end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_U = np.uint64
_M1, _M2, _STEP = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _M1
    x ^= x >> _U(27)
    x *= _M2
    x ^= x >> _U(31)
    return x


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array without nulls; offsets from 0."""
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]] if col.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, off - off[0]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word."""
    solid = ~_SPACE[data]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    before[edge] = False
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    after[edge - 1] = False
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    n = end - start
    h = mix(n.astype(_U) + _STEP)
    live = np.arange(len(start))
    at = 0
    while len(live):
        left = n[live] - at
        x = view[start[live] + at]
        part = left < 8
        if part.any():
            keep = (_U(1) << (_U(8) * left[part].astype(_U))) - _U(1)
            x[part] &= keep
        h[live] = mix((h[live] ^ x) * _STEP + _U(at + 1))
        at += 8
        live = live[left > 8]
    return h


def shingles(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of first word) of every run of n words within one row."""
    if len(h) < n:
        return np.empty(0, _U), np.empty(0, np.int64)
    first = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
    acc = np.zeros(len(first), _U)
    for j in range(n):
        acc = acc * _STEP + h[first + j]
        acc ^= acc >> _U(29)
    return mix(acc), first


def word_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, row, hash) of all words of a text column."""
    data, off = raw(col)
    start, end, row = words(data, off)
    return data, start, end, row, hash_spans(data, start, end)
