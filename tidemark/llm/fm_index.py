"""FM-index over a wavelet matrix, searched for many patterns at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BELOW = (_U(1) << np.arange(64, dtype=_U)) - _U(1)


class WaveletMatrix:
    """Rank of symbols in a sequence: bit planes with counts every 64 places."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.count, self.zeros = [], [], []
        pad = len(seq) // 64 + 1
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level & 1).astype(np.uint8)
            plane = np.zeros(pad * 8, np.uint8)
            packed = np.packbits(bit, bitorder="little")
            plane[: len(packed)] = packed
            plane = plane.view("<u8")
            ones = np.cumsum(np.bitwise_count(plane), dtype=np.int64)
            self.bits.append(plane)
            self.count.append(np.concatenate([[0], ones[:-1]]))
            one = bit.astype(bool)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[~one], seq[one]])
        self.start = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = i >> 6
            ones = self.count[k][word] + np.bitwise_count(self.bits[k][word] & _BELOW[i & 63])
            i = np.where(symbol >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place i."""
        return self._down(symbol, i) - self.start[symbol]


def sort_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols or more (by
    doubling), ties by place."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < depth:
        after = np.zeros(n, np.int64)
        after[:-width] = rank[width:] + 1 if width < n else 0
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        width *= 2
    return np.argsort(rank, kind="stable")


class FMIndex:
    """Self-index of a text of symbols 0..sigma-1 for patterns of up to
    ``depth`` symbols.  Symbol 0 separates; patterns do not hold it."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        self.depth = depth
        self.places = sort_suffixes(text, depth)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.bwt = WaveletMatrix(text[self.places - 1], sigma)  # the last symbol stands before the first

    def matching(self, text: np.ndarray, end: np.ndarray, most: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of streamed text: for each end (place of the last
        symbol), how many symbols up to it, ``most`` at most, occur at least
        ``least`` times in the index; and their interval [lo, hi) where all
        ``most`` do."""
        c = text[end]
        lo, hi = self.first[c].copy(), self.first[c + 1].copy()
        length = np.zeros(len(end), np.int64)
        live = np.flatnonzero(hi - lo >= least)
        length[live] = 1
        for step in range(1, most):
            if not len(live):
                break
            c = text[end[live] - step]
            both = self.bwt.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live], hi[live] = self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]
            live = live[hi[live] - lo[live] >= least]
            length[live] = step + 1
        return length, lo, hi
