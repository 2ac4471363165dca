"""Runs of a sequence over an ordered alphabet, from its Lyndon array.

Going from right to left, ``smaller[i]`` is where the next smaller suffix
begins; ``s[i:smaller[i]]`` is the longest Lyndon word at i.  To find it, i is
compared with the candidates i + 1, smaller[i + 1], ... and every ``s[i:j]`` up to
a candidate j is a Lyndon word as well, so it is primitive: wherever the match of
i and j is long enough, it lies in a run whose smallest period is j - i.

Two suffixes are compared symbol by symbol, by order alone.  What has been
matched at a distance is never matched again: a comparison at the same distance
further left ends where the last one began and takes over how far that one came;
and how far i matches a candidate follows from how far i and that candidate match
the one between them, unless both match it equally far.  No suffix tree or array
and no hashes of substrings are used.

A run of at least three periods, less one symbol, holds two whole copies of the
Lyndon rotation of its root next to each other, and these are compared in either
order of the alphabet; a shorter run may show only in one of the two orders, so
both are gone through for it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

Run = tuple[int, int, int]  # start, length, period


def lyndon_array(s: Sequence, found=None) -> list[int]:
    """``smaller[i]``: the start of the next smaller suffix, len(s) if there is none.

    found(i, k, d) is called for every comparison of i and i + d that matches: k is
    the first place at which s[k] and s[k + d] differ or k + d is the end.
    """
    n = len(s)
    smaller = [n] * n
    edge = [0] * n  # over how many symbols i and smaller[i] match
    matched: dict[int, tuple[int, int]] = {}  # distance: where its last match began, where it ended
    for i in range(n - 1, -1, -1):
        c, j, m, exact = s[i], i + 1, 0, False
        while j < n:
            if not exact and (m or c == s[j]):
                d = j - i
                begun, ended = matched.get(d, (n - d, n - d))
                k = i + m
                while k < begun and s[k] == s[k + d]:
                    k += 1
                m = (ended if k >= begun else k) - i
            if m:
                matched[j - i] = (i, i + m)
                if found is not None:
                    found(i, i + m, j - i)
            if j + m == n or s[i + m] > s[j + m]:
                break
            # i is smaller than j.  The next candidate matches j over edge[j] symbols: if that
            # is not m, it matches i over the fewer of the two, and no further.
            exact = edge[j] != m
            m = min(m, edge[j])
            j = smaller[j]
        smaller[i], edge[i] = j, m
    return smaller


def runs(s: Sequence[int], exponent: int = 2, least: int = 2) -> list[Run]:
    """All runs of at least ``least`` symbols and ``exponent`` (2 or more) times
    their smallest period, by start, then period.  Symbols are integers."""
    out: set[Run] = set()
    for sign in (1,) if exponent >= 3 else (1, -1):
        t = s if sign == 1 else [-c for c in s]
        known: dict[int, int] = {}  # period: start of the leftmost run found so far

        def found(i: int, k: int, d: int, t=t, known=known) -> None:
            # The first whole root of a run begins less than a period after it.
            if k - i < (exponent - 2) * d or i >= known.get(d, len(t)):
                return
            start = i
            while start and t[start - 1] == t[start - 1 + d]:
                start -= 1
            if k - start < d:
                return
            known[d] = start
            if k + d - start >= max(least, exponent * d):
                out.add((start, k + d - start, d))

        lyndon_array(t, found)
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(codes: np.ndarray, often: int, rounds: int = 12) -> list[tuple[int, int]]:
    """(start, end) of the stretches that can hold a run in which every symbol
    comes at least ``often`` times.

    A symbol that comes fewer times in a stretch is in no such run, and no such run
    could be longer if it took that symbol in, so the stretch is cut there; the
    pieces are cut again while that helps, ``rounds`` times at most, which bounds
    the work and loses nothing."""
    at = np.arange(len(codes))
    piece = np.zeros(len(codes), np.int64)
    wide = int(codes.max()) + 1 if len(codes) else 1
    for _ in range(rounds):
        if not len(at):
            break
        key = piece * wide + codes[at]
        order = np.argsort(key, kind="stable")
        k = key[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        times = np.empty(len(k), np.int64)
        times[order] = np.repeat(np.diff(np.r_[first, len(k)]), np.diff(np.r_[first, len(k)]))
        left = at[times >= often]
        if len(left) == len(at):
            break
        at = left
        piece = np.cumsum(np.r_[0, np.diff(at) > 1]) if len(at) else piece[:0]
    if not len(at):
        return []
    edge = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.r_[0, edge + 1]].tolist(), (at[np.r_[edge, len(at) - 1]] + 1).tolist(), strict=True))
