"""Lyndon arrays, runs and the query on them, against plain loops."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import lyndon
from tidemark.llm.periodic_runs import periodic_runs
from tidemark.llm.registry import queries


def plain_runs(s, exponent, least):
    """Every period by itself; the smallest one of a stretch counts."""
    best: dict = {}
    for p in range(1, len(s) // 2 + 1):
        i = 0
        while i + p < len(s):
            a = i
            while i + p < len(s) and s[i] == s[i + p]:
                i += 1
            if i - a >= p:
                best.setdefault((a, i - a + p), p)
            i += 1
    return sorted(((a, n, p) for (a, n), p in best.items() if n >= max(least, exponent * p)), key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


sequences = st.one_of(
    st.lists(st.integers(0, 2), max_size=40),
    st.lists(st.integers(0, 3), min_size=1, max_size=7).flatmap(lambda u: st.lists(st.integers(0, 3), max_size=6).map(lambda v: u * 5 + v + u * 4)),
)


@settings(max_examples=400, deadline=None)
@given(sequences)
def test_runs_equal_a_plain_search(s):
    for exponent, least in ((2, 2), (3, 1), (4, 6)):
        assert lyndon.runs(s, exponent, least) == plain_runs(s, exponent, least)


@settings(max_examples=300, deadline=None)
@given(sequences)
def test_lyndon_array_and_matches(s):
    seen = []
    smaller = lyndon.lyndon_array(s, lambda i, k, d: seen.append((i, k, d)))
    for i in range(len(s)):
        assert smaller[i] == next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s))
    for i, k, d in seen:
        assert s[i:k] == s[i + d : k + d] and (k + d == len(s) or s[k] != s[k + d])


@settings(max_examples=200, deadline=None)
@given(sequences)
def test_cut_stretches_lose_no_run(s):
    got = []
    for a, b in lyndon.stretches(np.array(s, np.int64), 4):
        got += [(a + x, n, p) for x, n, p in lyndon.runs(s[a:b], 4, 6)]
    assert got == plain_runs(s, 4, 6)


class Counting(int):
    """A symbol that counts how often it is compared."""

    compared = 0

    def _one(self):
        Counting.compared += 1

    def __lt__(self, other):
        self._one()
        return int.__lt__(self, other)

    def __gt__(self, other):
        self._one()
        return int.__gt__(self, other)

    def __eq__(self, other):
        self._one()
        return int.__eq__(self, other)

    def __ne__(self, other):
        self._one()
        return int.__ne__(self, other)

    __hash__ = int.__hash__


@pytest.mark.parametrize(
    "s",
    [
        fibonacci(20_000), [1] * 20_000, list(range(200)) * 100, list(range(200, 0, -1)) * 100, [bin(i).count("1") & 1 for i in range(20_000)],
        [x for m in range(1, 200) for x in [1] * m + [0]], [x for m in range(200, 0, -1) for x in [0] * m + [1]], ([0] * 140 + [1]) * 140, [random.Random(1).randrange(2) for _ in range(20_000)],
    ],
)
def test_comparisons_are_linear(s):
    t = [Counting(x) for x in s]
    Counting.compared = 0
    lyndon.lyndon_array(t)
    assert Counting.compared <= 12 * len(s)


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = plain_runs(w, 4, 6)
    gone = {i for a, n, p in found for i in range(a + p, a + n)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(found), *four, hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_op12_equals_a_plain_search(spark, tmp_path):
    rng = random.Random(7)
    word = lambda k: rng.choice(["a", "b", "Ä", " x", "cd"][:k])
    texts: list = [None, "", " \t\n", "one", "a a a a a a", "a a a a a", "x a b a b a b a b y", "a a a\x0ba\x0ca"]
    texts += [" ".join(word(rng.randrange(1, 6)) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    texts += [" ".join(["lorem", "ipsum", "dolor"] * rng.randrange(3, 9) + [word(5) for _ in range(9)]) for _ in range(30)]
    texts += ["p q r s " * 500 + "end " + "z " * 900]
    rows = list(enumerate(texts)) + [(5, "a a a a a a a"), (5, "a a a a a a a")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in queries()["op12_lyndon_runs"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected(i, t) for i, t in rows), key=str)


def test_columns_nulls_and_empty_tables(spark):
    d = spark.createDataFrame([(None, "u u u u u u v", "x", 1), (3, None, None, 2)], "doc_id long, text string, pr_runs string, pr_row int")
    got = {r.doc_id: r for r in periodic_runs(d, "text", "doc_id").collect()}
    assert got[None].pr_text == "u v" and [tuple(r) for r in got[None].pr_runs] == [(0, 6, 1)] and got[3].pr_text == "" and got[3].pr_runs == []
    none = periodic_runs(d.limit(0))
    assert none.count() == 0 and none.columns == ["doc_id", "text", "pr_runs", "pr_words", "pr_text", "pr_runs_sha256", "pr_sha256"]


def test_long_text(spark):
    """A text of 300,000 words, periodic in its second half."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(40)}" for _ in range(150_000)]
    words += [f"v{i % 1000}" for i in range(150_000)]
    (r,) = periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).collect()
    assert (150_000, 150_000, 1000) in [tuple(x) for x in r.pr_runs] and r.pr_words == 300_000 and len(r.pr_text.split()) <= 151_000
