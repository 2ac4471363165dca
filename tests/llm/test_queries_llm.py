"""The opN queries and their models against plain loops, on the smallest tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from tidemark.llm import attention_quality, kneser_ney, lexical_packing, mixing, probminhash
from tidemark.llm.registry import queries

SF = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not SF.exists(), reason="no tables")
tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, name):
    return spark.read.parquet(str(SF / f"{name}.parquet")).collect()


# --------------------------------------------------------------------- op1


def fill(sizes, weights, cap=3.0):
    """Targets by handing out the rest again and again, a plain loop."""
    out, left, open_ = dict.fromkeys(sizes, 0.0), float(sum(sizes.values())), set(sizes)
    while open_ and left > 1e-9:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        left = 0.0
        for s in sorted(share, key=str):
            more = min(share[s], cap * sizes[s] - out[s])
            out[s] += more
            left += share[s] - more
        open_ = {s for s in open_ if out[s] < cap * sizes[s] - 1e-9}
    return out


@needs_data
def test_op1_meets_its_contract(spark):
    docs = {r.doc_id: r for r in table(spark, "documents")}
    got = queries()["op1_source_mix"](spark, str(SF)).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    size = {i: len(WORD.findall(d.text or "")) for i, d in docs.items()}
    sizes: Counter = Counter()
    for i, d in docs.items():
        sizes[d.source] += size[i]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken: Counter = Counter()
    for r in got:
        s = docs[r.doc_id].source
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[s]) and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = queries()["op1_source_mix"](spark, str(SF)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def cheapest(patterns, members, quota, repeats):
    """Least cost of filling as much quota as can be, word by word (Bellman-Ford on unit flows)."""
    use = dict.fromkeys(patterns, 0)
    room = dict(quota)
    flow: dict = defaultdict(int)
    while True:
        # States: a pattern takes one more word; a word already sent may move to another quota.
        best = {("p", p): (use[p] // patterns[p] + 1, None) for p in patterns if patterns[p] and use[p] < repeats * patterns[p]}
        for _ in range(2 * len(patterns) + 2 * len(quota)):
            for p in patterns:
                if ("p", p) in best:
                    for s in members[p]:
                        if best[("p", p)][0] < best.get(("q", s), (math.inf,))[0]:
                            best[("q", s)] = (best[("p", p)][0], ("p", p))
            for (p, s), n in flow.items():
                if n and ("q", s) in best and best[("q", s)][0] < best.get(("p", p), (math.inf,))[0]:
                    best[("p", p)] = (best[("q", s)][0], ("q", s))
        ends = [(best[("q", s)][0], str(s), s) for s in quota if room[s] and ("q", s) in best]
        if not ends:
            return use
        s = min(ends)[2]
        room[s] -= 1
        at = ("q", s)
        while True:
            p = best[at][1]
            flow[p[1], at[1]] += 1
            if best[p][1] is None:
                use[p[1]] += 1
                break
            at = best[p][1]
            flow[p[1], at[1]] -= 1


def test_flow_costs_what_a_plain_one_costs():
    rng = np.random.default_rng(8)
    for _ in range(25):
        names = list("abc")[: rng.integers(1, 4)]
        patterns = {f"p{i}": int(rng.integers(1, 6)) for i in range(rng.integers(1, 5))}
        members = {p: sorted(rng.choice(names, rng.integers(1, len(names) + 1), replace=False).tolist()) for p in patterns}
        quota = {s: int(rng.integers(0, 9)) for s in names}

        def cost(use, patterns=patterns):
            return sum(r // patterns[p] + 1 for p in use for r in range(use[p]))

        a, b = mixing.route(patterns, members, quota, 3), cheapest(patterns, members, quota, 3)
        assert sum(a.values()) == sum(b.values()) and cost(a) == cost(b)


def test_very_many_patterns_are_routed():
    n, names = 60_000, [f"s{i:02d}" for i in range(20)]
    rng = np.random.default_rng(2)
    patterns = {f"p{i}": int(x) for i, x in enumerate(rng.integers(1, 100, n))}
    members = {p: sorted({names[a], names[b]}) for p, a, b in zip(patterns, rng.integers(0, 20, n), rng.integers(0, 20, n), strict=True)}
    total = sum(patterns.values())
    quota = {s: total // 20 + (i - 10) * 1000 for i, s in enumerate(names)}
    use = mixing.route(patterns, members, quota, 3)
    assert sum(use.values()) == sum(quota.values()) and all(use[p] <= patterns[p] for p in use)


# --------------------------------------------------------------- op2 and op3


@needs_data
@pytest.mark.parametrize(("name", "folds", "rest", "limit"), [("op2_attention_quality", 4, 2, 0.7), ("op3_kneser_ney_toxicity", 5, 0, 0.5)])
def test_classifier_queries(spark, name, folds, rest, limit):
    got = queries()[name](spark, str(SF)).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in table(spark, "documents"))
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= limit)


def test_attention_equals_a_loop():
    rng = np.random.default_rng(1)
    x, owner = rng.normal(size=(9, 5)), np.array([0, 0, 0, 1, 2, 2, 2, 2, 3])
    w = {k: rng.normal(size=s) for k, s in {"mean": 5, "W": (5, 4), "b": 4, "V": (4, 3), "U": (4, 3), "a": 3, "c": 4}.items()} | {"std": np.full(5, 2.0), "d": np.array(0.3)}
    got = attention_quality._forward(w, x, owner, 4)
    for bag in range(4):
        hid, gates = [], []
        for i in np.flatnonzero(owner == bag):
            h = [math.tanh(sum((x[i][f] - w["mean"][f]) / 2 * w["W"][f][j] for f in range(5)) + w["b"][j]) for j in range(4)]
            e = sum(w["a"][g] * math.tanh(sum(h[j] * w["V"][j][g] for j in range(4))) / (1 + math.exp(-sum(h[j] * w["U"][j][g] for j in range(4)))) for g in range(3))
            hid.append(h)
            gates.append(math.exp(e))
        share = [g / sum(gates) for g in gates]
        assert got["att"][owner == bag] == pytest.approx(share)
        assert got["logit"][bag] == pytest.approx(sum(w["c"][j] * sum(s * h[j] for s, h in zip(share, hid, strict=True)) for j in range(4)) + 0.3)


def test_kneser_ney_equals_a_loop(spark):
    """Counts of all runs, continuations and ratios, against dictionaries."""
    texts = [("bad words here", 1), ("Bad, words! there", 1), ("good words here", 0), ("so good a day", 0), ("the worst", 1), ("", 0), (None, 0)]
    model = kneser_ney.train(spark.createDataFrame(texts, "text string, label int"))

    def spelled(t):
        fold = "".join(c.lower() if c.isalnum() or c == "'" else " " if ord(c) < 128 else c for c in t or "")
        for word in fold.split():
            b = b"\2" * 5 + word.encode() + b"\3"
            yield from (b[i : i + 6] for i in range(len(b) - 5))

    counts = (Counter(), Counter())
    for t, y in texts:
        counts[y].update(spelled(t))
    every = set(counts[0]) | set(counts[1])
    assert [int(r).to_bytes(6, "big") for r in model.runs] == sorted(every)
    level, follow = every, {}
    for k in range(5, 0, -1):
        follow[k] = Counter(r[1:] for r in level)
        level = set(follow[k])

    def shared(run):
        p = 1 / 256
        for k in range(1, 6):
            part = run[-k:]
            same = {r: n for r, n in follow[k].items() if r[:-1] == part[:-1]}
            if same:
                p = (max(follow[k].get(part, 0) - 0.75, 0) + 0.75 * len(same) * p) / sum(same.values())
        return p

    def ratio(run):
        back, out = shared(run[1:]), []
        for c in (0, 1):
            same = {r: n for r, n in counts[c].items() if r[:5] == run[:5]}
            out.append((max(counts[c].get(run, 0) - 0.75, 0) + 0.75 * len(same) * back) / sum(same.values()) if same else back)
        return math.log(out[1]) - math.log(out[0])

    asked = sorted(every | {r for t in ("bad day", "unseen worse", "zzz") for r in spelled(t)})
    got = model.ratios(np.array([int.from_bytes(r, "big") for r in asked], np.int64))
    assert got == pytest.approx([ratio(r) for r in asked])


# --------------------------------------------------------------- op5 and op8


@needs_data
def test_op5_packs_every_id(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    got = lexical_packing.op5_lexical_packing(spark, str(SF)).collect()
    by, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    docs = table(spark, "documents")
    assert len(by) == len(docs)
    for d in docs:
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by[d.doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    short = 0
    for rows in seqs.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0
        short += at < 4096
    assert short <= 12


@needs_data
def test_op8_equals_brute_force(spark):
    shingles, up = {}, {}
    for d in table(spark, "documents"):
        w = WORD.findall(d.text or "")
        shingles[d.doc_id] = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        up[d.doc_id] = d.doc_id

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    def similarity(x, y):
        common = x.keys() & y.keys()
        xs, ys = sum(x.values()), sum(y.values())
        out = 0.0
        order = sorted(common, key=lambda s: y[s] / x[s])
        for i in order:
            # Shingles of only one text count at its own rate; common ones at the larger of both.
            out += 1 / ((sum(max(x[j] / x[i], y[j] / y[i]) for j in common)) + (xs - sum(x[j] for j in common)) / x[i] + (ys - sum(y[j] for j in common)) / y[i])
        return out

    ids = sorted(shingles)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = shingles[a].keys() & shingles[b].keys()
            if common and find(a) != find(b) and 2 * len(common) > 0.5 * min(len(shingles[a]), len(shingles[b])):
                if shingles[a] == shingles[b] or similarity(shingles[a], shingles[b]) >= 0.8 - 1e-12:
                    x, y = sorted((find(a), find(b)))
                    up[y] = x
    got = {r.doc_id: r.class_id for r in probminhash.op8_probminhash_dedup(spark, str(SF)).collect()}
    assert got == {i: find(i) for i in ids}
