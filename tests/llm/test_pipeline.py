"""Every stage of the pipeline, and run(), against plain Python on a small table with
nulls, empty texts, repeated rows, ties, a long text and columns of clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_llm import brute_repeats, jp, words

public_tokenizers = pytest.importorskip("public_tokenizers")
DDL = "doc_id long, text string, lang string, source string, n_chars long, rep int, n_words string"


def fixture(rng):
    base = [words(rng, 60) for _ in range(6)]
    passage = words(rng, 55)
    texts: list = [None, "", " \n\t", "few words only", words(rng, 12) * 1, "again and " * 40]
    texts += [f"{words(rng, 40)}\nSubscribe  to our Letter now please do\n{words(rng, 30)}" for _ in range(16)]
    texts += [base[i % 6] for i in range(12)] + [base[i % 6] + " " + rng.choice(["end", "stop"]) for i in range(6)]
    texts += [f"{words(rng, 30)} {passage} {words(rng, 25)}" for _ in range(8)] + [words(rng, 9_000, 3000)] + [words(rng, rng.randrange(15, 90)) for _ in range(30)]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["s1", "s1", "s2", None]) if i > 40 else "s1", None, 1, "x") for i, t in enumerate(texts)]
    return rows + [rows[45]] * 2


def plain_quality(rows):
    """(row, text) of what stays."""
    norm = lambda line: re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").lower()
    solid = lambda line: bool(re.search(r"[^\x20\x09-\x0D]", line))
    texts, holders = defaultdict(set), defaultdict(set)
    for r in rows:
        texts[r[3]].add(r[1] or "")
        for line in (r[1] or "").split("\n"):
            if solid(line):
                holders[r[3], norm(line)].add(r[1])
    hot = {k for k, t in holders.items() if len(t) > max(10.0, 0.05 * len(texts[k[0]]))}
    out = []
    for r in rows:
        w = (r[1] or "").encode().split()
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {p for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
        left = "\n".join(x for x in (r[1] or "").split("\n") if not (solid(x) and (r[3], norm(x)) in hot))
        if len(w) >= 10 and 100 * len(again) <= 20 * len(w) and len(left.encode().split()) >= 0.5 * len(w):
            out.append((r[0], left))
    return sorted(out)


def plain_near(rows):
    """Of each class of documents at 0.8 or more, linked by others, the smallest id."""
    sets = {}
    for k, t in rows:
        w = t.encode().split()
        sets[k] = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    up = {k: k for k in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a].keys() & sets[b].keys() and jp(sets[a], sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {k for k in sets if find(k) == k}


def test_every_stage_and_run_equal_plain_python(spark, tmp_path):
    import tokenizers

    import corpus_pipeline

    rows = fixture(random.Random(12))
    spark.createDataFrame(rows, DDL).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near", "repeats", "mix", "pack"]

    def step(name, docs):
        at = str(tmp_path / name)
        stages[name](spark, docs, str(tmp_path)).write.parquet(at)
        out = spark.read.parquet(at)
        return out, sorted((r.doc_id, r.text) for r in out.collect()) if name != "pack" else out.collect()

    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    cols = d.columns
    d, good = step("quality", d)
    assert d.columns == cols and good == plain_quality(rows) and 30 < len(good) < len(rows)
    assert not any("Subscribe" in t for _, t in good)
    d, one = step("near", d)
    assert d.columns == cols and [k for k, _ in one] == sorted(plain_near(good)) and len({k for k, _ in good}) > len(one) == len({k for k, _ in one})
    assert set(one) <= set(good)
    d, left = step("repeats", d)
    want = brute_repeats([(k, t, None) for k, t in one])
    assert d.columns == cols and sorted((str(k), hashlib.sha256(b" ".join(t.encode().split())).hexdigest()) for k, t in left) == [(k, h) for k, _, _, h in want] and any(n for _, _, n, _ in want)
    source = {r[0]: r[3] for r in rows}
    d, mixed = step("mix", d)
    taken = Counter(mixed)
    assert d.columns == cols and set(taken) <= set(left) and max(taken.values()) <= 3 and {source[k] for k, _ in mixed} == {source[k] for k, t in left if t.split()}
    encode = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    ids = {k: np.array([*encode.encode(t, add_special_tokens=False).ids, 2], "<u4") for k, t in mixed}
    copies = Counter(k for k, _ in mixed)
    _, pieces = step("pack", d)
    for out in (pieces, corpus_pipeline.run(spark, str(tmp_path)).collect()):
        covered, sequences = defaultdict(Counter), defaultdict(list)
        for r in out:
            assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
            covered[r.doc_id].update(range(r.start, r.start + r.length))
            sequences[r.sequence_id].append((r.offset, r.length))
        assert set(covered) == set(ids) and all(covered[k] == Counter(dict.fromkeys(range(len(ids[k])), copies[k])) for k in ids)
        for q in sequences.values():
            q.sort()
            assert [o for o, _ in q] == np.cumsum([0] + [n for _, n in q])[:-1].tolist() and sum(n for _, n in q) <= 4096


def test_no_documents(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DDL).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
