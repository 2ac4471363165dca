"""Operators of the llm subpackage against brute force, with nulls, empty and
long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import attention_quality, embedding_dedup, fm_index, kneser_ney, lexical_packing, mixing, probminhash, quality_rules, substring_dedup, textops, token_files, warc
from tidemark.llm.groups import components
from tidemark.llm.tokens import Encoder

SF = Path("/root/testdata/sf0.001")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
needs_data = pytest.mark.skipif(not SF.exists(), reason="no tables")
tokenizers = pytest.importorskip("public_tokenizers")


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOC)


def edge_rows():
    """Nulls, empties, repeats, ties, a long text, one giant word."""
    rng = random.Random(1)
    a, b = words(rng, 120), words(rng, 60)
    return [(1, None, "s"), (2, "", "s"), (3, a, "s"), (3, a, "s"), (4, a, None), (5, a + " tail", "t"), (None, b, "t"), (6, " \n\t ", "t"), (7, "one two", "t"), (8, "one two", "u"), (9, words(rng, 5000), "u"), (10, "x" * 5000, "u"), (11, "é ü 你好 " * 40, "u"), (12, "same " * 60, None)]


def test_word_tables_match_split():
    texts = ["", " a  b\tc\n", "é ü", "x" * 100, "\x1c\xa0 q", "你 好"]
    data, start, end, row, h = textops.word_hashes(pa.array(texts, pa.large_string()))
    assert [(int(r), bytes(data[a:b])) for a, b, r in zip(start, end, row, strict=True)] == [(i, w) for i, t in enumerate(texts) for w in t.encode().split()]
    assert len(set(h.tolist())) == len({w for t in texts for w in t.encode().split()})


# ------------------------------------------------------------------ 1: mixing


def test_water_fill_and_flow():
    t = mixing.water_fill({"a": 100, "b": 100, "c": 10}, {"a": 5, "b": 2, "c": 1}, 210, 3)
    assert t["c"] == pytest.approx(26.25) and sum(t.values()) == pytest.approx(210)
    t = mixing.water_fill({"a": 1, "b": 100}, {"a": 5, "b": 2}, 101, 3)
    assert t == {"a": 3, "b": pytest.approx(98)}
    flow = mixing.route({"p": 10, "q": 10}, {"p": ["a", "b"], "q": ["b"]}, {"a": 8, "b": 8}, 3)
    assert sum(flow.values()) == 16 and max(flow.values()) <= 10  # nothing repeats while fresh words are left
    assert mixing.route({"p": 10}, {"p": ["a"]}, {"a": 25}, 3) == {"p": 25}


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    d = docs(spark, [(i, words(rng, rng.randrange(1, 80)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)] + [(400, None, "a"), (401, "", "c")])
    size = mixing.word_count(F.col("text"))
    out, plan = mixing.mix_sources(d, F.array("source"), size, F.col("doc_id"))
    rows = out.collect()
    assert len(rows) == 402 and set(d.columns) < set(out.columns)
    assert all(0 <= r.mix_taken <= 3 * r.mix_size for r in rows)
    for s, t in plan["targets"].items():
        assert sum(r.mix_taken for r in rows if r.source == s) == round(t)
    again = mixing.mix_sources(d.repartition(7), F.array("source"), size, F.col("doc_id"))[0]
    assert sorted(map(str, again.select("doc_id", "mix_taken").collect())) == sorted(map(str, out.select("doc_id", "mix_taken").collect()))
    whole = mixing.take_mix(d)
    assert whole.columns == d.columns and whole.count() > 0
    assert mixing.take_mix(d.limit(0)).count() == 0


def test_mix_overlapping_sources(spark):
    d = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["b"]) for i in range(100)], "doc_id long, sources array<string>").withColumn("mix_size", F.lit(1))
    out, plan = mixing.mix_sources(d, F.col("sources"), F.lit(10).cast("long"), F.col("doc_id"))
    assert plan["sizes"] == {"a": 500, "b": 1000}
    assert out.agg(F.sum("mix_taken")).first()[0] == sum(plan["taken"].values()) == 1000


# ------------------------------------------------------- 2 and 3: classifiers


def test_gradient_learns_passages():
    rng = np.random.default_rng(0)
    n = np.array([3] * 200)
    owner = np.repeat(np.arange(200), n)
    x = rng.normal(size=(600, 6))
    y = (np.arange(200) % 2).astype(float)
    for i in np.flatnonzero(y):
        x[3 * i + rng.integers(3), 0] += 6
    w = attention_quality.fit(x, owner, y, hidden=8, gate=4, epochs=80)
    p = attention_quality._forward(w, x, owner, 200)["logit"] > 0
    assert (p == (y > 0)).mean() > 0.93


def test_quality_separates_junk(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, 80) if i % 2 else " ".join("X!!" for _ in range(80)), "s") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows + [(None, None, None), (1000, "", "s"), (1, rows[1][1], "s")])
    out = attention_quality.score(d, attention_quality.train(d, labels)).collect()
    assert len(out) == 403 and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.doc_id is not None and 300 <= r.doc_id < 400]
    assert np.mean([(r.score >= 0.5) == bool(r.doc_id % 2) for r in held]) > 0.95
    none = attention_quality.train(d, labels.limit(0))
    assert {r.score for r in attention_quality.score(d, none).collect()} == {0.5}
    assert attention_quality.score(d.limit(0), none).count() == 0


def test_kneser_ney_is_a_distribution():
    data = np.frombuffer(b"abcabd", np.uint8)
    run, _ = kneser_ney.spell(data, np.array([0, 3]), np.array([3, 6]))
    assert [bytes(int(r).to_bytes(6, "big")) for r in run[:4]] == [b"\2\2\2\2\2a", b"\2\2\2\2ab", b"\2\2\2abc", b"\2\2abc\3"]
    keys, n = np.unique(run, return_counts=True)
    ctx, at = np.unique(keys >> 8, return_inverse=True)
    counts = np.stack([n, n])
    lower, now = [], keys
    for k in range(5, 0, -1):
        now, m = np.unique(now & ((1 << 8 * k) - 1), return_counts=True)
        lower.append((now, m))
    sums = np.bincount(at, n)
    model = kneser_ney.Model(keys, counts, ctx, np.stack([sums, sums]), np.stack([np.bincount(at)] * 2), lower)
    for c in (0, int(keys[0] >> 8) & ((1 << 32) - 1)):
        x = (np.int64(c) << 8) | np.arange(256)
        assert model.shared(x).sum() == pytest.approx(1)
    assert np.allclose(model.ratios(keys), 0)


def test_toxic_words_are_found(spark):
    rng = random.Random(5)
    bad = ["badword", "vileness", "grimly"]
    rows = [(i, words(rng, 60) + (" " + rng.choice(bad) + " " + rng.choice(bad) if i % 4 == 0 else "") + " " + words(rng, 30), "s") for i in range(800)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows + [(None, None, None), (5000, "", "s")])
    out = kneser_ney.score(d, labels).collect()
    assert len(out) == 802 and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.doc_id is not None and 600 <= r.doc_id < 800]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in held]) > 0.95
    assert {r.score for r in kneser_ney.score(d, labels.limit(0)).collect()} == {0.0}


def test_rare_runs_are_kept_at_any_number(spark, monkeypatch):
    n = 2_000_001
    runs = spark.range(n).select((F.col("id") * 65_537).alias("run"), F.lit(1).cast("long").alias("n0"), F.lit(0).cast("long").alias("n1"))
    monkeypatch.setattr(kneser_ney, "count_words", lambda rows: None)
    monkeypatch.setattr(kneser_ney, "count_runs", lambda counted: runs)
    model = kneser_ney.train(None)
    assert len(model.runs) == n and model.counts.sum() == n and model.sums.sum() == n
    keys = np.arange(n, dtype=np.int64) * 65_537
    assert len(model.context) == len(np.unique(keys >> 8))
    for k, (key, count, *_) in zip(range(5, 0, -1), model.lower, strict=True):
        keys, want = np.unique(keys & ((1 << 8 * k) - 1), return_counts=True)
        assert np.array_equal(key, keys) and np.array_equal(count, want)


# ------------------------------------------------------------- 4: substrings


def test_fm_index_counts():
    rng = np.random.default_rng(1)
    text = np.concatenate([rng.integers(1, 5, 300), [0]])
    index = fm_index.FMIndex(text, 5, 8)
    s = "".join(map(str, text))
    ends = np.arange(7, 300)
    length, lo, hi = index.matching(text, ends, 8)
    for e, n, a, b in zip(ends, length, lo, hi, strict=True):
        count = lambda m: sum(s.startswith(s[e - m + 1 : e + 1], i) for i in range(len(s)))  # noqa: B023, E731
        assert n == max(m for m in range(9) if m == 0 or count(m) >= 2)
        if n == 8:
            assert sorted(index.places[a:b]) == [i for i in range(len(s)) if s.startswith(s[e - 7 : e + 1], i)]


def brute_repeats(rows):
    first, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    split = [(t or "").encode().split() for _, t, _ in rows]
    for i in order:
        for k in range(len(split[i]) - 19):
            first.setdefault(tuple(split[i][k : k + 20]), (rows[i][0] is None, rows[i][0] or 0, k))
    for i, (key, _, _) in enumerate(rows):
        gone = set()
        for k in range(len(split[i]) - 19):
            if first[tuple(split[i][k : k + 20])] < (key is None, key or 0, k):
                gone |= set(range(k, k + 20))
        kept = b" ".join(w for k, w in enumerate(split[i]) if k not in gone)
        out.append((str(key), len(split[i]), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_cut_ranges_keeps_other_white_space():
    def cut(t, *r):
        data = np.frombuffer(t, np.uint8)
        start, end, _ = textops.words(data, np.array([0, len(t)]))
        return substring_dedup.cut_ranges(data, start, end, np.array(r).reshape(-1, 2))

    assert cut(b" a b\nc\td\n", (1, 2)) == b" a c\td\n"
    assert cut(b" a b\nc\td\n", (0, 1), (2, 4)) == b" b"
    assert cut(b" a b ", (0, 2)) == b"" and cut(b"a", (0, 1)) == b"" and cut(b"a\n\nb c", (0, 1)) == b"b c"


@pytest.mark.parametrize("hot", [5000, 2])
def test_repeats_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rng = random.Random(6)
    shared = [words(rng, 55) for _ in range(4)]
    rows = edge_rows() + [(100 + i, " ".join([words(rng, rng.randrange(30)), rng.choice(shared), words(rng, 10), "re " * rng.randrange(40)]), "s") for i in range(60)]
    d = docs(spark, rows).withColumn("sd_text", F.lit("clash"))
    out = substring_dedup.remove_repeats(d)
    got = sorted((str(r.doc_id), r.sd_words, r.sd_removed, hashlib.sha256(r.sd_text.encode()).hexdigest()) for r in out.collect())
    assert got == brute_repeats(rows)
    kept = substring_dedup.drop_repeats(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns and kept.filter("doc_id = 9").first().text == dict((r[0], r[1]) for r in rows)[9]
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0


# ------------------------------------------------------ 5 and 9: token output


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    from tokenizers import Tokenizer

    path = tokenizers.path(name)
    rng = random.Random(7)
    alphabet = ["a", "B", "é", "é", " ", "  ", "\n", "\t", "\xa0", "'s", "12", "!!", "你", "İ", "Σ", "ß", "<|endoftext|>", "\x00", "\x1c", "’", "word", " "]
    texts = ["", " ", "a"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(400)]
    e, t = Encoder(path, cache=50), Tokenizer.from_file(path)
    for _ in range(2):
        ids, n = e.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def check_pieces(out, rows, encode, window):
    """Every id of every document once, and gapless sequences of powers of two;
    (key, text) rows may repeat."""
    want = Counter()
    for key, text in rows:
        ids = np.array([*encode(text or ""), 2], "<u4")
        want[key, ids.tobytes()] += 1
    by_key: dict = {}
    for r in out:
        by_key.setdefault(r.doc_id, []).append(r)
        x = np.frombuffer(r.ids, "<u4")
        assert r.length == len(x) and r.ids_crc32 == zlib.crc32(r.ids)
    for key, mine in by_key.items():
        texts = [t for (k, t), n in want.items() if k == key for _ in range(n)]
        assert sum(len(r.ids) for r in mine) == sum(map(len, texts))
        assert Counter((r.start, r.doc_tokens) for r in mine if not r.start) == Counter((0, len(t) // 4) for t in texts)
        if len(texts) == 1:
            mine = sorted(mine, key=lambda r: r.start)
            assert b"".join(r.ids for r in mine) == texts[0]
            assert [r.start for r in mine] == np.cumsum([0] + [r.length for r in mine])[:-1].tolist()
        assert all(any(t[4 * r.start : 4 * (r.start + r.length)] == r.ids for t in texts) for r in mine)
    assert set(by_key) == {k for k, _ in want}
    seqs: dict = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for q in seqs.values():
        q.sort()
        assert [o for o, _ in q] == np.cumsum([0] + [n for _, n in q])[:-1].tolist()
    full = [sum(n for _, n in q) for q in seqs.values()]
    assert all(n <= window and n & (n - 1) == 0 for n in full)
    assert sum(n < window for n in full) <= window.bit_length()  # only one window of all is not full


@pytest.mark.parametrize("shard_tokens", [1 << 21, 2048])
def test_packing_covers_every_id(spark, shard_tokens):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(4)
    rows = edge_rows() + [(100 + i, words(rng, rng.randrange(1, 300)), "s") for i in range(60)]
    table = docs(spark, rows).withColumn("ids", F.lit(1)).withColumn("uid", F.lit("clash")).repartition(5)
    out = lexical_packing.pack_documents(table, path, window=256, shard_tokens=shard_tokens, with_ids=True).collect()
    check_pieces(out, [r[:2] for r in rows], lambda x: t.encode(x, add_special_tokens=False).ids, 256)
    assert lexical_packing.pack_documents(docs(spark, []), path).count() == 0


def ragged(arrays):
    return np.concatenate(arrays).astype("<u2"), np.cumsum([0] + [len(x) for x in arrays])


def stats_of(arrays, terms):
    df = np.bincount(np.concatenate([np.unique(x) for x in arrays]), minlength=terms)
    return lexical_packing.Stats(len(arrays), np.mean([len(x) for x in arrays]), df)


def test_packing_prefers_lexical_neighbours():
    rng = np.random.default_rng(2)
    a = [rng.integers(0, 50, 20) for _ in range(8)]
    b = [rng.integers(100, 150, 20) for _ in range(8)]
    mixed = [x for pair in zip(a, b, strict=True) for x in pair]
    seqs, rest = lexical_packing.pack_shard(*ragged(mixed), stats_of(mixed, 150), 64)
    assert len(seqs) == 5 and not rest and {d % 2 for d, _, _ in seqs[0]} == {0}


def test_packing_scores_equal_a_loop():
    """Scores, and the choice of every neighbour, against plain BM25."""
    rng = np.random.default_rng(3)
    arrays = [rng.integers(0, 80, rng.integers(5, 60)) for _ in range(60)]
    stats = stats_of(arrays, 80)
    n, mean = len(arrays), np.mean([len(x) for x in arrays])
    df = Counter(t for x in arrays for t in set(x.tolist()))

    def brute(q, d):
        tf = Counter(d.tolist())
        return sum(np.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * tf[x] * 2.2 / (tf[x] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for x in set(q.tolist()) & set(tf))

    index = lexical_packing.Index(*ragged(arrays), stats)
    for q in arrays[:10]:
        assert index.scores(q) == pytest.approx([brute(q, d) for d in arrays])
    seqs, rest = lexical_packing.pack_shard(*ragged(arrays), stats, 128, share=0.75)
    unused, seed = set(range(n)), None
    for seq in seqs:
        if seed is None:
            seed = (min(unused), 0)
            unused.discard(seed[0])
        d, s, m = seq[0]
        assert (d, s, m) == (*seed, len(arrays[seed[0]]) - seed[1])
        q, room, seed = arrays[d][s:], 128 - m, None
        order = sorted(unused, key=lambda u: (-round(brute(q, arrays[u]), 9), u))
        for got, u in zip(seq[1:], order, strict=False):
            take = min(room, len(arrays[u]))
            assert got == (u, 0, take)
            unused.discard(u)
            room -= take
            if take < len(arrays[u]):
                seed = (u, take)
        assert room == 0
    assert sorted(rest) == sorted([*([seed] if seed else []), *((u, 0) for u in unused)])
    packed = sum(p[2] for q in seqs for p in q)
    assert 0.75 * sum(map(len, arrays)) <= packed < 0.75 * sum(map(len, arrays)) + 128


def test_equal_texts_draw_the_same_terms():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 5000, 300)
    near = base.copy()
    near[rng.integers(0, 300, 15)] = rng.integers(0, 5000, 15)
    arrays = [base, base, near, *(rng.integers(0, 5000, 300) for _ in range(200))]
    stats, same, alike = stats_of(arrays, 5000), 0, 0
    for turn in range(100):
        key = lexical_packing.draw(*ragged(arrays), np.zeros(len(arrays), np.int64), stats.ranks(turn))
        assert key[0] == key[1]
        same += key[0] >> 48 == key[2] >> 48
        alike += key[0] >> 48 == key[3] >> 48
    a, b = set(base.tolist()), set(near.tolist())
    jaccard = sum(stats.idf[list(a & b)]) / sum(stats.idf[list(a | b)])
    assert abs(same / 100 - jaccard) < 0.12 and alike < 20


def test_packing_searches_all_documents(spark):
    """Each topic's documents arrive in different partitions, far apart."""
    path = tokenizers.path("word_bpe_49k.json")
    rng = random.Random(11)
    topics = [[f"{a}{b}" for b in ("ba", "de", "ki", "lo", "mu", "po", "ra", "su", "ti", "zo")] for a in ("al", "ber", "cor", "dun", "fer", "gol", "hin", "jor")]
    rows = [(i, " ".join(rng.choice(topics[i % 8]) for _ in range(20)), "s") for i in range(320)]
    out = lexical_packing.pack_documents(docs(spark, rows).repartition(16, "doc_id"), path, window=256, shard_tokens=2048).collect()
    assert sum(r.length for r in out) == sum({r.doc_id: r.doc_tokens for r in out}.values())
    seqs: dict = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append(r.doc_id % 8)
    same = sum(Counter(s).most_common(1)[0][1] for s in seqs.values())
    assert same / len(out) > 0.6


def test_packing_statistics_are_of_all_documents(spark, monkeypatch):
    path = tokenizers.path("word_bpe_49k.json")
    rng = random.Random(12)
    rows = [(i, words(rng, rng.randrange(5, 40), 60), "s") for i in range(90)]
    seen, plain = [], lexical_packing.statistics
    monkeypatch.setattr(lexical_packing, "statistics", lambda *a: seen.append(plain(*a)) or seen[-1])
    out = lexical_packing.pack_documents(docs(spark, rows).repartition(7), path, window=256, with_ids=True).collect()
    ids: dict = {}
    for r in sorted(out, key=lambda r: r.start):
        ids.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    df = Counter(x for v in ids.values() for x in set(v))
    assert seen[0].n == 90 and seen[0].mean == pytest.approx(np.mean([len(v) for v in ids.values()]))
    assert all(seen[0].idf[x] == pytest.approx(np.log1p((90 - n + 0.5) / (n + 0.5))) for x, n in df.items())


def test_perfect_hash():
    keys = textops.mix(np.arange(5000, dtype=np.uint64))
    h = token_files.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(5000))
    assert token_files.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1] * 3


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = edge_rows()
    table = docs(spark, rows).withColumn("key", F.lit("clash"))
    want = [(k, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for k, x, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    for most in ((1 << 20, 1 << 20), (2000, 3)):
        manifest = token_files.write_shards(table, str(tmp_path / f"ids{most[0]}"), path, shards=3, shard_bytes=most[0], shard_docs=most[1])
        assert len(manifest) <= 3 if most[1] > 3 else len(manifest) > 3
        got = token_files.read_keys(table.select("doc_id"), manifest, with_ids=True).orderBy("start").collect()
        assert [(r.doc_id, r.ids) for r in got] == want
        assert [r.start for r in got] == np.cumsum([0] + [len(w) for _, w in want])[:-1].tolist()
        assert all(r.ids_crc32 == zlib.crc32(np.array(w, "<u4")) for r, (_, w) in zip(got, want, strict=True))
        part = spark.createDataFrame([(3,), (rows[0][0],), (10_001,)], "k long")
        assert sorted(r.doc_id for r in token_files.read_keys(part, manifest).collect()) == sorted(k for k, _ in want if k in (3, rows[0][0]))
        shards = [token_files.Shard(r["path"]) for r in manifest]
        assert sum(len(s.get(3)) for s in shards) == 2 and sum(len(s.get(None)) for s in shards) == 1
        assert not any(s.get(k) for s in shards for k in range(10_000, 10_200))
    assert token_files.write_shards(docs(spark, []), str(tmp_path / "none"), path) == []
    assert token_files.read_keys(table.select("doc_id"), []).count() == 0


def test_token_query_equals_the_library(spark):
    from tokenizers import Tokenizer

    t, before = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json")), 0
    got = {r.doc_id: r for r in token_files.op9_token_files(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    assert len(got) == len(rows)
    for d in rows:
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[d.doc_id][1:] == (before, len(ids), zlib.crc32(ids.tobytes()))
        before += len(ids)


# ------------------------------------------------------------------ 6: rules


def test_rules_edges(spark):
    rng = random.Random(8)
    line = "this line is on every page of the host"
    own = [words(rng, 30) for _ in range(40)]
    rows = [(i, own[i] + "\n" + line.upper(), "h") for i in range(40)] + [(100 + i, line, "h") for i in range(3)] + edge_rows()
    out = {r.doc_id: r for r in quality_rules.quality_rules(docs(spark, rows).withColumn("qr_kept", F.lit(5))).collect()}
    assert out[0].qr_kept and out[0].qr_text == own[0] and out[0].qr_left == 30
    assert not out[100].qr_kept and not out[1].qr_kept and out[1].qr_n_words == 0 and out[12].qr_base_failed
    good = quality_rules.keep_good(docs(spark, rows))
    assert good.columns == docs(spark, []).columns and {r.doc_id for r in good.collect()} >= set(range(40))
    assert quality_rules.quality_rules(docs(spark, [])).count() == 0


@pytest.mark.parametrize("few", [32, 1])
def test_repeated_words_match_a_loop(spark, monkeypatch, few):
    monkeypatch.setattr(quality_rules, "FEW", few)
    rng = random.Random(15)
    texts = [words(rng, rng.randrange(60), rng.choice([2, 5, 400])) for _ in range(150)] + [words(rng, 30) + " " + t for t in ["a b c d e f " * 3, "x " * 40, ""]] + ["p q r s t u p q r s t", None]

    def loop(t):
        w = (t or "").split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(grams)
        return len({i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(5)})

    out = quality_rules.base_rules(docs(spark, [(i, t, "h") for i, t in enumerate(texts)])).collect()
    assert {r.doc_id: r.qr_n_repeat_words for r in out} == {i: loop(t) for i, t in enumerate(texts)}


def test_copies_count_once(spark):
    text = "\n".join(words(random.Random(i), 20) for i in range(3))
    out = quality_rules.quality_rules(docs(spark, [(i, text, "h") for i in range(50)])).collect()
    assert all(r.qr_kept and r.qr_left == 60 for r in out)


# ----------------------------------------------------- 7: embeddings, groups


def test_join_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 12))
    x = np.concatenate([base, base[:20] + 0.12 * rng.normal(size=(20, 12)), np.repeat(base[:1] + 0.05 * rng.normal(size=(1, 12)), 40, 0), base[0] + 0.1 * rng.normal(size=(120, 12))])
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(900, None, 1), (901, [0.0] * 12, 1), (902, [float("nan")] + [1.0] * 11, 1), (903, [1.0, None], 1), (904, [1.0, 2.0], 1), (905, [2.0, 4.0], 1), (None, rows_of(x[0]), 1), (906, [], 1), (907, [1e-300] * 12, 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    for chunk in (2048, 16):
        got = {r.vec_id: r for r in embedding_dedup.similarity_join(d, chunk=chunk).collect()}
        u = x / np.linalg.norm(x, axis=1)[:, None]
        link = u @ u.T >= 0.9
        np.fill_diagonal(link, False)
        comp = np.arange(len(x))
        for _ in range(len(x)):
            comp = np.minimum(comp, np.where(link, comp[None], len(x)).min(1))
        assert [got[i].n_links for i in range(len(x))] == link.sum(1).tolist()
        assert [got[i].component_id for i in range(len(x))] == comp.tolist()
        assert got[904].n_links == got[905].n_links == 1 and got[905].component_id == 904 and not got[905].kept
        assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 906)) and got[None].component_id is None
    assert embedding_dedup.similarity_join(d.limit(0)).count() == 0


def test_rows_that_repeat_a_key_have_their_own_links(spark):
    x, y, z = ([1.0 if i == k else 0.0 for i in range(8)] for k in range(3))
    near = [1.0, 0.1] + [0.0] * 6
    rows = [(1, x), (1, y), (2, near), (3, [0.0, 1.0, 0.1] + [0.0] * 5), (4, z), (4, z), (5, x)]
    got = sorted(tuple(r) for r in embedding_dedup.similarity_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 1, 4, True), (4, 1, 4, True), (5, 2, 1, False)]


def test_more_chunks_are_no_more_shuffle(spark):
    rng = np.random.default_rng(6)
    d = spark.createDataFrame([(i, rows_of(x)) for i, x in enumerate(rng.normal(size=(1500, 32)))], "vec_id long, embedding array<float>").checkpoint()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    assert embedding_dedup.similarity_join(d, chunk=25).filter("kept and n_links = 0").count() == 1500
    assert written() - before < 4 * 1500 * 32 * 4


def rows_of(v):
    return [float(a) for a in v]


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 105), (105, 103), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 103: 100, 105: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------ 8: near copies


def test_registers_estimate_similarity():
    rng = np.random.default_rng(4)
    s = textops.mix(np.arange(1, 1001, dtype=np.uint64))
    w = rng.integers(1, 4, 1000).astype(float)
    both = np.concatenate([s[:900], s[100:]])
    weight = np.concatenate([w[:900], w[100:]])
    z = probminhash.registers(both, weight, np.repeat([0, 1], 900), 2, 4096)
    exact = probminhash.probability_jaccard(w[100:900], w[100:900], w[:900].sum(), w[100:].sum())
    assert abs((z[0] == z[1]).mean() - exact) < 0.03 and (z > 0).all()


def jp(x, y):
    keys = x.keys() | y.keys()
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in keys) for i in x.keys() & y.keys())


@pytest.mark.parametrize("block", [1000, 3])
def test_near_copies_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(probminhash, "BLOCK_TEXTS", block)
    rng = random.Random(9)
    rows = [r for r in edge_rows() if r[0] != 9]
    for g in range(12):
        base = words(rng, 150).split()
        for v in range(8):
            t = list(base)
            for _ in range(v if g % 2 else 0):
                t[rng.randrange(len(t))] = f"q{rng.randrange(10**6)}"
            rows.append((1000 + 10 * g + v, " ".join(t), "s"))
    sets = {}
    for k, t, _ in rows:
        w = (t or "").split()
        if k is not None:
            sets[k] = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    up = {k: k for k in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a].keys() & sets[b].keys() and jp(sets[a], sets[b]) >= 0.8 - 1e-12:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    got = probminhash.near_duplicates(docs(spark, rows).withColumn("rep", F.lit("clash"))).collect()
    assert {r.doc_id: r.class_id for r in got} == {k: find(k) for k in sets} | {None: None}
    one = probminhash.keep_one(docs(spark, rows))
    assert one.columns == docs(spark, []).columns
    assert sorted(str(r.doc_id) for r in one.collect()) == sorted(str(k) for k in [*{find(k) for k in sets}, None])
    assert probminhash.near_duplicates(docs(spark, [])).count() == 0


# ------------------------------------------------------------------ 10: WARC


def test_archive_round_trip(spark, tmp_path):
    import base64

    rows = [(1, "https://a/1", "<p>é</p>"), (2, "https://a/2\r\nX: y", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "u", "z" * 100_000), (5, "u", "z" * 100_000), (None, "u", "<p>é</p>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    warc.write_archive(d, str(tmp_path / "a"))
    a = warc.read_archive(spark, str(tmp_path / "a"))
    got = {r.key: r for r in a.collect()}
    assert a.count() == len(rows) and all(r.verified for r in got.values())
    assert (got[1].record_type, got[1].refers_to, got[2].record_type) == ("revisit", 2, "response")
    assert (got[3].record_type, got[3].refers_to, got[4].record_type, got[5].record_type) == ("revisit", 4, "response", "response")
    assert got[None].record_type == "revisit" and got[None].refers_to == 2
    for k, r in got.items():
        body = next((h or "") for i, _, h in rows if i == k).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
    records = {r.key: bytes(r.record) for r in warc.rebuild(a).collect()}
    head, block = records[2].split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response") and block == "<p>é</p>".encode() + b"\r\n\r\n" and b"%0A" in head
    assert spark.read.parquet(str(tmp_path / "a" / "payloads")).count() == 3
    for r in warc.parse_records(warc.rebuild(a)).collect():
        body = next((h or "") for i, _, h in rows if i == r.key).encode() if r.record_type == "response" else b""
        assert (bytes(r.r_block), r.r_type, r.r_refers_to, r.r_digest, r.r_exact) == (body, r.record_type, r.refers_to, r.payload_digest, True)
    warc.write_archive(d, str(tmp_path / "b"), min_bytes=10)
    assert {r.key: r.record_type for r in warc.read_archive(spark, str(tmp_path / "b")).collect()}[1] == "response"
    warc.write_archive(d.limit(0), str(tmp_path / "c"))
    assert warc.read_archive(spark, str(tmp_path / "c")).count() == 0


# ---------------------------------------------------------- queries, pipeline


@needs_data
@pytest.mark.parametrize("name", ["op4_substring_dedup", "op6_line_frequency", "op7_embedding_pigeonhole", "op10_warc_archive", "op11_source_divergence", "op13_sampled_shards"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from tidemark.llm import registry

    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    d = registry.queries()[name](spark, str(SF))
    r = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    key = lambda c, rows: sorted(str([x[c.index(k)] for k in sorted(c)]) for x in rows)
    assert sorted(cols) == sorted(d.columns)
    assert key(d.columns, [tuple(x) for x in d.collect()]) == key(cols, r.fetchall())


@needs_data
def test_pipeline_stages(spark):
    import corpus_pipeline

    d = spark.read.parquet(str(SF / "documents.parquet"))
    cols, n = d.columns, d.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(SF)).persist()
        assert d.columns == cols and d.count() > 0, name
        if name != "mix":
            assert d.count() <= n
            n = d.count()
    out = corpus_pipeline.STAGES[-1][1](spark, d, str(SF))
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in d.select("doc_id").distinct().collect()}
