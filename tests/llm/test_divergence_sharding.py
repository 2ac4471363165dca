"""The divergence audit and the sharding, against their SQL and plain loops, on
rows with nulls, empty texts, ties, repeats and hot groups."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tidemark.llm import divergence, sharding
from tidemark.llm.registry import oracle_sql, queries


def both(spark, tmp_path, name, rows, ddl):
    """Rows of a query and of its SQL over the same table."""
    at = tmp_path / "documents.parquet"
    spark.createDataFrame(rows, ddl).repartition(3).write.parquet(str(at))
    d = queries()[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/*.parquet'")
    r = c.execute(oracle_sql()[name])
    cols = [x[0] for x in r.description]
    want = [dict(zip(cols, x, strict=True)) for x in r.fetchall()]
    assert sorted(d.columns) == sorted(cols)
    order = lambda rs: sorted((tuple(r[c] for c in d.columns) for r in rs), key=repr)
    return order(r.asDict() for r in d.collect()), order(want)


# -------------------------------------------------------------------- op11

DDL = "doc_id long, text string, lang string, source string"


def texts(rng, n):
    pool = ["a", "B", "ä", "Ä", "x-y", "é1f", "word", "WORD", "日本", " ", "q r", "_", "Z9z"]
    return [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S1", None, "", "hot", "hot", "hot"])) for i in range(n)]


@pytest.mark.parametrize("rows", [None, [], [(1, None, None, None)], [(1, "a a", "en", "s"), (2, "b", "en", "t"), (2, "b", "en", "t")]])
def test_op11_equals_its_sql(spark, tmp_path, rows):
    if rows is None:
        rows = texts(random.Random(5), 120) + [(3, "a", "en", "s1")] * 5 + [(500, None, "en", "s2"), (501, "only here", "it", "s9"), (502, "", "xx", "none"), (503, "word " * 40_000, "en", "s1")]
    got, want = both(spark, tmp_path, "op11_source_divergence", rows, DDL)
    assert got == want


def test_op11_equals_a_loop(spark):
    """Pairs summed over all kept terms, one at a time."""
    rows = [(i, t, lang or "", s or "") for i, t, lang, s in texts(random.Random(9), 80)]
    counts, docs, groups = defaultdict(int), defaultdict(int), set()
    fold = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    for _, t, lang, s in rows:
        groups.add((lang, s))
        for w in fold(t):
            counts[lang, s, w] += 1
        for w in set(fold(t)):
            docs[lang, w] += 1
    kept = {lang: [w for (x, w), n in docs.items() if x == lang and n >= 3] for lang, _ in groups}
    size = {(lang, s): sum(counts[lang, s, w] for w in kept[lang]) for lang, s in groups}
    p = lambda lang, s, w: 1 + 10**9 * (counts[lang, s, w] + 1) // (size[lang, s] + len(kept[lang]))
    want = {}
    for lang, a in groups:
        for lang2, b in groups:
            if lang == lang2 and a != b:
                want[lang, a, b] = sum((p(lang, a, w) - p(lang, b, w)) ** 2 // p(lang, b, w) for w in kept[lang])
    got = divergence.divergence(spark.createDataFrame(rows, DDL)).filter("part = 'pair'").collect()
    assert {(r.lang, r.source, r.item): r.value for r in got} == want and len(got) == len(want)


def test_small_gathers_and_blocks_change_nothing(spark, monkeypatch):
    d = spark.createDataFrame(texts(random.Random(6), 90), DDL)
    rows = lambda: sorted(map(tuple, divergence.divergence(d).collect()))
    want = rows()
    monkeypatch.setattr(divergence, "GATHER", 3)
    monkeypatch.setattr(divergence, "_PIECE", 7)
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 2)
    assert rows() == want


def test_shares_are_exact_for_large_counts(spark):
    rng = random.Random(2)
    pairs = [(n, n + rng.randrange(1, 10**6)) for n in (rng.randrange(10**k) for k in range(1, 15))]
    from pyspark.sql import functions as F

    got = spark.createDataFrame(pairs, "n long, total long").select("n", "total", divergence.share(F.col("n"), F.col("total")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.n + 1) // r.total for r in got)


# -------------------------------------------------------------------- op13


def documents(rng, n):
    t = [" ".join(rng.choice(["ab", "cde", "ü", "日"]) for _ in range(rng.choice([1, 3, 30, 400]))) for _ in range(n // 3)]
    return [(i, t[i] if i < len(t) else rng.choice([*t, "same", "same", "same", "", None])) for i in range(n)]


@pytest.mark.parametrize("rows", [None, [], [(1, None)], [(7, "a")] * 20, [(None, "x"), (None, ""), (2, None), (2, "")], [(i, "one copy of a text") for i in range(50)]])
def test_op13_equals_its_sql(spark, tmp_path, rows):
    if rows is None:
        rows = documents(random.Random(4), 600)
        rows += [(5, "same")] * 30 + [(None, "same")] * 4 + [(9_000, "long " * 60_000)]
    got, want = both(spark, tmp_path, "op13_sampled_shards", rows, "doc_id long, text string")
    assert got == want
    shards = defaultdict(list)
    for r in got:
        shards[r[4]].append(r)
    for k in shards.values():
        assert sorted(r[5] for r in k) == list(range(len(k)))
    key = lambda i, c: (-1 if i is None else i, c)
    assert sorted(key(r[0], r[2]) for r in got) == sorted(key(i, zlib.crc32((t or "").encode())) for i, t in rows)


def test_shards_are_near_equal_and_keep_small_groups(spark):
    rng = random.Random(8)
    hot = "the same passage again and again"
    rows = [(i, hot if i % 3 == 0 else f"{i // 4} " + "w" * rng.randrange(1, 300)) for i in range(9000)]
    rows = [(i, rows[i - i % 5][1] if i % 3 else t) for i, t in rows]
    d = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).toPandas()
    size = d.text.str.len() + 1
    per = size.groupby(d.sh_shard).sum()
    assert len(per) == 8 and abs(per - per.mean()).max() <= per.mean() / sharding.GROUP_PART + size.max()
    spread = d.groupby("text").sh_shard.nunique()
    assert spread[hot] > 1 and (spread.drop(hot) == 1).all()


def test_reruns_agree_whatever_the_partitions(spark):
    d = spark.createDataFrame(documents(random.Random(1), 400), "doc_id long, text string")
    one = lambda x: sorted((r.doc_id, r.sh_shard, r.sh_slot) for r in x.collect())
    assert one(sharding.assign_shards(d.repartition(7), ranges=64)) == one(sharding.assign_shards(d.coalesce(1), ranges=9))


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    """With one sampled key a range at first, ranges come out uneven and are split again."""
    monkeypatch.setattr(sharding, "OVERSAMPLE", 1)
    d = spark.createDataFrame([(i, "t" * (1 + i % 50)) for i in range(4000)], "doc_id long, text string")
    keys = d.selectExpr("doc_id AS key", "xxhash64(doc_id) AS h", "cast(length(text) AS long) AS size", "1L AS copies", "doc_id AS i")
    splitters, sums = sharding.split_points(keys, 20, set())
    mean = (sum(s for _, _, s in sums) / 20, sum(n for _, n, _ in sums) / 20)
    assert sum(n for _, n, _ in sums) == 4000 and all(s / mean[0] + n / mean[1] <= 4.001 for _, n, s in sums)
    assert (np.diff(splitters[0]) >= 0).all()


def test_other_columns_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "a", 2, 3.5, "x")], "doc_id long, text string, sh_shard int, part double, row string")
    out = sharding.assign_shards(d)
    assert out.columns == ["doc_id", "text", "part", "row", "sh_shard", "sh_slot"] and tuple(out.first())[:4] == (1, "a", 3.5, "x")
    assert sharding.assign_shards(d.limit(0)).count() == 0


def test_shard_files(spark, tmp_path):
    rows = documents(random.Random(3), 300)
    sharding.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.doc_id, r.text) for r in back if r.text is not None) == sorted(r for r in rows if r[1] is not None) and {r.sh_shard for r in back} == {0, 1, 2, 3} and len(back) == 300
