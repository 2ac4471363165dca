"""The page cache as a source: what it gives, and which files it opens."""

from __future__ import annotations

import os
from datetime import UTC, datetime

from pyspark.sql import functions as F

from tidemark.sources import page_cache

NOW = datetime(2026, 9, 19, 12, tzinfo=UTC)


def test_page_cache_reads_what_was_written(spark, tmp_path):
    page_cache.register(spark)
    root = tmp_path / "cache"
    rows = [(f"https://s.example/{i}?q=ä", 200 if i % 5 else 404, f"<p>{i}</p>", datetime(2026, 9, 19, i % 12, tzinfo=UTC)) for i in range(60)]
    d = spark.createDataFrame(rows, "url string, status int, text string, fetched_at timestamp")
    d.write.format("page_cache").mode("append").save(str(root))
    d.limit(1).withColumn("text", F.lit("newer")).write.format("page_cache").mode("append").save(str(root))
    files = [os.path.join(a, f) for a, _, fs in os.walk(root) for f in fs]
    assert len(files) == 60 and all(f.endswith(".json") for f in files)
    for u, _, _, t in rows:
        os.utime(root / page_cache.name_of(u), (t.timestamp(), t.timestamp()))
    (root / page_cache.name_of(rows[7][0])).write_text("{oops")
    (root / "00" / "11.json").parent.mkdir(exist_ok=True)
    (root / "00" / "11.json").write_text("[]")

    cache = spark.read.format("page_cache").load(str(root))
    got = {r.url: (r.status, r.text) for r in cache.collect()}
    assert len(got) == 59 and got[rows[3][0]] == (200, "<p>3</p>") and sorted(x[1] for x in got.values()).count("newer") == 1
    assert spark.read.format("page_cache").option("corrupt", True).load(str(root)).filter("corrupt is not null").count() == 2

    # One URL: one file.  A young time to live: only files written since.
    one = cache.filter(F.col("url") == rows[9][0])
    assert [r.text for r in one.collect()] == ["<p>9</p>"] and one.rdd.getNumPartitions() == 1
    for name in (page_cache.name_of(u) for u, _, _, t in rows if t.hour < 9):
        (root / name).write_text("{oops")  # unreadable, were it opened
        os.utime(root / name, (1, 1))
    os.utime(root / "00" / "11.json", (1, 1))
    young = spark.read.format("page_cache").options(ttl_hours=3, now="2026-09-19T12:00:00+00:00", corrupt=True).load(str(root))
    assert sorted(r.url or "" for r in young.collect()) == sorted(u for u, _, _, t in rows if t.hour > 9)
    since = spark.read.format("page_cache").option("corrupt", True).load(str(root)).filter(F.col("fetched_at") >= F.lit(datetime(2026, 9, 19, 10, tzinfo=UTC)))
    assert since.count() == sum(t.hour >= 10 for _, _, _, t in rows)
    assert spark.read.format("page_cache").load(str(tmp_path / "none")).count() == 0


def test_every_page_of_a_url_that_repeats(spark, tmp_path):
    """Twice one URL, once with one text: three rows, as the SQL has them; written again, no more."""
    from tidemark.plans.catalog_store import page_cache_source

    rows = [(1, "https://s.example/a", "x"), (2, "https://s.example/a", "y"), (49, "https://s.example/a", "x"), (3, "https://s.example/b", "z"), (30, "https://s.example/b", "old")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = page_cache_source(spark, str(tmp_path)).groupBy("url").count().collect()
    assert sorted(map(tuple, got)) == [("https://s.example/a", 3), ("https://s.example/b", 1)]

    root = str(tmp_path / "cache")
    c = spark.createDataFrame(rows, "capture string, url string, text string").withColumns({"status": F.lit(200), "fetched_at": F.lit(NOW)})
    for _ in range(2):
        c.write.format("page_cache").mode("append").save(root)
    one = spark.read.format("page_cache").load(root).filter("url = 'https://s.example/a'")
    assert sorted(r.text for r in one.collect()) == ["x", "x", "y"] and one.rdd.getNumPartitions() == 1
