"""Cells and the index of keys: what is read, and that nothing is lost by it."""

from __future__ import annotations

import random
from datetime import date, datetime

from tidemark.operators import merge
from tidemark.schema import RECORD
from tidemark.sources.layout import Cell, plan_cells
from tidemark.sources.store import Store

NOW = datetime(2026, 9, 19, 12)
DDL = RECORD + ", seq long, seen_at timestamp"


def record(n, seq=0, **changes):
    r = {"source": "olx", "source_listing_id": str(n), "city": f"city{n % 10}", "area": "", "category": "c", "title": f"t{n}", "description": "d", "price": None, "price_currency": "PKR", "price_raw": "", "phone": None, "seller_name": None, "ad_date": date(2026, 9, 1), "url": f"https://s.example/{n}", "located_in": [], "seq": seq, "seen_at": NOW} | changes
    return tuple(r[c.split()[0]] for c in (RECORD.replace("(38,6)", "") + ", seq long, seen_at timestamp").split(", "))


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL)


def stored(df):
    return sorted((r.source_listing_id or "", r.url_canonical or "", r.city, r.title, r.description) for r in df.collect())


def test_cells_cover_all_cities():
    towns = [("a", "k", 5), ("a", "l", 5), ("a", "m", 50), ("a", "n", 1), ("b", "", 3)]
    assert plan_cells(towns, 10) == [Cell(0, "a", "", 1), Cell(1, "a", "m", 5), Cell(2, "a", "n", 1), Cell(3, "b", "", 1)]
    assert plan_cells([], 10) == []


def test_search_opens_only_what_may_hold_the_city(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), cell_rows=30)
    store.ingest(frame(spark, [record(i) for i in range(200)] + [record(1000 + i, source="zameen") for i in range(50)]), NOW.date())
    every = store.read("listings")
    some = store.search(city="city3", source="olx")
    assert stored(some) == stored(every.filter("city = 'city3' and source = 'olx'")) and some.count() == 20
    assert len(every.inputFiles()) >= 10 and len(some.inputFiles()) <= 2
    assert store.search(city="nowhere").count() == 0 and store.search(city="city3").count() == 25
    assert stored(store.search(q="T19")) == stored(every.filter("title like 't19%'"))


def test_batch_reads_only_cells_of_its_keys(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), cell_rows=30)
    store.ingest(frame(spark, [record(i) for i in range(200)]), NOW.date())
    opened = []
    real = Store._open
    monkeypatch.setattr(Store, "_open", lambda self, name, at: (opened.append((name, list(at))), real(self, name, at))[1])
    parts = {p.at: (p.cell, p.slice) for p in store.state().parts}
    assert store.ingest(frame(spark, [record(13, 1, title="new"), record(500, 2)]), NOW.date()) == {"inserted": 1, "updated": 1}
    read = {parts[f] for name, at in opened if name == "listings" for f in at}
    assert len(read) == 1 < len(set(parts.values()))
    opened.clear()
    assert store.ingest(frame(spark, [record(900, 3)]), NOW.date()) == {"inserted": 1, "updated": 0}
    assert not [f for name, at in opened for f in at]
    assert [r.title for r in store.lookup(frame(spark, [record(13, 4, source_listing_id=None)])).collect()] == ["new"]


def test_batches_equal_one_table_without_an_index(spark, tmp_path):
    """Ads that move between cities, lose ids or URLs, change URLs, or are merged by a later sighting."""
    rng = random.Random(11)
    store, plain = Store(spark, str(tmp_path / "s"), cell_rows=12), None
    seq = 0
    for batch in range(2):
        rows = []
        for _ in range(40):
            n, seq = rng.randrange(40), seq + 1
            change = rng.choice([{}, {"city": f"city{rng.randrange(10)}"}, {"source_listing_id": None}, {"url": f"https://s.example/{n}?utm_source=x"}, {"url": f"https://s.example/{(n + 1) % 40}"}, {"source": "zameen"}])
            rows.append(record(n, seq, description="d" * rng.randrange(5), seen_at=datetime(2026, 9, 10 + batch), **change))
        store.ingest(frame(spark, rows), NOW.date())
        plain = merge.upsert(plain, frame(spark, rows)).drop("action", "touched").checkpoint()
        if batch == 0:
            store.compact("listings", most=0)
        got = store.read("listings")
        assert stored(got) == stored(plain)
        assert got.select("id").distinct().count() == got.count()
        assert sorted((r.url_canonical or "", r.first_seen_at) for r in got.collect()) == sorted((r.url_canonical or "", r.first_seen_at) for r in plain.collect())
    assert stored(store.search(city="city4")) == stored(plain.filter("city = 'city4'"))


def test_compaction_splits_cells_that_have_grown(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), cell_rows=40)
    store.ingest(frame(spark, [record(i) for i in range(30)]), NOW.date())
    assert len(store.state().cells) == 1
    store.ingest(frame(spark, [record(i, city="city5" if i % 2 else f"city{i % 10}") for i in range(100, 300)]), NOW.date())
    before = stored(store.read("listings"))
    assert store.compact("listings") == 1 and store.compact("listings") == 0
    state = store.state()
    assert len(state.cells) > 2 and max(c.slices for c in state.cells) > 1 and stored(store.read("listings")) == before
    assert sum(p.rows for p in state.parts) == 230 and max(p.rows for p in state.parts) <= 80
    assert store.ingest(frame(spark, [record(7, 9, title="again"), record(301, 9)]), NOW.date()) == {"inserted": 1, "updated": 1}
    assert store.read("listings").count() == 231


def test_empty_batches_and_stores(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.ingest(frame(spark, []), NOW.date()) == {"inserted": 0, "updated": 0} and store.read("listings").count() == 0
    assert store.lookup(frame(spark, [record(1)])).count() == 0 and store.compact("listings") == 0
    store.write("listings", store.read("listings"))
    assert store.search(city="x").count() == 0
