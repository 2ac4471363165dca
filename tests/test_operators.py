"""Operators against small cases and sequential models."""

from __future__ import annotations

import random
import zipfile
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import crawlcut, merge, pages, places, planning, validate
from tidemark.schema import RECORD
from tidemark.sources import captures, dims, workbook
from tidemark.operators.graph import components
from tidemark.sources.store import Store
from tidemark.streaming import ingest

NOW = datetime(2026, 9, 19, 12)


def record(n, **kw):
    base = {"source": "olx", "source_listing_id": str(n), "city": "Lahore", "area": "", "category": "Cars", "title": f"Car {n}", "description": "d", "price": None, "price_currency": "PKR", "price_raw": "", "phone": None, "seller_name": None, "ad_date": date(2026, 9, 1), "url": f"https://s.example/{n}", "located_in": [], "seq": 0, "seen_at": NOW}
    row = base | kw
    return row | {"price": None if row["price"] is None else Decimal(row["price"])}


def frame(spark, rows):
    return spark.createDataFrame(rows, RECORD + ", seq long, seen_at timestamp")


def test_thinner_never_erases_richer(spark):
    rows = [record(1, seq=0, description="long text", phone="+92", price=5), record(1, seq=1, description="short", title="New"), record(1, seq=2, source_listing_id=None, description="text long")]
    (r,) = merge.upsert(None, frame(spark, rows)).collect()
    assert (r.title, r.description, r.phone, int(r.price), r.source_listing_id, r.action, r.touched) == ("Car 1", "text long", "+92", 5, "1", "inserted", 3)
    assert r.fingerprint == "olx:id:1"


def test_url_changes_stay_one_row(spark):
    rows = [record(1, seq=0, source_listing_id=None, url="https://s.example/a"), record(1, seq=1, url="https://s.example/a"), record(1, seq=2, url="https://s.example/b"), record(2, seq=3)]
    out = merge.upsert(None, frame(spark, rows)).collect()
    assert sorted(r.touched for r in out) == [1, 3] and sorted(r.id for r in out) == [1, 2]


def test_ads_without_a_url_stay_apart(spark):
    rows = [record(1, url=None), record(2, url=""), record(3, url=None), record(4, url="", source_listing_id=None), record(4, url=None, source_listing_id=None, seq=1), record(5, url=None, source_listing_id="", title="Other")]
    out = {r.title: r for r in merge.upsert(None, frame(spark, rows)).collect()}
    assert {t: r.touched for t, r in out.items()} == {"Car 1": 1, "Car 2": 1, "Car 3": 1, "Car 4": 2, "Other": 1}
    assert out["Car 2"].fingerprint == "olx:id:2" and out["Car 4"].fingerprint.startswith("olx:hash:")


def test_rows_are_stored_stripped(spark):
    rows = [record(1, city=" Lahore ", area=None, title="\tCar\n", description=None, seller_name="  "), record(2, area=" Gulberg ", seller_name=" Ali ")]
    one, two = merge.upsert(None, frame(spark, rows)).orderBy("source_listing_id").collect()
    assert (one.city, one.area, one.title, one.description, one.seller_name) == ("Lahore", "", "Car", "", None)
    assert (two.area, two.seller_name) == ("Gulberg", "Ali")


def test_upsert_equals_one_at_a_time(spark):
    """Batches against a store that takes one sighting after the other."""
    rng = random.Random(9)
    stored: dict = {}
    old = None
    for batch in range(3):
        rows = []
        for i in range(60):
            n = rng.randrange(15)
            rows.append(record(n, seq=batch * 100 + i, source=rng.choice(["olx", "zameen"]), area=rng.choice([None, "", "A", " B "]), description=rng.choice(["", "x", "long text", "other txt"]), phone=rng.choice([None, "+92"]), seller_name=rng.choice([None, "", "Ali"]), price=rng.choice([None, 5, 7]), title=f"T{i}", seen_at=datetime(2026, 9, 1 + batch, 0, i), url=rng.choice([f"https://s.example/{n}", None])))
        want = {"inserted": 0, "updated": 0}
        for r in rows:
            new = {"area": (r["area"] or "").strip(), "description": r["description"], "phone": r["phone"], "seller_name": r["seller_name"] or None, "price": r["price"], "title": r["title"], "last": r["seen_at"]}
            was = stored.get((r["source"], r["source_listing_id"]))
            if was is None:
                want["inserted"] += 1
                stored[r["source"], r["source_listing_id"]] = new | {"first": r["seen_at"]}
                continue
            want["updated"] += 1
            if len(new["description"]) < len(was["description"]):
                new["description"] = was["description"]
            for c in ("area", "phone", "seller_name", "price"):
                if new[c] in (None, "") and was[c] is not None:
                    new[c] = was[c]
            was.update(new)
        out = merge.upsert(old, frame(spark, rows)).checkpoint()
        counts = merge.batch_counts(out).first()
        assert (counts.inserted, counts.updated) == (want["inserted"], want["updated"])
        got = {(r.source, r.source_listing_id): {"area": r.area, "description": r.description, "phone": r.phone, "seller_name": r.seller_name, "price": r.price, "title": r.title, "last": r.last_seen_at, "first": r.first_seen_at} for r in out.collect()}
        assert got == stored
        old = out.drop("action", "touched")
    assert old.select("id").distinct().count() == len(stored) == old.agg(F.max("id")).first()[0]


def test_untouched_rows_stay_as_they_are(spark):
    old = merge.upsert(None, frame(spark, [record(1), record(2), record(3)])).drop("action", "touched").checkpoint()
    out = merge.upsert(old, frame(spark, [record(2, title="New", seq=5), record(4, seq=6)])).checkpoint()
    assert {r.title: (r.action, r.touched) for r in out.collect()} == {"Car 1": ("kept", 0), "Car 3": ("kept", 0), "New": ("updated", 1), "Car 4": ("inserted", 1)}
    keep = lambda d: sorted(map(str, d.filter("title in ('Car 1', 'Car 3')").select(sorted(old.columns)).collect()))
    assert keep(out) == keep(old)
    assert merge.upsert(old, frame(spark, [record(2, seq=5)]), rest=False).count() == 1
    assert merge.upsert(old, frame(spark, [])).count() == 3


def test_components_of_a_long_chain(spark):
    n = 200
    links = spark.createDataFrame([(f"n{i:04d}", f"n{i + 1:04d}") for i in range(n)] + [("x", "y"), ("z", "z"), ("y", "x")], "a string, b string")
    got = dict(components(links).collect())
    assert got == {f"n{i:04d}": "n0000" for i in range(n + 1)} | {"x": "x", "y": "x", "z": "z"}
    assert components(links.limit(0)).count() == 0


def test_fold_is_a_sequential_fold(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(40), i, rng.choice(["", "a", "bb", "cc", "ddd"]), rng.choice([None, "", "p", "q"]), rng.choice("xyz")) for i in range(400)]
    d = spark.createDataFrame(rows, "entity long, seq long, description string, phone string, title string").withColumns({"source": F.lit("s"), "url_canonical": F.lit("u"), "seen_at": F.col("seq")})
    got = {r.entity: (r.description, r.phone, r.title, r.first_seen_at) for r in merge.fold(d).collect()}
    want: dict = {}
    for e, i, text, tel, title in rows:
        w = want.setdefault(e, ["", None, "", i])
        w[0] = text if len(text) >= len(w[0]) else w[0]
        w[1] = tel or w[1]
        w[2] = title
    assert got == {k: tuple(v) for k, v in want.items()}


def test_validation(spark):
    rows = [record(1), record(2, source="x", city=" ", title="", url="a"), record(3, ad_date=date(2030, 1, 1)), record(4, price=-1)]
    good, bad = validate.split_valid(frame(spark, rows), NOW.date())
    assert good.count() == 1
    assert sorted(r.reasons.count(";") for r in bad.collect()) == [0, 0, 3]
    with pytest.raises(ValueError):
        validate.date_window(good, "2026-01-02", "2026-01-01")


@pytest.mark.parametrize("patience", [1, 2, 3])
def test_stops_match_a_loop(spark, patience):
    rng = random.Random(patience)
    rows, want_stale, want_barren = [], set(), set()
    for unit in range(60):
        ads = [(unit, p, p * 10 + k, rng.randrange(6), rng.random() < 0.5, rng.random() < 0.3) for p in range(1, 12) for k in range(rng.randrange(1, 3))]
        rows += ads
        seen, stale, barren, done_stale, done_barren = set(), 0, 0, False, False
        for p in range(1, 12):
            page = [a for a in ads if a[1] == p]
            new = []
            for a in page:
                if a[4] and a[3] not in seen:
                    seen.add(a[3])
                    new.append(a)
            stale = 0 if new else stale + 1
            done_stale = done_stale or stale >= patience
            if not done_stale:
                want_stale |= {(a[0], a[2]) for a in new}
            if new and not done_barren:
                want_barren |= {(a[0], a[2]) for a in new}
                barren = 0 if any(a[4] and a[5] for a in page) else barren + 1
                done_barren = barren >= patience
    d = spark.createDataFrame(rows, "unit int, page int, rn int, key int, own boolean, inw boolean")
    assert {(r.unit, r.rn) for r in crawlcut.stale_stop(d, patience).collect()} == want_stale
    assert {(r.unit, r.rn) for r in crawlcut.barren_stop(d, patience).collect()} == want_barren


def test_places(spark):
    cities = spark.createDataFrame([("Kotli", "Azad Jammu & Kashmir", []), ("Nowhere", None, ["Far Town"])], "name string, province string, aliases array<string>")
    loc = spark.createDataFrame([("s", "kotli", "a", "Punjab", "city", 0), ("s", "Kotli", "b", "Azad Jammu & Kashmir", "locality", 1), ("s", "far-town", "c", None, "city", 2)], "source string, name string, identifier string, province string, level string, pos long")
    assert {r.city: r.identifier for r in places.resolve(cities, loc).collect()} == {"Kotli": "b", "Nowhere": "c"}
    state = 'window.state = {"cities":{"data":[{"name":"X","slug":"/X-1","parentID":1522}]}}'
    (r,) = places.state_cities(spark.createDataFrame([(state,)], "text string")).collect()
    assert (r.identifier, r.province) == ("X-1", "Punjab")


def test_planning(spark):
    known = spark.createDataFrame([("olx",)], "source string")
    with pytest.raises(ValueError, match="unknown sources: foo"):
        planning.require_known(spark.createDataFrame([("foo",), ("olx",)], "source string"), known, "source", "sources")


def capture(spark, html, source):
    return spark.createDataFrame([(f"https://{source}.example/p", html, f"https://{source}.example", "Lahore", "Cars")], "url string, text string, base_url string, city string, category string")


def test_state_index(spark):
    html = 'window.state = {"algolia":{"content":{"hits":[{"externalID":"7","title":"Civic &amp; more","slug":"civic","price":0,"extraFields":{"price":4500000},"createdAt":"2026-09-01T00:00:00Z","contactInfo":{"name":"Ali"},"location":[{"level":2,"name":"Lahore"},{"level":3,"name":"DHA"}],"description":"call 0300-1234567"},{"title":"no id"}]}}}'
    (r,) = pages.olx_index(capture(spark, html, "a"), NOW).collect()
    assert (r.source_listing_id, r.title, int(r.price), r.area, r.located_in, r.ad_date, r.seller_name, r.phone) == ("7", "Civic & more", 4500000, "DHA", ["Lahore", "DHA"], date(2026, 9, 1), "Ali", "+923001234567")
    links = '<a href="/item/nice-car-iid-99">Nice <b>car</b></a><a href="/item/nice-car-iid-99">again</a><a href="/x">x</a>'
    (r,) = pages.olx_index(capture(spark, links, "a"), NOW).collect()
    assert (r.source_listing_id, r.title, r.url) == ("99", "Nice car", "https://a.example/item/nice-car-iid-99")


def test_link_indexes(spark):
    html = '<script type="application/ld+json">{"@type":"Product","offers":{"url":"https://b.example/used-cars/x-for-sale-in-lahore-12345/","price":90}}</script><a class="car-name" title="X" href="/used-cars/x-for-sale-in-lahore-12345">y</a>'
    (r,) = pages.pakwheels_index(capture(spark, html, "b"), NOW).collect()
    assert (r.source_listing_id, r.title, int(r.price), r.located_in) == ("12345", "X", 90, ["lahore"])
    html = '<a href="/Property/a_b-55555-12-1.html"></a><a href="https://other.example/share?u=/Property/a-66666-1.html">s</a>'
    (r,) = pages.zameen_index(capture(spark, html, "c"), NOW).collect()
    assert (r.source_listing_id, r.title) == ("55555", "Zameen listing 55555")


def test_details_complete_stubs(spark):
    html = 'window.state = {"property":{"data":{"requiresLoginForContact":false,"mobilePhoneNumber":"03001234567","contactName":"Agency","location":[{"level":3,"name":"Block A"}],"description":"Big house","price":100,"createdAt":1777593600}}}'
    d = pages.details(spark.createDataFrame([("u", html)], "url string, text string"), "zameen", NOW)
    stub = spark.createDataFrame([record(1, source="zameen", url="u", description="", ad_date=None)], RECORD + ", seq long, seen_at timestamp")
    (r,) = pages.complete(stub, d, "zameen").collect()
    assert (r.description, int(r.price), r.phone, r.seller_name, r.area, r.ad_date) == ("Big house", 100, "+923001234567", "Agency", "Block A", date(2026, 5, 1))
    gated = html.replace("false", "true")
    d = pages.details(spark.createDataFrame([("u", gated)], "url string, text string"), "zameen", NOW)
    assert pages.complete(stub, d, "zameen").first().phone is None


def test_store_and_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.tables() == [] and store.read("listings").count() == 0
    assert store.ingest(frame(spark, [record(1), record(2, title="<b>T</b> &amp; x")]), NOW.date()) == {"inserted": 2, "updated": 0}
    assert store.ingest(frame(spark, [record(1), record(3), record(4, city="")]), NOW.date()) == {"inserted": 1, "updated": 1}
    assert store.read("rejects").count() == 1 and store.clean_texts() == 1
    frame(spark, [record(9), record(1)]).write.json(str(tmp_path / "in"))
    ingest.ingest(ingest.read_sightings(spark, str(tmp_path / "in")), store, str(tmp_path / "cp"), NOW.date()).awaitTermination(120)
    got = store.read("listings")
    assert got.count() == 4 and got.select("id").distinct().count() == 4
    merge.check_unique(got)
    assert workbook.export_workbook(got, str(tmp_path / "w.xlsx")) == 4
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        book = z.read("xl/workbook.xml").decode()
        assert book.index("All Listings") < book.index("Lahore") < book.index("Summary")
        assert "T &amp;" in z.read("xl/worksheets/sheet1.xml").decode()


def test_store_survives_crashes_and_rivals(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.init() == ["listings", "runs", "rejects", "outcomes"] and store.init() == [] and store.tables() == ["listings", "runs", "rejects", "outcomes"]
    store.ingest(frame(spark, [record(i) for i in range(100)] + [record(200, city="")]), NOW.date())
    # A writer that died within its pointer leaves the table as it was.
    at = store._pointers("listings")[-1]
    (tmp_path / "s" / "listings" / "_pointers" / f"{at + 1:012d}").write_text('{"kind": "last", "id": 9}\n')
    assert store.read("listings").count() == 100
    before = {p.at for p in store.state().parts}
    assert store.ingest(frame(spark, [record(5, title="New", seq=1), record(300, city=" ")]), NOW.date()) == {"inserted": 0, "updated": 1}
    after = {p.at for p in store.state().parts}
    assert len(before - after) == 1 and len(after - before) == 1  # one cell was written anew
    assert store.read("listings").count() == 100 and store.read("listings").filter("title = 'New'").count() == 1
    assert len(store._current("rejects")) == 2 and store.read("rejects").count() == 2
    with pytest.raises(Exception, match="exist"):
        store._pointers = lambda name: []
        store._publish("listings", [])
    del store._pointers
    store.compact("listings")
    assert store.read("listings").count() == 100


def test_runs_are_noted(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.start_run(["olx"], ["Lahore", "Multan"], NOW) == 1
    (r,) = store.runs().collect()
    assert r.finished_at is None and r.cities == "Lahore,Multan" and r.inserted == 0
    store.finish_run(1, {"inserted": 3, "errors": 1}, "done", NOW)
    assert store.start_run(["zameen"], [], NOW) == 2
    one, two = store.runs().orderBy("id").collect()
    assert (one.started_at, one.finished_at, one.inserted, one.updated, one.errors, one.notes) == (NOW, NOW, 3, 0, 1, "done") and two.finished_at is None


def test_workbook_has_a_sheet_for_every_city(spark, tmp_path):
    n = 10_003
    d = spark.range(2 * n).select(
        F.col("id"), F.concat(F.lit("c"), F.lpad((F.col("id") % n).cast("string"), 5, "0")).alias("city"), F.lit("s").alias("source"), F.lit("t").alias("title"), F.lit("d").alias("description"),
        F.lit(1).cast("decimal(18,2)").alias("price"), F.lit(None).cast("string").alias("phone"), F.lit(date(2026, 9, 1)).alias("ad_date"), F.lit(NOW).alias("first_seen_at"), F.lit(NOW).alias("last_seen_at"),
    )
    assert workbook.export_workbook(d, str(tmp_path / "many.xlsx")) == 2 * n
    with zipfile.ZipFile(tmp_path / "many.xlsx") as z:
        assert z.read("xl/workbook.xml").decode().count("<sheet ") == n + 2
        for k in (0, 5_000, n - 1):
            sheet = z.read(f"xl/worksheets/sheet{k + 2}.xml").decode()
            assert sheet.count(f">c{k:05d}<") == 2 and sheet.count("<row ") == 3


def test_sources(spark, tmp_path):
    d = spark.createDataFrame([("u1", 200, "<title>x</title>rest", NOW), ("u2", 404, "", datetime(2026, 9, 1))], "url string, status int, text string, fetched_at timestamp")
    captures.write_cache(d, str(tmp_path / "c"))
    (tmp_path / "c" / "bad.json").write_text("{oops")
    got = captures.read_cache(spark, str(tmp_path / "c"), NOW).collect()
    assert [r.url for r in got] == ["u1"]
    assert captures.peek(d).first().text == "<title>x</title>"
    (tmp_path / "m.json").write_text('{"cities":[{"name":"Lahore","aliases":["LHR"],"lat":1.5}]}')
    assert dims.cities(spark, str(tmp_path / "m.json")).first().aliases == ["LHR"]
    assert dims.cities(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "g.txt").write_text("\t".join(["1", "Lahore", "", "", "31.5", "74.3", "P", "PPLA", "PK", "", "04", "", "", "", "9", "", "", "", ""]) + "\n")
    assert places.gazetteer(dims.gazetteer(spark, str(tmp_path / "g.txt"))).first().province == "Punjab"


def test_a_registered_source_may_say_how_its_pages_are_scoped(spark):
    d = spark.createDataFrame([("new", "<h1>Lahore</h1>"), ("new", "<h1>Multan</h1>"), ("new", None), ("olx", "<h1>Multan</h1>"), ("pakwheels", "<title>Cars for sale in Lahore | x</title>"), ("pakwheels", "<title>Cars for sale in Pakistan | x</title>")], "source string, text string")
    pages.register("new", pages.olx_index, lambda t: F.regexp_extract(t, "<h1>(.*?)</h1>", 1))
    try:
        got = d.select(pages.astray(F.col("source"), F.col("text"), F.array(F.lit("lahore")))).collect()
        assert [r[0] for r in got] == [False, True, True, False, False, True]
        pages.register("new", pages.olx_index)
        assert "new" not in pages.SCOPES and pages.READERS["new"] is pages.olx_index
    finally:
        del pages.READERS["new"]


def test_ids_with_urls_of_their_own_need_no_rounds(spark, monkeypatch):
    """An id at two URLs is settled, and a sighting without it finds it; a URL of two ids still joins them."""
    rows = [("a", "1", "u"), ("a", "1", "v"), ("a", None, "v"), ("a", "2", None), ("a", None, "w"), ("b", "1", "u")]
    d = spark.createDataFrame([(*r, "c", "k", "t", "p", n) for n, r in enumerate(rows)], "source string, source_listing_id string, url string, city string, category string, title string, price_raw string, n int").withColumn("url_canonical", F.col("url"))
    with monkeypatch.context() as m:
        m.setattr(merge, "components", None)
        e = {r.n: r.entity for r in merge.entities(d).collect()}
    assert e[0] == e[1] == e[2] and len({e[k] for k in (0, 3, 4, 5)}) == 4
    more = d.limit(1).withColumns({"source": F.lit("a"), "source_listing_id": F.lit("2"), "url": F.lit("v"), "url_canonical": F.lit("v"), "n": F.lit(9)})
    e = {r.n: r.entity for r in merge.entities(d.unionByName(more)).collect()}
    assert len({e[k] for k in (0, 1, 2, 3, 9)}) == 1 and len({e[k] for k in (0, 4, 5)}) == 3


def test_one_url_an_id_is_known_without_a_join(spark, monkeypatch):
    """Nothing is joined where ids and URLs pair off; ids follow the entities' order; what may be hot is folded where it lies, with the same rows."""
    rows = [record(n, seq=n) for n in range(30)] + [record(n, source_listing_id=None, seq=100 + n) for n in range(30)]
    s = merge.stored_form(frame(spark, rows)).checkpoint()
    assert "Join" not in merge.entities(s)._jdf.queryExecution().toString()
    plain = lambda d: sorted((r.id, r.fingerprint, r.touched) for r in d.collect())
    cold = plain(merge.upsert(None, s))
    assert [r[2] for r in cold] == [2] * 30 and [r[0] for r in cold] == list(range(1, 31))
    monkeypatch.setattr(merge, "MOST_SEEN", 0)
    assert plain(merge.upsert(None, s)) == cold


def test_three_stored_rows_in_one_are_all_replaced(spark):
    old = merge.upsert(None, frame(spark, [record(n) for n in (1, 2, 3, 4)])).drop("action", "touched").checkpoint()
    url = {r.source_listing_id: r.url for r in old.collect()}
    (r,) = merge.upsert(old, frame(spark, [record(1, url=url["2"], seq=8), record(2, url=url["3"], seq=9)]), rest=False).collect()
    gone = {x.id for x in old.filter("source_listing_id <> '4'").collect()}
    assert set(r.replaces) == gone and r.id == min(gone)
