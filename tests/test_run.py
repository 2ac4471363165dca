"""The collect run, job state and what is noted of both."""

from __future__ import annotations

import json
import threading
import time
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import planning
from tidemark.plans import run
from tidemark.plans.jobs import HISTORY, LOG_LINES, Job, Jobs
from tidemark.sources.store import Store

NOW = datetime(2026, 9, 19, 12)


def page(*ads):
    """An index page; ads are (id, place) or (id, place, changes)."""
    hits = []
    for n, place, *more in ads:
        hits.append({"externalID": str(n), "title": f"Car {n}", "slug": f"car-{n}", "description": "well kept " * 10, "extraFields": {"price": "100"}, "createdAt": "2026-09-10", "location": [{"level": 0, "name": "Land"}, {"level": 1, "name": "Province"}, {"level": 2, "name": place}]} | (more[0] if more else {}))
    return "<script>window.state = " + json.dumps({"algolia": {"content": {"hits": hits}}}) + ";</script>"


@pytest.fixture
def world(spark):
    cities = spark.createDataFrame([("Lahore", ["LHR"], 0, True), ("Multan", [], 1, True), ("Turbat", [], 2, False), ("Kotli", [], 3, True)], "name string, aliases array<string>, pos int, enabled boolean")
    categories = spark.createDataFrame([("olx", "cars", "Cars", 0, True)], "source string, key string, label string, pos int, enabled boolean")

    def captures(rows):
        return spark.createDataFrame([(c, "olx", "cars", p, f"https://s.example/{c}?page={p}", t, "https://s.example", s, a) for c, p, t, s, a in rows], "city string, source string, category string, page int, url string, text string, base_url string, status int, allowed boolean")

    return cities, categories, captures


def test_run_collects_every_unit(spark, tmp_path, world):
    cities, categories, captures = world
    store = Store(spark, str(tmp_path / "s"))
    first = page((1, "Lahore"), (2, "Lahore", {"createdAt": "2026-08-01"}), (3, "Lahore", {"createdAt": None}), (4, "Sialkot"), (5, "Lahore", {"title": "x" * 501}))
    rows = [
        ("Lahore", 1, first, 200, True),
        ("Lahore", 2, page((1, "Lahore"), (6, "Daska"), (7, "Lahore")), 200, True),
        ("Lahore", 3, page((1, "Lahore"), (8, "Daska")), 200, True),
        ("Lahore", 4, page((7, "Lahore")), 200, True),
        ("Lahore", 5, page((9, "Lahore")), 200, True),
        ("Multan", 1, "", 404, True),
        ("Kotli", 1, page((20, "Kotli")), 200, False),
    ]
    stats = run.collect(store, cities, categories, captures(rows), NOW, start=date(2026, 9, 1), keep_undated=False)
    # Pages 3 and 4 hold nothing new, so page 5 is not read.
    assert stats.as_dict() == {"inserted": 2, "updated": 0, "skipped": 1, "errors": 1, "filtered": 1, "undated": 1, "unsupported": 1}
    assert stats.per_city == {"Lahore": 2} and stats.total == 2
    got = store.read("listings")
    assert sorted(r.source_listing_id for r in got.collect()) == ["1", "7"] and {r.city for r in got.collect()} == {"Lahore"}
    assert store.read("rejects").first().reasons == "title is implausibly long"
    done = {r.city: r for r in store.read("outcomes").collect()}
    assert {c: r.status for c, r in done.items()} == {"Lahore": "completed", "Multan": "unsupported", "Kotli": "failed"}
    assert (done["Lahore"].pages_read, done["Lahore"].out_of_window, done["Lahore"].dated, done["Lahore"].budget_spent) == (2, 1, True, False)
    assert done["Lahore"].foreign_ads == 3 and "Sialkot, Daska" in done["Lahore"].reason and done["Multan"].reason == "no such page" and done["Kotli"].reason == "robots rules"
    (noted,) = store.runs().collect()
    assert (noted.sources, noted.cities, noted.inserted, noted.skipped, noted.errors) == ("olx", "Lahore,Multan,Kotli", 2, 1, 1) and noted.finished_at == NOW
    again = run.collect(store, cities, categories, captures(rows), NOW, start=date(2026, 9, 1), keep_undated=False)
    assert (again.inserted, again.updated) == (0, 2) and store.runs().count() == 2


def test_run_limits_and_named_cities(spark, tmp_path, world):
    cities, categories, captures = world
    rows = [("Lahore", 1, page((1, "Lahore"), (2, "Lahore"), (3, "Lahore")), 200, True), ("Turbat", 1, page((4, "Turbat")), 200, True), ("Multan", 1, page((5, "Lahore")), 200, True)]
    store = Store(spark, str(tmp_path / "a"))
    assert run.collect(store, cities, categories, captures(rows), NOW, only=["lhr", "TURBAT"], limit=2).per_city == {"Lahore": 2, "Turbat": 1}
    capped = run.collect(Store(spark, str(tmp_path / "b")), cities, categories, captures(rows), NOW, only=["Lahore", "Turbat"], run_cap=2)
    assert capped.per_city == {"Lahore": 3}
    with pytest.raises(ValueError, match="unknown cities: Atlantis"):
        run.collect(store, cities, categories, captures(rows), NOW, only=["Lahore", "Atlantis"])
    with pytest.raises(ValueError, match="unknown sources: nowhere"):
        run.collect(store, cities, categories, captures(rows), NOW, selections={"nowhere": []})
    s = Store(spark, str(tmp_path / "c"))
    empty = run.collect(s, cities, categories, captures(rows), NOW, only=["Multan", "Kotli"])
    assert empty.total == 0 and empty.errors == 1
    assert {r.city: r.reason for r in s.read("outcomes").collect()} == {"Multan": "no ads in Multan for this category; 1 ad(s) from other places (Lahore) were left out", "Kotli": "no page was captured"}


def test_run_ends_at_an_empty_page_and_counts_what_it_read(spark, tmp_path, world):
    """An ad beyond an empty page is not read; foreign ads beyond the stop are not counted; a
    page that fails later ends the unit early."""
    cities, categories, captures = world
    rows = [("Lahore", 1, page((1, "Lahore")), 200, True), ("Lahore", 2, page(), 200, True), ("Lahore", 3, page((2, "Lahore")), 200, True)]
    rows += [("Multan", 1, page((5, "Multan"), (6, "Lahore")), 200, True), ("Multan", 2, page((5, "Multan")), 200, True), ("Multan", 3, page((5, "Multan")), 200, True), ("Multan", 4, page((7, "Daska")), 200, True)]
    rows += [("Kotli", 1, page((8, "Kotli")), 200, True), ("Kotli", 2, "", 503, True), ("Kotli", 3, page((9, "Kotli")), 200, True)]
    store = Store(spark, str(tmp_path / "s"))
    assert run.collect(store, cities, categories, captures(rows), NOW).per_city == {"Lahore": 1, "Multan": 1, "Kotli": 1}
    done = {r.city: r for r in store.read("outcomes").collect()}
    assert {c: (r.pages_read, r.foreign_ads, r.listings) for c, r in done.items()} == {"Lahore": (1, 0, 1), "Multan": (1, 1, 1), "Kotli": (1, 0, 1)}
    assert done["Kotli"].reason == "stopped early at page 2: status 503" and done["Lahore"].reason == ""


def test_short_ads_are_completed(spark, tmp_path, world):
    cities, categories, captures = world
    text = page((1, "Lahore", {"description": "short"}), (2, "Lahore"))
    detail = "<script>window.state = " + json.dumps({"ad": {"data": {"title": "Full title", "description": "all there is to know about it", "externalID": "1"}}}) + ";</script>"
    pages = spark.createDataFrame([("olx", "https://s.example/item/car-1-iid-1", detail)], "source string, url string, text string")
    store = Store(spark, str(tmp_path / "s"))
    assert run.collect(store, cities, categories, captures([("Lahore", 1, text, 200, True)]), NOW, only=["Lahore"], detail_pages=pages).inserted == 2
    assert {r.source_listing_id: r.title for r in store.read("listings").collect()} == {"1": "Full title", "2": "Car 2"}
    # Read again a day later, the stored ad is fresh, so its own page is left alone.
    newer = pages.withColumn("text", F.replace("text", F.lit("Full title"), F.lit("Newer title")))
    run.collect(store, cities, categories, captures([("Lahore", 1, text, 200, True)]), NOW + timedelta(days=1), only=["Lahore"], detail_pages=newer)
    assert {r.source_listing_id: r.title for r in store.read("listings").collect()} == {"1": "Car 1", "2": "Car 2"}


def test_disabled_cities_by_name(spark, world):
    cities, _, _ = world
    assert [r.name for r in planning.choose_cities(cities).orderBy("pos").collect()] == ["Lahore", "Multan", "Kotli"]
    assert [r.name for r in planning.choose_cities(cities, ["turbat", "LHR", "Lahore"]).orderBy("pos").collect()] == ["Lahore", "Turbat"]


def test_jobs(spark):
    jobs, go, said = Jobs(spark), threading.Event(), threading.Event()

    def work(job):
        for i in range(LOG_LINES + 10):
            job.log(f"line {i}")
        said.set()
        go.wait(30)
        return {"n": spark.range(10).count()}

    job = jobs.start(work, {"city": "Lahore"})
    with pytest.raises(RuntimeError, match="already"):
        jobs.start(work)
    assert said.wait(30)
    assert jobs.list()[0]["state"] == "running" and job.status(2)["log"] == [f"line {LOG_LINES + 8}", f"line {LOG_LINES + 9}"] and len(job.status(10_000)["log"]) == LOG_LINES
    go.set()
    job.thread.join(60)
    assert job.state == "completed" and job.result == {"n": 10} and jobs.get(job.id) is job and jobs.get("none") is None
    bad = jobs.start(lambda j: 1 / 0)
    bad.thread.join(60)
    assert bad.state == "failed" and bad.error.startswith("ZeroDivisionError")
    hold = jobs.start(lambda j: j.cancelled.wait(30) and None)
    assert not jobs.cancel("none") and jobs.cancel(hold.id)
    hold.thread.join(60)
    assert hold.state == "cancelled" and not jobs.cancel(hold.id)
    for _ in range(HISTORY):
        jobs.start(lambda j: {}).thread.join(60)
    assert len(jobs.list()) == HISTORY and jobs.get(job.id) is None


def test_logs_are_read_from_an_offset(spark):
    """By offsets, every line is read once, also after the oldest have been forgotten."""
    job, got, at = Job({}), [], 0
    for burst in (3, LOG_LINES - 1, 2, 0, LOG_LINES):
        for _ in range(burst):
            job.log(f"line {job.said}")
        s = job.status(offset=at)
        assert s["log_from"] == at and s["log_next"] == at + burst
        got, at = got + s["log"], s["log_next"]
    assert got == [f"line {i}" for i in range(2 * LOG_LINES + 4)]
    assert job.status(offset=at)["log"] == [] and job.status(offset=at + 9)["log"] == []
    late = job.status(offset=5)
    assert late["log_from"] == LOG_LINES + 4 and len(late["log"]) == LOG_LINES
    assert job.status(2)["log_from"] == 2 * LOG_LINES + 2
    job.progress(1, 8, "x")
    assert job.status()["progress"]["percent"] == 12


def test_a_run_and_a_stream_report_progress(spark, tmp_path, world):
    cities, categories, captures = world
    store, seen = Store(spark, str(tmp_path / "s")), []
    work = lambda job: run.collect(store, cities, categories, captures([("Lahore", 1, page((1, "Lahore")), 200, True)]), NOW, on_progress=lambda *p: (seen.append(p), job.progress(*p))).as_dict()
    jobs = Jobs(spark)
    job = jobs.start(work)
    job.thread.join(300)
    assert job.state == "completed" and job.result["inserted"] == 1
    assert seen == [(i, len(run.STEPS) - 1, label) for i, label in enumerate(run.STEPS)]
    assert job.status()["progress"] | {"rows": 0} == {"done": 7, "total": 7, "label": "done", "percent": 100, "rows": 0} and jobs.tasks(job.id) == {"done": 0, "total": 0}
    spark.range(5).write.parquet(str(tmp_path / "in"))

    def stream(job):
        q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.queryName("five").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):  # events come after the query has ended
            if job.rows:
                return {}
            time.sleep(0.1)

    job = jobs.start(stream)
    job.thread.join(120)
    assert job.status()["progress"]["rows"] == 5 and any("five batch 0: 5 rows" in x for x in job.status()["log"])
