"""The collect run: units of a plan, their captured pages, the ads on them,
window, validation, merge, and what became of every unit.

Everything between planning and the store works on all units at once, in steps
that are cut off by checkpoint(); only counters, the plan's cities and sources
reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import city_keys
from tidemark.operators import crawlcut, merge, pages, places, planning, validate
from tidemark.session import ensure_checkpoints
from tidemark.sources.store import Store

#: What a run tells of its progress before each step, and at its end.
STEPS = ("planning units", "reading pages", "reading ads", "walking units", "completing ads", "storing ads", "noting outcomes", "done")
#: Ads of one page are numbered below this.
_PER_PAGE = 1_000_000


@dataclass
class RunStats:
    """Counters of a run.  filtered: outside the window; undated: without a date
    that the window could judge; unsupported: units that a site has no page for."""

    inserted: int = 0
    updated: int = 0
    skipped: int = 0
    errors: int = 0
    filtered: int = 0
    undated: int = 0
    unsupported: int = 0
    per_city: dict[str, int] = field(default_factory=dict)

    def as_dict(self) -> dict[str, int]:
        return {k: v for k, v in asdict(self).items() if k != "per_city"}

    @property
    def total(self) -> int:
        return self.inserted + self.updated


def read_ads(captures: DataFrame, now: datetime, collect_phone: bool = True, sources: list[str] | None = None) -> DataFrame:
    """The ads of all captures, each by the reader of its source (of all sources,
    or of those named), with unit_no, page, rn (order in the unit), key and own."""
    found = None
    for source in pages.READERS if sources is None else sources:
        reader = pages.READERS[source]
        mine = captures.filter(F.col("source") == source)
        ads = reader(mine, now, collect_phone)
        found = ads if found is None else found.unionByName(ads)
    # The same page may be captured for several units: an ad belongs to each of them.
    at = captures.select("unit_no", "page", "source", "city", "category", F.col("url").alias("page_url"), "keys")
    j = found.join(at, ["page_url", "source", "city", "category"])
    key = F.coalesce(F.nullif("source_listing_id", F.lit("")), "url")
    return j.withColumns({"unit": F.col("unit_no"), "rn": F.col("page") * _PER_PAGE + F.col("pos"), "key": key, "own": places.in_city(F.col("located_in"), F.col("keys")), "place": F.get("located_in", F.lit(0))}).drop("keys")


def usable(captures: DataFrame) -> DataFrame:
    """Adds ``stop`` (unsupported: no such page 1; failed: page 1 or robots) to
    the pages of every unit and ``early`` (why it ended on a later page), and leaves
    out pages from the first missing one on."""
    c = captures
    missing = F.coalesce("status", F.lit(200)) == 404
    broken = ~F.coalesce("status", F.lit(200)).isin(200, 404)
    banned = ~F.coalesce("allowed", F.lit(True))
    first = F.col("page") == 1
    astray = pages.astray(F.col("source"), F.col("text"), F.col("keys"))
    verdict = F.when(banned, "failed: robots rules").when(broken & first, F.concat(F.lit("failed: status "), F.col("status"))).when(missing & first, "unsupported: no such page").when(astray & first, "unsupported: the page is not of this city")
    stop = c.groupBy("unit_no").agg(F.min_by(verdict, F.when(verdict.isNotNull(), F.col("page"))).alias("stop"))
    bad = c.filter(missing | broken | banned)
    early = F.when(broken & ~first, F.concat(F.lit("stopped early at page "), F.col("page").cast("string"), F.lit(": status "), F.col("status").cast("string")))
    ends = bad.groupBy("unit_no").agg(F.min("page").alias("_end"), F.min_by(F.coalesce(early, F.lit("")), "page").alias("early"))
    return c.join(stop, "unit_no").join(ends, "unit_no", "left").filter(F.col("_end").isNull() | (F.col("page") < F.col("_end")) | (F.col("page") == 1)).drop("_end")


def collect(
    store: Store,
    cities: DataFrame,
    categories: DataFrame,
    captures: DataFrame,
    now: datetime,
    *,
    only: list[str] | None = None,
    selections: dict[str, list[str]] | None = None,
    sources: list[str] | None = None,
    keys: list[str] | None = None,
    start: object = None,
    end: object = None,
    keep_undated: bool = True,
    limit: int | None = None,
    page_cap: int | None = None,
    stale: int = 2,
    barren: int = 0,
    run_cap: int | None = None,
    collect_phone: bool = True,
    detail_pages: DataFrame | None = None,
    on_progress: Callable[[int, int, str], None] | None = None,
) -> RunStats:
    """Runs all units of the plan over captured pages and notes the run.

    captures: city, source, category, page, url, text, base_url, and where known
    status and allowed.  detail_pages: source, url, text of ads' own pages; they
    complete ads whose description is short.  A unit without captures has
    failed.  run_cap ends the run before the first unit at which so many ads
    have been kept.  on_progress is told of every step: how many are done, how many
    there are, and what comes next; units are all worked on at once.
    """
    ensure_checkpoints(store.spark)
    steps = iter(enumerate(STEPS))

    def step() -> None:
        done, label = next(steps)
        if on_progress is not None:
            on_progress(done, len(STEPS) - 1, label)

    step()
    known = planning.choose_cities(cities, only).withColumn("keys", city_keys(F.col("name"), F.col("aliases")))
    units = planning.plan_units(known, categories, selections, sources, keys)
    c = captures
    for name, kind in (("status", "int"), ("allowed", "boolean")):
        if name not in c.columns:
            c = c.withColumn(name, F.lit(None).cast(kind))
    c = c.join(units, ["city", "source", "category"]).join(known.select(F.col("name").alias("city"), "keys"), "city")
    step()
    read = usable(c).checkpoint()
    step()
    good = read.filter("stop is null")
    planned = sorted(r[0] for r in units.select("source").distinct().collect())
    if not planned:
        raise ValueError("the plan has no units")
    asked = crawlcut.page_cap(good, page_cap)
    ads = read_ads(asked, now, collect_phone, planned)
    dated = bool(start or end)
    # An undated ad counts as in the window while pages are read; later it is judged.
    ads = validate.date_window(ads, start, end, keep_undated).withColumn("inw", F.col("verdict") != "filtered").checkpoint()
    step()
    on_page = ads.groupBy("unit", "page").agg(F.count(F.lit(1)).alias("n"))
    on_page = asked.select(F.col("unit_no").alias("unit"), "page").distinct().join(on_page, ["unit", "page"], "left").na.fill(0, ["n"])
    seen, cover = crawlcut.walk(on_page, ads, stale=stale, barren=barren if dated else 0, most=limit)
    seen, cover = seen.checkpoint(), cover.checkpoint()
    kept = seen.filter("verdict = 'in'")
    if run_cap:
        per = units.join(kept.groupBy("unit_no").agg(F.count(F.lit(1)).alias("stored")), "unit_no", "left").na.fill(0, ["stored"])
        running = crawlcut.run_cap(per, run_cap).select("unit_no")
        kept, seen, units = (d.join(running, "unit_no", "left_semi") for d in (kept, seen, units))
    step()
    number = store.start_run(planned, [r[0] for r in known.orderBy("pos").select("name").collect()], now)
    full = complete(kept, detail_pages, now, collect_phone, planned, store)
    judged = full.select(*[F.col(x) for x in pages.RECORD_COLUMNS], (F.col("unit_no") * F.lit(1 << 40) + F.col("rn")).alias("seq"), F.lit(now).cast("timestamp").alias("seen_at")).checkpoint()
    good_rows, bad_rows = validate.split_valid(judged, now.date())
    stats = RunStats(skipped=bad_rows.count())
    step()
    counts = store.ingest(judged, now.date())
    stats.inserted, stats.updated = counts["inserted"], counts["updated"]
    step()
    tally = seen.agg(F.count_if(F.col("verdict") == "filtered"), F.count_if(F.col("verdict") == "undated")).first()
    stats.filtered, stats.undated = tally[0], tally[1]
    stats.per_city = {r[0]: r[1] for r in good_rows.groupBy("city").count().collect()}  # one row a city
    done = outcomes(units, read, cover, kept, dated, page_cap).checkpoint()
    by = {r[0]: r[1] for r in done.groupBy("status").count().collect()}
    stats.errors, stats.unsupported = by.get("failed", 0), by.get("unsupported", 0)
    store.append("outcomes", done)
    store.finish_run(number, stats.as_dict(), "; ".join(f"{k} {v}" for k, v in sorted(by.items())), now)
    step()
    return stats


def complete(ads: DataFrame, detail_pages: DataFrame | None, now: datetime, collect_phone: bool, sources: list[str], store: Store | None = None) -> DataFrame:
    """Ads whose description is short for their source, with what their own pages
    add; an ad that is stored and was read in the last days is left as it is."""
    if detail_pages is None:
        return ads
    wanted = F.lit(False)
    for source in sources:
        if source in pages.DETAILED:
            wanted = wanted | ((F.col("source") == source) & pages.needs_detail(pages.SHORT.get(source, pages.SHORT_TEXT)))
    ads = ads.withColumn("_short", wanted)
    if store is not None:
        new = store.lookup(ads.filter("_short")).filter(~pages.stale_detail(now))
        names = merge.all_names(new).distinct()
        known = merge.all_names(merge.stored_form(ads.filter("_short")), "unit", "rn").join(names, "name", "left_semi").select("unit", "rn").distinct()
        ads = ads.join(known.withColumn("_known", F.lit(True)), ["unit", "rn"], "left").withColumn("_short", F.col("_short") & F.col("_known").isNull()).drop("_known")
    out = ads.filter(~F.col("_short")).drop("_short")
    for source in sources:
        if source in pages.DETAILED:
            found = pages.details(detail_pages.filter(F.col("source") == source).dropDuplicates(["url"]), source, now)
            out = out.unionByName(pages.complete(ads.filter(F.col("_short") & (F.col("source") == source)).drop("_short"), found, source, collect_phone))
    return out


def outcomes(units: DataFrame, read: DataFrame, cover: DataFrame, kept: DataFrame, dated: bool, page_cap: int | None) -> DataFrame:
    """One row a unit: status, why, the page it was searched on, and what was read."""
    first = read.groupBy("unit_no").agg(F.min_by("url", "page").alias("search_url"), F.max("stop").alias("stop"), F.max("early").alias("early"))
    stored = kept.groupBy("unit_no").agg(F.count(F.lit(1)).alias("listings"))
    counts = ("listings", "pages_read", "foreign_ads", "out_of_window")
    u = units.join(first, "unit_no", "left").join(cover.withColumnRenamed("unit", "unit_no"), "unit_no", "left").join(stored, "unit_no", "left").na.fill(0, list(counts))
    stop = F.when(F.col("search_url").isNull(), "failed: no page was captured").otherwise(F.col("stop"))
    part = lambda kind: F.when(stop.startswith(kind), F.substring(stop, len(kind) + 3, 200)).otherwise("")
    u = crawlcut.outcome(u.withColumns({"error": F.coalesce(part("failed"), F.lit("")), "unsupported": F.coalesce(part("unsupported"), F.lit(""))}))
    names = F.array_join(F.slice(F.coalesce("foreign_places", F.array().cast("array<string>")), 1, 3), ", ")
    foreign: Column = F.when(F.col("foreign_ads") > 0, F.concat(F.col("foreign_ads").cast("string"), F.lit(" ad(s) from other places ("), names, F.lit(") were left out")))
    head = F.when(F.coalesce("no_ads", F.lit(False)), "the site returned no ads for this city and category")
    head = head.when(F.col("listings") == 0, F.when(F.col("out_of_window") > 0, F.concat(F.lit("0 listings kept - "), F.col("out_of_window").cast("string"), F.lit(" ad(s) fell outside the date range"))).otherwise(F.concat(F.lit("no ads in "), F.col("city"), F.lit(" for this category"))))
    reason = F.when(F.col("status") == "completed", F.concat_ws("; ", F.nullif(F.coalesce("early", F.lit("")), F.lit("")), head, foreign)).otherwise(F.col("reason"))
    budget = F.lit(page_cap).cast("long")
    done = F.col("status") == "completed"
    return u.select(
        "city", "source", "category", "status", reason.alias("reason"), "search_url", F.lit(None).cast("string").alias("matched"), *[F.when(done, F.col(c)).otherwise(0).cast("long").alias(c) for c in ("pages_read", "listings", "foreign_ads", "out_of_window")],
        budget.alias("page_budget"), F.lit(dated).alias("dated"), (done & F.coalesce("budget_spent", F.lit(False))).alias("budget_spent"),
    )
