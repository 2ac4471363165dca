"""Continuous collecting: captured pages stream in, and every unit is read page by
page with its state kept between batches.

A first query turns each batch of captures into one row a page with its ads.  A
second one walks the units: what a unit has shown, its stale and idle pages in a row
and whether it has ended are its state, so pages may come in any batches and in any
order.  Pages of a unit are numbered from 1 without gaps; one that comes early waits
in the state.  Pages that are read again, as after a failure, change nothing.  What
comes out is what ``crawlcut.walk`` gives for all pages at once.

One thing differs from a run: a page that robots rules forbid ends its unit, but ads of
earlier pages have been stored by then.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.operators import validate
from tidemark.operators.pages import RECORD_COLUMNS, astray as astray_page
from tidemark.plans.run import read_ads
from tidemark.schema import RECORD
from tidemark.sources.store import Store

CAPTURE = "city string, source string, category string, page int, url string, text string, base_url string, status int, allowed boolean"
#: A page: the unit, its number, and its ads in order, as JSON.
PAGE = "unit long, page long, ads string"
_AT = "page long, stale int, idle int, made long, ended boolean, early long"
_OUT = "unit long, page long, rn long, inw boolean, ad string"


class UnitWalk(StatefulProcessor):
    """Reads a unit's pages in order; gives its fresh ads until a rule ends it.

    State is asked for and told once a batch, not once an ad: the keys that a batch adds
    are one entry of a list, and pages that wait are read when the awaited one is among
    them (``early`` is the first that waits)."""

    def __init__(self, stale: int = 2, barren: int = 0, most: int | None = None):
        self.patience, self.barren, self.most = stale, barren, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", _AT)
        self.seen = handle.getListState("seen", "keys string")
        self.waiting = handle.getListState("waiting", "page long, ads string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        page, stale, idle, made, ended, early = self.at.get() or (1, 0, 0, 0, False, None)
        if ended:
            return
        came: dict[int, str] = {}
        for part in rows:
            came.update(zip(part["page"].tolist(), part["ads"].tolist(), strict=True))
        out: list[tuple] = []
        known: set[str] | None = None
        added: list[str] = []
        first, held = page, early is not None
        while not ended:
            if page == early:
                came, early = dict(self.waiting.get()) | came, None
            ads = came.pop(page, None)
            if ads is None:
                break
            if known is None:
                known = {k for (keys,) in self.seen.get() for k in json.loads(keys)} if page > 1 else set()
            stale, idle, made, ended = self._page(key[0], page, json.loads(ads), stale, idle, made, out, known, added)
            page += 1
        later = [] if ended else [(p, ads) for p, ads in came.items() if p > page]
        if ended:
            if first > 1:
                self.seen.clear()
            if held:
                self.waiting.clear()
        else:
            if added:
                self.seen.appendValue((json.dumps(added),))
            if held and early is None:  # read above: what is left is written anew
                self.waiting.put(later) if later else self.waiting.clear()
            elif later:
                self.waiting.appendList(later)
            early = min([p for p, _ in later] + ([] if early is None else [early]), default=None)
        self.at.update((page, stale, idle, made, ended, early))
        if out:
            yield pd.DataFrame(out, columns=["unit", "page", "rn", "inw", "ad"])

    def _page(self, unit: int, page: int, ads: list[dict], stale: int, idle: int, made: int, out: list, known: set[str], added: list[str]) -> tuple[int, int, int, bool]:
        if not ads or (self.most and made >= self.most):
            return stale, idle, made, True
        own = [a for a in ads if a["own"]]
        fresh = {}
        for a in own:
            if a["key"] not in fresh and a["key"] not in known:
                fresh[a["key"]] = a
        if not fresh:
            return stale + 1, idle, made, stale + 1 >= self.patience
        for k, a in fresh.items():
            if self.most and made >= self.most:
                break
            known.add(k)
            added.append(k)
            out.append((unit, page, a["rn"], a["inw"], json.dumps(a.get("ad"))))
            made += a["inw"]
        idle = 0 if any(a["inw"] for a in own) else idle + 1
        return 0, idle, made, bool(self.barren) and idle >= self.barren


def walk_stream(pages: DataFrame, stale: int = 2, barren: int = 0, most: int | None = None) -> DataFrame:
    """(unit, page, rn, inw, ad) of the fresh ads of a stream of pages."""
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return pages.groupBy("unit").transformWithStateInPandas(UnitWalk(stale, barren, most), _OUT, "append", "none")


def page_rows(captures: DataFrame, units: DataFrame, cities: DataFrame, sources: list[str], now: datetime, start: object = None, end: object = None, collect_phone: bool = True) -> DataFrame:
    """One row a captured page of a planned unit; a page that is missing, failed, is
    forbidden or is not of the city (page 1) has no ads."""
    c = captures.join(F.broadcast(units.select("unit_no", "city", "source", "category")), ["city", "source", "category"]).join(F.broadcast(cities.select(F.col("name").alias("city"), "keys")), "city")
    astray = (F.col("page") == 1) & astray_page(F.col("source"), F.col("text"), F.col("keys"))
    good = c.filter((F.coalesce("status", F.lit(200)) == 200) & F.coalesce("allowed", F.lit(True)) & ~astray)
    ads = validate.date_window(read_ads(good, now, collect_phone, sources), start, end)
    ad = F.struct("rn", F.col("key"), "own", (F.col("verdict") != "filtered").alias("inw"), F.struct(*RECORD_COLUMNS).alias("ad"))
    found = ads.groupBy("unit_no", "page").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rn", ad.alias("a")))), lambda x: x["a"])).alias("ads"))
    return c.select("unit_no", "page").distinct().join(found, ["unit_no", "page"], "left").select(F.col("unit_no").cast("long").alias("unit"), F.col("page").cast("long").alias("page"), F.coalesce("ads", F.lit("[]")).alias("ads"))


def collect_stream(
    spark: SparkSession, path: str, store: Store, work: str, units: DataFrame, cities: DataFrame, now: datetime, *,
    start: object = None, end: object = None, stale: int = 2, barren: int = 0, most: int | None = None, collect_phone: bool = True, files: int = 100,
) -> tuple[StreamingQuery, StreamingQuery]:
    """Reads what has come to a folder of captures (JSON, ``CAPTURE``), walks the units
    of a plan and stores their ads; both queries have ended when it returns.

    ``work`` holds the pages that were read and the queries' checkpoints: called again
    with it, only new captures are read and the units go on where they were."""
    sources = sorted(r[0] for r in units.select("source").distinct().collect())  # one row a source

    def read(batch: DataFrame, number: int) -> None:
        page_rows(batch, units, cities, sources, now, start, end, collect_phone).write.mode("overwrite").parquet(f"{work}/pages/batch={number}")

    def keep(batch: DataFrame, number: int) -> None:
        record = F.from_json("ad", RECORD)
        rows = batch.filter("inw").select(record.alias("r"), (F.col("unit") * F.lit(1 << 40) + F.col("rn")).alias("seq")).select("r.*", "seq", F.lit(now).cast("timestamp").alias("seen_at"))
        store.ingest(rows, now.date() if isinstance(now, datetime) else date.today())

    captures = spark.readStream.schema(CAPTURE).option("maxFilesPerTrigger", files).json(path)
    first = captures.writeStream.foreachBatch(read).option("checkpointLocation", f"{work}/read").trigger(availableNow=True).start()
    first.awaitTermination()
    pages = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(f"{work}/pages")
    second = walk_stream(pages, stale, barren, most).writeStream.foreachBatch(keep).option("checkpointLocation", f"{work}/walk").trigger(availableNow=True).start()
    second.awaitTermination()
    return first, second
