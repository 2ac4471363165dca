"""Where a unit of pages stops: the sequential rules as windows.

Input rows are the ads of a unit's pages in order: unit, page, rn (order in the
unit), key, own (the ad is from the city asked for), inw (inside the date
window; only for the barren rule).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bounded import before


def dedup(ads: DataFrame) -> DataFrame:
    """The first sighting of each key in a unit."""
    w = Window.partitionBy("unit", "key").orderBy("rn")
    return ads.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def limit(ads: DataFrame, n: int | None) -> DataFrame:
    """The first n ads of each unit; 0 and None keep all."""
    if not n:
        return ads
    w = Window.partitionBy("unit").orderBy("rn")
    return ads.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def fresh(ads: DataFrame) -> DataFrame:
    """Adds ``fresh``: an own ad that the unit has not shown before."""
    w = Window.partitionBy("unit", "key", "own").orderBy("rn")
    return ads.withColumn("fresh", F.col("own") & (F.row_number().over(w) == 1))


def _stale_ends(pages: DataFrame, patience: int) -> DataFrame:
    """(unit, cut): the page that is the ``patience``-th stale one in a row."""
    pages = pages.withColumn("_island", F.sum((~F.col("stale")).cast("int")).over(Window.partitionBy("unit").orderBy("page")))
    length = F.count_if("stale").over(Window.partitionBy("unit", "_island").orderBy("page"))
    return pages.withColumn("_len", length).filter(F.col("stale") & (F.col("_len") >= patience)).groupBy("unit").agg(F.min("page").alias("cut"))


def _barren_ends(pages: DataFrame, patience: int) -> DataFrame:
    """(unit, cut): the page that is the ``patience``-th with nothing in the window
    (n = 0) in a row; stale pages neither count nor end a row."""
    live = pages.filter("not stale")
    live = live.withColumn("_island", F.sum((F.col("n") > 0).cast("int")).over(Window.partitionBy("unit").orderBy("page")))
    live = live.withColumn("_len", F.count_if(F.col("n") == 0).over(Window.partitionBy("unit", "_island").orderBy("page")))
    return live.filter((F.col("n") == 0) & (F.col("_len") >= patience)).groupBy("unit").agg(F.min("page").alias("cut"))


def _by_page(ads: DataFrame) -> DataFrame:
    n = F.count_if(F.col("own") & F.col("inw")) if "inw" in ads.columns else F.lit(1)
    return ads.groupBy("unit", "page").agg((~F.bool_or("fresh")).alias("stale"), n.alias("n"))


def stale_stop(ads: DataFrame, patience: int = 2) -> DataFrame:
    """Fresh ads of the pages before ``patience`` pages in a row had none."""
    f = fresh(ads)
    cut = _stale_ends(_by_page(f), patience)
    return f.join(cut, "unit", "left").filter(F.col("fresh") & (F.col("cut").isNull() | (F.col("page") < F.col("cut")))).drop("fresh", "cut")


def barren_stop(ads: DataFrame, patience: int) -> DataFrame:
    """Fresh ads up to the page at which ``patience`` pages in a row, stale
    pages aside, had nothing in the window; 0 turns the rule off."""
    f = fresh(ads)
    if not patience:
        return f.filter("fresh").drop("fresh")
    cut = _barren_ends(_by_page(f), patience)
    return f.join(cut, "unit", "left").filter(F.col("fresh") & (F.col("cut").isNull() | (F.col("page") <= F.col("cut")))).drop("fresh", "cut")


def walk(pages: DataFrame, ads: DataFrame, *, stale: int = 2, barren: int = 0, most: int | None = None, places: int = 5) -> tuple[DataFrame, DataFrame]:
    """Every unit read page by page until a rule ends it: the ads that come out of
    it, and what was seen on the way, one row a unit that has pages.

    pages: unit, page and n, the ads on it; the first page without ads ends a unit
    and is not counted.  A page is read to its end once it has been begun, but for
    the ``most``-th ad in the window, after which nothing is read.  Ads that come
    out are fresh (``fresh``); those outside the window are among them, with inw
    false.  pages_read is the last page that had a fresh ad; foreign ads of stale
    pages count, those of pages that were never reached do not.
    """
    end = pages.filter("n = 0").groupBy("unit").agg(F.min("page").alias("_end"))
    f = fresh(ads.join(end, "unit", "left").filter(F.col("_end").isNull() | (F.col("page") < F.col("_end"))).drop("_end"))
    each = _by_page(f)
    cut = _stale_ends(each, stale)
    if barren:
        cut = cut.union(_barren_ends(each, barren))
    f = f.join(cut.groupBy("unit").agg(F.min("cut").alias("_cut")), "unit", "left").filter(F.col("_cut").isNull() | (F.col("page") <= F.col("_cut"))).drop("_cut")
    none = F.lit(None).cast("long")
    f = f.withColumns({"_stop": none, "_stop_page": none})
    if most:
        upto = Window.partitionBy("unit").orderBy("rn")
        made = F.count_if(F.col("fresh") & F.col("inw")).over(upto)
        spent = f.withColumn("_made", made).filter(F.col("fresh") & F.col("inw") & (F.col("_made") == most)).select("unit", F.col("rn").alias("_r"), F.col("page").alias("_p"))
        f = f.join(spent, "unit", "left").withColumns({"_stop": F.col("_r").cast("long"), "_stop_page": F.col("_p").cast("long")}).drop("_r", "_p")
    reached = F.col("_stop").isNull() | (F.col("page") <= F.col("_stop_page"))
    out = F.col("fresh") & (F.col("_stop").isNull() | (F.col("rn") <= F.col("_stop")))
    seen = f.filter(reached)
    sums = seen.groupBy("unit").agg(
        F.coalesce(F.max(F.when(F.col("fresh"), F.col("page"))), F.lit(0)).cast("long").alias("pages_read"), F.count_if(~F.col("own")).alias("foreign_ads"), F.count_if(out & F.col("inw")).alias("produced"),
        F.count_if(out & ~F.col("inw")).alias("out_of_window"), F.bool_or(F.col("_stop").isNotNull()).alias("budget_spent"), F.max("page").cast("long").alias("last_page"),
    )
    units = pages.groupBy("unit").agg(F.min_by("n", "page").alias("_first")).join(sums, "unit", "left").join(_first_places(seen, places), "unit", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("pages_read", "foreign_ads", "produced", "out_of_window", "last_page")}
    units = units.withColumns(zero | {"budget_spent": F.coalesce("budget_spent", F.lit(False)), "foreign_places": F.coalesce("foreign_places", F.array().cast("array<string>")), "no_ads": F.col("_first") == 0}).drop("_first")
    return f.filter(out).drop("_stop", "_stop_page"), units


def page_cap(ads: DataFrame, cap: int | None = None, hard: int = 20_000) -> DataFrame:
    return ads.filter(F.col("page") <= min(cap or hard, hard))


def empty_stop(pages: DataFrame) -> DataFrame:
    """Pages before the first with no ads or that was not found (n = 0)."""
    cut = pages.filter("n = 0").groupBy("unit").agg(F.min("page").alias("cut"))
    return pages.join(cut, "unit", "left").filter(F.col("cut").isNull() | (F.col("page") < F.col("cut"))).drop("cut")


def run_cap(units: DataFrame, cap: int, order: str = "unit_no", stored: str = "stored") -> DataFrame:
    """Units that run: those before which fewer than ``cap`` rows were stored."""
    return before(units, [order], stored, "_before").filter(F.col("_before") < cap).drop("_before")


def carry_forward(df: DataFrame, column: str, order: str, by: list[str] | None = None) -> Column:
    """The last value seen so far."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def _first_places(ads: DataFrame, places: int) -> DataFrame:
    """(unit, foreign_places): the first few different ones in the order they came."""
    first = ads.filter(~F.col("own") & F.col("place").isNotNull()).groupBy("unit", "place").agg(F.min("rn").alias("rn"))
    first = first.withColumn("_r", F.row_number().over(Window.partitionBy("unit").orderBy("rn", "place"))).filter(F.col("_r") <= places)
    return first.groupBy("unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "place"))), lambda s: s["place"]).alias("foreign_places"))


def coverage(ads: DataFrame, places: int = 5) -> DataFrame:
    """Per unit: pages read, own and foreign ads, ads out of the window, and the
    first few different foreign places in the order they came."""
    sums = ads.groupBy("unit").agg(F.countDistinct("page").alias("pages_read"), F.count_if("own").alias("own_ads"), F.count_if(~F.col("own")).alias("foreign_ads"), F.count_if(F.col("own") & ~F.col("inw")).alias("out_of_window"))
    return sums.join(_first_places(ads, places), "unit", "left").withColumn("foreign_places", F.coalesce("foreign_places", F.array().cast("array<string>")))


def outcome(units: DataFrame) -> DataFrame:
    """Status of each unit from resolved, unsupported and failed flags; a unit
    that robots rules stop on a later page has failed and stores nothing."""
    status = F.when(F.col("error") != "", "failed").when(F.col("unsupported") != "", "unsupported").otherwise("completed")
    return units.withColumns({"status": status, "reason": F.coalesce(F.nullif("error", F.lit("")), F.nullif("unsupported", F.lit("")), F.lit(""))}).withColumn("listings", F.when(F.col("status") == "completed", F.col("listings")).otherwise(F.lit(0)))


def next_pages(base: Column, first: int, last: int, pattern: str) -> Column:
    """URLs of pages first..last; page 1 is the plain URL."""
    return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda p: F.when(p == 1, base).otherwise(F.concat(base, F.format_string(pattern, p))))


# How the sources address a page of a city's category.
ADDRESSES = {"olx": "%1$s/%2$s/%3$s/?page=%4$s", "pakwheels": "%1$s/%3$s/ct_%2$s/?page=%4$s", "zameen": "%1$s/%3$s/%2$s-%4$s.html"}
#: Sources whose first page has a plain address.
PLAIN_FIRST = ("olx",)


def index_url(source: Column, base: Column, identifier: Column, path: Column, page: Column) -> Column:
    """The address of a page; null for other sources, or where a part is unknown."""
    out = F.lit(None).cast("string")
    for name, pattern in ADDRESSES.items():
        url = F.format_string(pattern, base, identifier, path, page.cast("string"))
        if name in PLAIN_FIRST:
            url = F.when(page == 1, F.regexp_replace(url, r"\?page=1$", "")).otherwise(url)
        out = F.when(source == name, url).otherwise(out)
    known = base.isNotNull() & identifier.isNotNull() & path.isNotNull() & page.isNotNull()
    return F.when(known, out)
