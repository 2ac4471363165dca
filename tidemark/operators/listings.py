"""Filtered search, paging, distinct values, summaries and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import ascii_lower, preview

# Columns that may be sorted by or listed.
SORTABLE = ("id", "source", "city", "category", "title", "price", "ad_date", "first_seen_at", "last_seen_at", "scraped_at")
LISTABLE = ("source", "city", "category", "price_currency")
PAGE = ("id", "source", "source_listing_id", "city", "area", "category", "title", "description", "price", "price_currency", "price_raw", "phone", "seller_name", "ad_date", "url", "first_seen_at", "last_seen_at")


def matches(q: str, *cols: Column) -> Column:
    """Substring in any column; letters A to Z in any case; % and _ in q are
    wildcards, a backslash is itself."""
    pattern = ("%" + q.replace("\\", "\\\\") + "%").translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(ascii_lower(c).like(pattern), F.lit(False))
    return out


def search(df: DataFrame, *, city: str = "", source: str = "", category: str = "", q: str = "", has_phone: bool | None = None, min_price: float | None = None, max_price: float | None = None, since=None, seen_since=None) -> DataFrame:
    """Rows that meet every filter given; empty text and None filter nothing."""
    for name, value in (("city", city), ("source", source), ("category", category)):
        if value:
            df = df.filter(F.col(name) == value)
    if q:
        df = df.filter(matches(q, F.col("title"), F.col("description")))
    if has_phone is not None:
        df = df.filter(F.col("phone").isNotNull() if has_phone else F.col("phone").isNull())
    if min_price is not None:
        df = df.filter(F.col("price") >= min_price)
    if max_price is not None:
        df = df.filter(F.col("price") <= max_price)
    return seen(df, since, seen_since)


def seen(df: DataFrame, since=None, seen_since=None) -> DataFrame:
    if since is not None:
        df = df.filter(F.col("first_seen_at") >= F.lit(since))
    if seen_since is not None:
        df = df.filter(F.col("last_seen_at") >= F.lit(seen_since))
    return df


def page(df: DataFrame, sort: str = "last_seen_at", descending: bool = True, limit: int = 50, offset: int = 0, most: int = 500) -> DataFrame:
    """One page; unknown sort columns fall back; ties by id, newest first; nulls
    sort lowest."""
    c = F.col(sort if sort in SORTABLE else "last_seen_at")
    order = c.desc_nulls_last() if descending else c.asc_nulls_first()
    return df.orderBy(order, F.col("id").desc()).offset(max(0, offset)).limit(max(1, min(limit, most)))


def envelope(df: DataFrame, number: int, size: int) -> DataFrame:
    """(page, page_size, total, pages) of a filtered result."""
    size = max(1, min(size, 200))
    total = F.count(F.lit(1))
    return df.agg(F.lit(number).cast("long").alias("page"), F.lit(size).cast("long").alias("page_size"), total.alias("total"), F.greatest(F.lit(1), F.ceil(total / size)).cast("long").alias("pages"))


def all_listings(df: DataFrame, city: str = "", since=None, seen_since=None) -> DataFrame:
    df = search(df, city=city, since=since, seen_since=seen_since)
    return df.orderBy("city", "source", F.col("ad_date").desc_nulls_last(), F.col("id").desc())


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    if column not in LISTABLE:
        raise ValueError(f"{column} cannot be listed")
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def cities_present(df: DataFrame, since=None, seen_since=None) -> DataFrame:
    return seen(df, since, seen_since).select("city").distinct().orderBy("city")


def summary_by_city(df: DataFrame, since=None, seen_since=None) -> DataFrame:
    """Counts, truncated mean price and date range by city and source."""
    return (
        seen(df, since, seen_since)
        .groupBy("city", "source")
        .agg(F.count(F.lit(1)).alias("listings"), F.count("price").alias("with_price"), F.count("phone").alias("with_phone"), F.avg("price").cast("long").alias("avg_price"), F.min("ad_date").alias("oldest_ad"), F.max("ad_date").alias("newest_ad"))
        .orderBy("city", "source")
    )


def totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("listings"), F.count("price").alias("with_price"), F.count("phone").alias("with_phone"), F.countDistinct("city").alias("cities"), F.countDistinct("source").alias("sources"))


def counts_since(df: DataFrame, moment) -> DataFrame:
    new, all_ = F.count_if(F.col("first_seen_at") >= F.lit(moment)), F.count_if(F.col("last_seen_at") >= F.lit(moment))
    return df.agg(new.alias("new"), all_.alias("total_seen"), (all_ - new).alias("refreshed"))


def footer(summary: DataFrame) -> DataFrame:
    """A summary with its total in the last row."""
    total = summary.agg(F.lit("TOTAL").alias("city"), F.lit("").alias("source"), F.sum("listings").alias("listings"), F.sum("with_price").alias("with_price"), F.sum("with_phone").alias("with_phone"))
    return summary.select("city", "source", "listings", "with_price", "with_phone").unionByName(total)


def api_rows(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in PAGE if c in df.columns])


def export_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("description_preview", preview(F.col("description")))


def lookup(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per wanted (fingerprint, source, url_canonical) the stored id: by
    fingerprint, else by source and URL."""
    a = existing.select("fingerprint", F.col("id").alias("by_print"))
    b = existing.select("source", "url_canonical", F.col("id").alias("by_url"))
    return wanted.join(a, "fingerprint", "left").join(b, ["source", "url_canonical"], "left").withColumn("id", F.coalesce("by_print", "by_url")).drop("by_print", "by_url")


def map_of_counts(df: DataFrame, key: str, count: str) -> DataFrame:
    return df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, count)))).alias("counts"))


def percent(done: Column, total: Column) -> Column:
    """Half to even, 0 where there is nothing to do."""
    return F.coalesce(F.bround(F.try_divide(100 * done, total), 0), F.lit(0)).cast("long")


def newest(df: DataFrame, by: str, n: int) -> DataFrame:
    return df.orderBy(F.col(by).desc()).limit(n)


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key; other rows go."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
