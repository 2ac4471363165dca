"""Validation with reasons, and date windows."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import strip
from tidemark.schema import SOURCES


def problems(today: date, sources: tuple[str, ...] = SOURCES) -> Column:
    """Array of what is wrong with a record, at most one reason a field."""
    c = F.col
    text = lambda e: e.cast("string")
    checks = [
        F.when(~F.coalesce(c("source").isin(*sources), F.lit(False)), F.concat(F.lit("unknown source '"), F.coalesce("source", F.lit("None")), F.lit("'"))),
        F.when(strip(F.coalesce("city", F.lit(""))) == "", F.lit("city is empty")),
        F.when(strip(F.coalesce("title", F.lit(""))) == "", F.lit("title is empty")).when(F.length("title") > 500, F.lit("title is implausibly long")),
        F.when(~F.coalesce(strip(c("url")).rlike("^https?://"), F.lit(False)), F.concat(F.lit("url is not absolute: '"), F.coalesce("url", F.lit("None")), F.lit("'"))),
        F.when(c("price") < 0, F.concat(F.lit("negative price: "), text(c("price")))).when(c("price") > 1e12, F.concat(F.lit("price out of plausible range: "), text(c("price")))),
        F.when(c("ad_date") > F.lit(today), F.concat(F.lit("ad_date is in the future: "), text(c("ad_date")))).when(F.year("ad_date") < 2005, F.concat(F.lit("ad_date is implausibly old: "), text(c("ad_date")))),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def split_valid(df: DataFrame, today: date, sources: tuple[str, ...] = SOURCES) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects with reasons and the whole row as JSON)."""
    judged = df.withColumn("_reasons", problems(today, sources))
    bad = judged.filter(F.size("_reasons") > 0)
    payload = F.to_json(F.struct(*[F.col(x) for x in df.columns]))
    return judged.filter(F.size("_reasons") == 0).drop("_reasons"), bad.select("source", "url", F.array_join("_reasons", "; ").alias("reasons"), payload.alias("payload"))


def judged(df: DataFrame, today: date, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """``split_valid`` in one frame: adds ``_reasons``, null for valid rows, and ``_payload``, for rejects only."""
    why = F.when(F.size("_reasons") > 0, F.array_join("_reasons", "; "))
    whole = F.when(F.size("_reasons") > 0, F.to_json(F.struct(*[F.col(x) for x in df.columns])))
    return df.withColumn("_reasons", problems(today, sources)).withColumns({"_payload": whole, "_reasons": why})


def to_day(value: date | datetime | str | None) -> date | None:
    """A bound of a window: a date, a moment, ISO text (its first ten
    characters), or nothing."""
    if value is None or value == "":
        return None
    if isinstance(value, datetime):
        return value.date()
    return value if isinstance(value, date) else date.fromisoformat(str(value).strip()[:10])


def date_window(df: DataFrame, start=None, end=None, keep_undated: bool = True, column: str = "ad_date") -> DataFrame:
    """Adds ``verdict``: in, filtered, or undated (no date while they are not kept)."""
    a, b = to_day(start), to_day(end)
    if a and b and a > b:
        raise ValueError("the window ends before it starts")
    d = F.col(column)
    out = F.lit(False)
    if a:
        out = out | (d < F.lit(a))
    if b:
        out = out | (d > F.lit(b))
    open_ = a is None and b is None
    undated = F.lit("in" if keep_undated or open_ else "undated")
    return df.withColumn("verdict", F.when(d.isNull(), undated).when(out, "filtered").otherwise("in"))
