"""Captured pages: cache reads with a time to live, and writes keyed by URL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.urls import cache_name
from tidemark.schema import CAPTURES


def read_cache(spark: SparkSession, path: str, now: datetime, ttl_hours: float = 24, enabled: bool = True) -> DataFrame:
    """Entries younger than the time to live; corrupt ones are left out."""
    d = spark.read.schema(CAPTURES + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    d = d.filter(F.col("url").isNotNull() & F.col("fetched_at").isNotNull()).drop("_corrupt")
    young = F.col("fetched_at") > F.lit(now) - F.expr(f"INTERVAL {int(ttl_hours * 3600)} SECONDS")
    return d.filter(young if enabled else F.lit(False))


def write_cache(captures: DataFrame, path: str) -> None:
    captures.withColumn("name", cache_name(F.col("url"))).write.mode("append").json(path)


def peek(captures: DataFrame, chars: int = 65536) -> DataFrame:
    """The head of each page, up to the end of its title."""
    head = F.substring("text", 1, chars)
    at = F.instr(F.lower(head), F.lit("</title>"))
    return captures.withColumn("text", F.when(at > 0, F.substring(head, F.lit(1), at + 7)).otherwise(head))


def allowed(captures: DataFrame) -> DataFrame:
    """Pages that robots rules allow; no rule allows."""
    return captures.filter(F.coalesce("allowed", F.lit(True)))


def probes(df: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """Probe results, found or not, that are still good."""
    return df.filter(F.col("at") > F.lit(now) - F.expr(f"INTERVAL {days} DAYS"))


def readable(captures: DataFrame) -> DataFrame:
    return captures.filter(F.coalesce("status", F.lit(200)) == 200)
