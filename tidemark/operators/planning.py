"""Units of work: cities times categories of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bounded import before, small
from tidemark.operators.places import find_city


def unknown(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return asked.join(known.select(key), key, "left_anti")


def require_known(asked: DataFrame, known: DataFrame, key: str, what: str) -> None:
    rows = sorted(r[0] for r in unknown(asked, known, key).limit(20).collect())
    if rows:
        raise ValueError(f"unknown {what}: {', '.join(rows)}")


def choose_cities(cities: DataFrame, only: list[str] | None = None) -> DataFrame:
    """The enabled cities, or those that names or aliases ask for, enabled or
    not, in list order; raises for names that no city has.  The result's enabled
    is true throughout."""
    if not only:
        return cities.filter("enabled")
    asked = cities.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(only)], "asked string")
    found = find_city(cities, asked).collect()  # one row a name asked for
    missing = sorted(r.asked.strip() for r in found if r.name is None)
    if missing:
        raise ValueError(f"unknown cities: {', '.join(missing)}")
    return cities.filter(F.col("name").isin([r.name for r in found])).withColumn("enabled", F.lit(True))


def plan_units(cities: DataFrame, categories: DataFrame, selections: dict[str, list[str]] | None = None, sources: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """(unit_no, city, source, category) in city order.

    cities: name, pos, enabled.  categories: source, key, pos, enabled (of the
    source).  selections maps sources to category keys, an empty list to all of
    them, and skips disabled sources; the flat lists apply to all sources, and
    naming a source uses it even if disabled.  Unknown keys select nothing.
    Cities and categories are configuration, so their product is bounded."""
    spark = cities.sparkSession
    low = F.lower("key")
    if selections is not None:
        require_known(spark.createDataFrame([(s,) for s in selections] or [], "source string"), categories.distinct(), "source", "sources")
        rows = [(s, i, k.strip().lower()) for i, (s, ks) in enumerate(selections.items()) for k in (ks or ["*"])]
        want = spark.createDataFrame(rows, "source string, _s int, _k string")
        chosen = categories.filter("enabled").join(small(want, 100_000, "selected categories"), "source").filter((F.col("_k") == "*") | (low == F.col("_k"))).dropDuplicates(["source", "key"])
    else:
        chosen = categories.filter(F.col("source").isin([s.strip().lower() for s in sources])) if sources else categories.filter("enabled")
        chosen = chosen.filter(low.isin([k.strip().lower() for k in keys])) if keys else chosen
        chosen = chosen.withColumn("_s", F.lit(0))
    c = cities.filter("enabled").select(F.col("name").alias("city"), F.col("pos").alias("_c"))
    units = c.crossJoin(small(chosen.select("source", F.col("key").alias("category"), "_s", F.col("pos").alias("_k")), 100_000, "categories"))
    units = before(units.withColumn("_one", F.lit(1)), ["_c", "_s", "_k", "city", "source", "category"], "_one", "_n")
    return units.select((F.col("_n") + 1).cast("long").alias("unit_no"), "city", "source", "category")
