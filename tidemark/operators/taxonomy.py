"""Category trees and sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import humanize
from tidemark.operators.places import SITEMAP_HOST


def flatten_tree(states: DataFrame, column: str = "state", depth: int = 12) -> DataFrame:
    """Nodes of a category tree in pre-order, as (key, label, path,
    category_id, group, level, priority); each id once, the first wins; keys
    that two ids share get the id appended and the group in the label.

    Levels unnest one at a time with plain generators, so the tree is walked in
    the JVM; the path of positions is the pre-order."""
    node = "struct<name:string,slug:string,externalID:string,displayPriority:long,children:string>"
    level = states.select(F.posexplode(F.from_json(F.get_json_object(column, "$.categories.data"), f"array<{node}>")).alias("p", "n")).filter("coalesce(n.name, '') <> ''")
    level = level.select(F.array(F.col("p")).alias("at"), F.col("n.name").alias("group"), F.lit(0).alias("level"), "n")
    out = level
    for k in range(1, depth):
        level = level.filter("n.children is not null").select("at", "group", F.posexplode(F.from_json("n.children", f"array<{node}>")).alias("p", "m")).filter("m is not null").select(F.concat("at", F.array("p")).alias("at"), "group", F.lit(k).alias("level"), F.col("m").alias("n"))
        out = out.unionByName(level)
    got = out.filter("coalesce(n.slug, '') <> '' and coalesce(n.externalID, '') <> '' and coalesce(n.name, '') <> ''")
    rows = got.select("at", F.lower("n.slug").alias("key"), F.col("n.name").alias("label"), F.concat(F.col("n.slug"), F.lit("_c"), F.col("n.externalID")).alias("path"), F.col("n.externalID").alias("category_id"), "group", "level", F.coalesce("n.displayPriority", F.lit(0)).alias("priority"))
    return tell_apart(first_by_id(rows, "category_id", "at")).drop("at")


def first_by_id(df: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    one = df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return one.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def tell_apart(df: DataFrame) -> DataFrame:
    shared = F.count(F.lit(1)).over(Window.partitionBy("key")) > 1
    named = F.when((F.coalesce("group", F.lit("")) != "") & (F.col("group") != F.col("label")), F.concat("label", F.lit(" ("), "group", F.lit(")"))).otherwise(F.col("label"))
    return df.withColumn("_s", shared).withColumns({"key": F.when(F.col("_s"), F.concat("key", F.lit("-c"), "category_id")).otherwise(F.col("key")), "label": F.when(F.col("_s"), named).otherwise(F.col("label"))}).drop("_s")


def shortest(c: Column) -> Column:
    """The canonical slug: the shortest, then the first."""
    return F.min_by(c, F.struct(F.length(c), c))


def sitemap_categories(pages: DataFrame, text: str = "text", host: str = SITEMAP_HOST) -> DataFrame:
    """Categories of a sitemap: one slug an id; slugs that ids share get it."""
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(rf"(?i){host}/([a-z0-9\-]+_c\d+)"), F.lit(1)))
    d = pages.select(found.alias("m")).select(F.lower(F.regexp_extract("m", r"(?i)^(.*)_c\d+$", 1)).alias("slug"), F.regexp_extract("m", r"(?i)_c(\d+)$", 1).cast("long").alias("id"))
    d = d.groupBy("id").agg(shortest(F.col("slug")).alias("slug"))
    d = d.withColumn("_s", F.count(F.lit(1)).over(Window.partitionBy("slug")) > 1)
    tail = F.concat(F.lit("c"), F.col("id").cast("string"))
    return d.select(F.when(F.col("_s"), F.concat_ws("-", "slug", tail)).otherwise(F.col("slug")).alias("key"), F.when(F.col("_s"), F.concat(humanize(F.col("slug")), F.lit(" ("), tail, F.lit(")"))).otherwise(humanize(F.col("slug"))).alias("label"), F.concat_ws("_", "slug", tail).alias("path"), F.col("id").cast("string").alias("category_id"), F.lit("Other").alias("group"), F.lit(1).alias("level"), F.lit(0).alias("priority"))


def merge_curated(synced: DataFrame, curated: DataFrame) -> DataFrame:
    """All synced categories, flagged where curated has their id; then the
    curated ones whose id was not synced."""
    flag = curated.filter("category_id is not null").select("category_id").distinct().withColumn("curated", F.lit(True))
    a = synced.join(flag, "category_id", "left").withColumn("curated", F.coalesce("curated", F.lit(False)))
    b = curated.join(synced.select("category_id"), "category_id", "left_anti").withColumn("curated", F.lit(True))
    return a.unionByName(b, allowMissingColumns=True)
