"""Listing-shaped views over order tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as listings of the customer's city."""
    t = lambda n: table(spark, sf_dir, n)
    geo = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("province"))
    c = t("customer").join(geo, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "c_mktsegment", "city", "province")
    d = t("orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    return d.select(
        k.alias("id"), F.lower("c_mktsegment").alias("source"), k.cast("string").alias("source_listing_id"), "city", "province", F.col("o_orderpriority").alias("category"),
        F.concat_ws(" ", "c_name", "o_orderpriority").alias("title"), F.concat(F.lit("Order of "), "c_name", F.lit(" in "), "city").alias("description"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("decimal(18,2)")).alias("price"), F.lit("PKR").alias("price_currency"),
        F.when(k % 3 == 0, F.concat(F.lit("+9230"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"))).alias("phone"), F.when(k % 7 != 0, F.col("o_orderdate").cast("date")).alias("ad_date"),
        F.concat(F.lit("https://example.com/item/"), k.cast("string")).alias("url"), F.col("o_orderdate").alias("first_seen_at"), (F.col("o_orderdate") + F.make_dt_interval((k % 30).cast("int"))).alias("last_seen_at"),
    )


LISTINGS_SQL = """L AS (SELECT o_orderkey AS id, lower(c_mktsegment) AS source, cast(o_orderkey AS varchar) AS source_listing_id, n_name AS city, r_name AS province,
 o_orderpriority AS category, c_name || ' ' || o_orderpriority AS title, 'Order of ' || c_name || ' in ' || n_name AS description,
 CASE WHEN o_orderstatus <> 'P' THEN cast(o_totalprice AS decimal(18,2)) END AS price, 'PKR' AS price_currency,
 CASE WHEN o_orderkey % 3 = 0 THEN '+9230' || lpad(cast(o_custkey AS varchar), 8, '0') END AS phone,
 CASE WHEN o_orderkey % 7 <> 0 THEN cast(o_orderdate AS date) END AS ad_date, 'https://example.com/item/' || o_orderkey AS url,
 o_orderdate AS first_seen_at, o_orderdate + to_days(cast(o_orderkey % 30 AS integer)) AS last_seen_at
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as sightings of their order's ad."""
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("entity"), F.lit("s").alias("source"), seq.cast("long").alias("seq"), F.col("l_shipdate").alias("seen_at"), F.col("l_linestatus").alias("title"),
        F.expr("repeat('x', cast(l_quantity as int))").alias("description"), F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice").cast("decimal(18,2)")).alias("price"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).when(F.col("l_linenumber") % 3 == 0, F.lit("")).alias("phone"), F.concat(F.lit("u"), F.col("l_suppkey").cast("string")).alias("url_canonical"),
    )


SIGHTINGS_SQL = """V AS (SELECT l_orderkey AS entity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS seq,
 l_shipdate AS seen_at, l_linestatus AS title, repeat('x', cast(trunc(l_quantity) AS integer)) AS description, CASE WHEN l_returnflag <> 'N' THEN cast(l_extendedprice AS decimal(18,2)) END AS price,
 CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag WHEN l_linenumber % 3 = 0 THEN '' END AS phone, 'u' || l_suppkey AS url_canonical FROM lineitem)"""


def unit_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the ads of a user's pages, three to a page."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("unit"), rn.cast("long").alias("rn"), F.floor("value").cast("int").alias("key"), F.col("event_type").isin("signup", "view").alias("own"), (F.col("event_type") == "signup").alias("inw"), F.col("event_type").alias("place"))
    return e.withColumn("page", F.floor((F.col("rn") - 1) / 3).cast("long") + 1)


UNITS_SQL = """G AS (SELECT unit, rn, key, own, inw, place, (rn - 1) // 3 + 1 AS page FROM (SELECT user_id AS unit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
 cast(floor(value) AS integer) AS key, event_type IN ('signup', 'view') AS own, event_type = 'signup' AS inw, event_type AS place FROM events)),
F AS (SELECT *, own AND row_number() OVER (PARTITION BY unit, key, own ORDER BY rn) = 1 AS fresh FROM G)"""
