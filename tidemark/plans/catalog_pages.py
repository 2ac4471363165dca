"""Queries over pages made from the tables: readers of index and detail pages,
dimension files and the places that they fill."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import blobs, phone, text
from tidemark.operators import crawlcut, pages, places, planning
from tidemark.plans.catalog import NOW, query
from tidemark.plans.views import table
from tidemark.session import work_folder
from tidemark.sources import captures, dims


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _captures(d, ident: Column, body: Column, base: str = "https://site.example"):
    return d.select(_say("https://site.example/p/", ident).alias("url"), body.alias("text"), F.lit(base).alias("base_url"), F.lit("Town").alias("city"), F.lit("Things").alias("category"))


# ---------------------------------------------------------------- page cache


@query("SELECT page_id, length(t)::BIGINT AS n, md5(t) AS head FROM (SELECT page_id, CASE WHEN instr(lower(substr(html, 1, 65536)), '</title>') > 0 THEN substr(html, 1, instr(lower(substr(html, 1, 65536)), '</title>') + 7) ELSE substr(html, 1, 65536) END AS t FROM pages)")
def page_peek(spark, d):
    p = captures.peek(table(spark, d, "pages").select("page_id", F.col("html").alias("text")))
    return p.select("page_id", F.length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("head"))


@query("SELECT url, length(html)::BIGINT AS n FROM pages WHERE page_id % 48 < 24")
def cache_round_trip(spark, d):
    """Cached for page_id modulo 48 hours, with a day to live."""
    hours = F.make_dt_interval(hours=(F.col("page_id") % 48).cast("int"))
    c = table(spark, d, "pages").select("url", F.lit(200).alias("status"), F.col("html").alias("text"), (F.lit(NOW) - hours).alias("fetched_at"))
    at = work_folder(spark, "cache")
    captures.write_cache(c, at)
    return captures.read_cache(spark, at, NOW).select("url", F.length("text").cast("long").alias("n"))


@query("SELECT page_id FROM pages WHERE page_id % 3 <> 1")
def robots_allowed(spark, d):
    k = F.col("page_id") % 3
    return captures.allowed(table(spark, d, "pages").select("page_id", F.when(k == 0, True).when(k == 1, False).alias("allowed"))).select("page_id")


@query("SELECT page_id FROM pages WHERE page_id % 60 < 30")
def probes_still_good(spark, d):
    at = F.lit(NOW) - F.make_dt_interval(days=(F.col("page_id") % 60).cast("int"))
    return captures.probes(table(spark, d, "pages").select("page_id", at.alias("at")), NOW).select("page_id")


# --------------------------------------------------------------- index pages


@query("""SELECT cast(o_orderkey AS varchar) AS source_listing_id, 'Car & ' || o_orderkey AS title, cast(o_totalprice AS decimal(18,2)) AS price, cast(o_orderdate AS date) AS ad_date,
 'https://site.example/item/car-' || o_orderkey || '-iid-' || o_orderkey AS url, 'Area ' || (o_orderkey % 10) AS area, 'Town,Area ' || (o_orderkey % 10) AS located_in, o_custkey::varchar AS seller_name FROM orders""")
def state_index(spark, d):
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    hit = _say('{"externalID":"', k, '","title":"<b>Car</b> &amp; ', k, '","slug":"car-', k, '","description":"d","extraFields":{"price":"', F.col("o_totalprice").cast("decimal(18,2)"), '"},"createdAt":"', day, '","contactInfo":{"name":" ', F.col("o_custkey"), ' "},"location":[{"level":1,"name":"P"},{"level":2,"name":"Town"},{"level":3,"name":"Area ', k % 10, '"}]}')
    page = _say('<script>window.state = {"algolia":{"content":{"hits":[', hit, "]}}};</script>")
    r = pages.olx_index(_captures(table(spark, d, "orders"), k, page), NOW)
    return r.select("source_listing_id", "title", F.col("price").cast("decimal(18,2)").alias("price"), "ad_date", "url", "area", F.array_join("located_in", ",").alias("located_in"), "seller_name")


@query("SELECT cast(o_orderkey AS varchar) AS source_listing_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Shown ' || o_orderkey ELSE 'Big Car' END AS title, 'https://site.example/item/big-car-iid-' || o_orderkey AS url FROM orders")
def anchor_fallback(spark, d):
    k = F.col("o_orderkey")
    shown = F.when(k % 2 == 0, _say("<i>Shown</i> ", k)).otherwise("")
    page = _say('<a href="/other">no</a><a class="x" href="/item/big-car-iid-', k, '">', shown, '</a><a href="/item/big-car-iid-', k, '">again</a>')
    return pages.olx_index(_captures(table(spark, d, "orders"), k, page), NOW).select("source_listing_id", "title", "url")


@query("SELECT cast(100000 + o_orderkey AS varchar) AS source_listing_id, 'Car ' || o_orderkey AS title, CASE WHEN o_orderkey % 2 = 0 THEN cast(o_totalprice AS decimal(18,2)) END AS price, 'new town' AS located_in FROM orders")
def price_by_url(spark, d):
    k = F.col("o_orderkey")
    url = _say("/used-cars/car-for-sale-in-new-town-", 100000 + k)
    ld = _say('<script type="application/ld+json">[{"@type":"Product","offers":{"url":"https://site.example', url, '/","price":', F.col("o_totalprice").cast("decimal(18,2)"), "}}]</script>")
    page = _say('<a class="car-name" title="Car ', k, '" href="', url, '">x</a><a href="/used-cars/other-99999">plain</a>', F.when(k % 2 == 0, ld).otherwise(""))
    r = pages.pakwheels_index(_captures(table(spark, d, "orders"), k, page), NOW)
    return r.select("source_listing_id", "title", F.col("price").cast("decimal(18,2)").alias("price"), F.array_join("located_in", ",").alias("located_in"))


@query("SELECT cast(100000 + o_orderkey AS varchar) AS source_listing_id, CASE WHEN o_orderkey % 2 = 0 THEN 'House' ELSE 'Zameen listing ' || (100000 + o_orderkey) END AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'Town' ELSE '' END AS located_in FROM orders")
def property_index(spark, d):
    k = F.col("o_orderkey")
    n = 100000 + k
    where = F.when(k % 3 == 0, _say('<script>window.state = {"algolia":{"content":{"hits":[{"externalID":"', n, '","location":[{"level":2,"name":"Town"}]}]}}};</script>')).otherwise("")
    page = _say('<a href="https://elsewhere.example/Property/x-123456-1.html">no</a><a href="/Property/house-', n, '-7.html"', F.when(k % 2 == 0, ' title="House"').otherwise(""), "></a>", where)
    r = pages.zameen_index(_captures(table(spark, d, "orders"), k, page), NOW)
    return r.select("source_listing_id", "title", F.array_join("located_in", ",").alias("located_in"))


# -------------------------------------------------------------- detail pages


def _stub(d, ident: Column, source: str):
    none = F.lit(None).cast("string")
    return d.select(F.lit(source).alias("source"), none.alias("source_listing_id"), F.lit("Town").alias("city"), F.lit("").alias("area"), F.lit("c").alias("category"), F.lit("Stub").alias("title"), F.lit("short").alias("description"), F.lit(None).cast("decimal(38,6)").alias("price"), F.lit("PKR").alias("price_currency"), F.lit("").alias("price_raw"), none.alias("phone"), none.alias("seller_name"), F.lit(None).cast("date").alias("ad_date"), _say("https://site.example/p/", ident).alias("url"))


@query("SELECT 'https://site.example/p/' || o_orderkey AS url, CASE WHEN o_orderkey % 3 = 0 THEN 'Stub' ELSE 'Car ' || o_orderkey END AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'short' ELSE 'Long text ' || o_orderkey END AS description, CASE WHEN o_orderkey % 3 = 1 THEN cast(o_totalprice AS decimal(18,2)) END AS price FROM orders")
def state_detail(spark, d):
    """A third of the pages has the ad in its state, a third in JSON-LD, a third nothing."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    state = _say('<script>window.state = {"ad":{"data":{"title":"Car ', k, '","description":"Long text ', k, '","extraFields":{"price":"', F.col("o_totalprice").cast("decimal(18,2)"), '"}}}};</script>')
    ld = _say('<script type="application/ld+json">{"@type":"Product","name":"Car ', k, '","description":"Long text ', k, '"}</script>')
    page = F.when(k % 3 == 1, state).when(k % 3 == 2, ld).otherwise("<p>nothing</p>")
    det = pages.details(_captures(o, k, page), "olx", NOW)
    return pages.complete(_stub(o, k, "olx"), det, "olx").select("url", "title", "description", F.col("price").cast("decimal(18,2)").alias("price"))


@query("SELECT 'https://site.example/p/' || o_orderkey AS url, cast(o_orderkey AS varchar) AS source_listing_id, cast(o_orderdate AS date) AS ad_date, 'Seller ' || (o_orderkey % 7) AS seller_name FROM orders")
def spec_table_detail(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    page = _say('<ul id="scroll_car_detail"><li>Ad Ref # ', k, "</li><li>Last Updated: ", F.date_format("o_orderdate", "MMM d, yyyy"), '</li></ul><div class="owner-detail-main"><h5>Seller ', k % 7, "</h5></div>")
    det = pages.details(_captures(o, k, page), "pakwheels", NOW)
    return pages.complete(_stub(o, k, "pakwheels"), det, "pakwheels").select("url", "source_listing_id", "ad_date", "seller_name")


@query("SELECT 'https://site.example/p/' || o_orderkey AS url, CASE WHEN o_orderkey % 2 = 0 THEN '+923' || lpad(cast(o_custkey + 12000456 AS varchar), 9, '0') END AS phone, 'Block ' || (o_orderkey % 5) AS area, cast(o_orderdate AS date) AS ad_date FROM orders")
def property_detail(spark, d):
    """Every other page wants a login before it shows a number."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    number = F.concat(F.lit("03"), F.lpad((F.col("o_custkey") + 12000456).cast("string"), 9, "0"))
    page = _say('<script>window.state = {"property":{"data":{"requiresLoginForContact":', F.when(k % 2 == 0, "false").otherwise("true"), ',"mobilePhoneNumber":"', number, '","location":[{"level":3,"name":"Block ', k % 5, '"}],"createdAt":"', F.date_format("o_orderdate", "yyyy-MM-dd"), '"}}};</script>')
    det = pages.details(_captures(o, k, page), "zameen", NOW)
    return pages.complete(_stub(o, k, "zameen"), det, "zameen").select("url", "phone", "area", "ad_date")


@query("SELECT o_orderkey, o_orderkey % 160 < 80 AS needs, NOT o_orderdate > TIMESTAMP '1997-06-08 00:00:00' AS stale FROM orders")
def detail_wanted(spark, d):
    from datetime import datetime

    o = table(spark, d, "orders").select("o_orderkey", F.expr("repeat('x', cast(o_orderkey % 160 as int))").alias("description"), F.col("o_orderdate").alias("scraped_at"))
    return o.select("o_orderkey", pages.needs_detail().alias("needs"), pages.stale_detail(datetime(1997, 6, 15)).alias("stale"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '+923001234567' WHEN 1 THEN '+923' || lpad(cast(c_custkey + 12000456 AS varchar), 9, '0') END AS phone FROM customer")
def phone_policy(spark, d):
    k = F.col("c_custkey") % 3
    said = F.when(k == 1, _say("call 03", F.lpad((F.col("c_custkey") + 12000456).cast("string"), 9, "0"))).otherwise("no number")
    return table(spark, d, "customer").select("c_custkey", phone.phone_policy(F.when(k == 0, "+923001234567"), [F.lit("text"), said]).alias("phone"))


@query("SELECT o_orderkey, 3 AS parts, 'Car ' || o_orderkey AS name FROM orders")
def jsonld_parts(spark, d):
    k = F.col("o_orderkey")
    page = _say('<script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":["Thing","Car"],"name":"Car ', k, '"}]}</script><script type="application/ld+json">{broken</script>')
    ld = blobs.jsonld(F.col("text"))
    p = table(spark, d, "orders").select("o_orderkey", page.alias("text")).withColumn("ld", ld)
    return p.select("o_orderkey", F.size("ld").alias("parts"), F.get_json_object(blobs.jsonld_of_type(F.col("ld"), "Product", "Car"), "$.name").alias("name"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'first ' || o_orderkey WHEN 1 THEN 'second' ELSE '' END AS said FROM orders")
def first_text_of(spark, d):
    k = F.col("o_orderkey")
    page = F.when(k % 3 == 0, _say("<b><i>first</i> ", k, "</b><u>second</u>")).when(k % 3 == 1, "<b> </b><u>second</u>").otherwise("<p>none</p>")
    return table(spark, d, "orders").select("o_orderkey", pages.first_text(page, "(?s)<b>(.*?)</b>", "(?s)<u>(.*?)</u>").alias("said"))


# --------------------------------------------------------------------- places


@query("SELECT n_name AS name, 'X-' || n_nationkey AS identifier, CASE n_nationkey % 2 WHEN 0 THEN 'Punjab' END AS province FROM nation")
def state_city_list(spark, d):
    k = F.col("n_nationkey")
    page = _say('<script>window.state = {"cities":{"data":[{"name":"', F.col("n_name"), '","slug":"/X-', k, '","parentID":"', F.when(k % 2 == 0, "1522").otherwise("0"), '"},{"name":"","slug":"/no"}]}};</script>')
    return places.state_cities(table(spark, d, "nation").select(page.alias("text"))).select("name", "identifier", "province")


_GAZETTEER = """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'Chak ' || c_custkey WHEN 1 THEN 'Green Housing Society ' || c_custkey WHEN 2 THEN 'Fata' ELSE 'Town ' || c_custkey END AS name,
 CASE WHEN c_custkey % 5 = 0 THEN 'PPLA' ELSE 'PPL' END AS code, CASE WHEN c_custkey % 11 = 0 THEN 'IN' ELSE 'PK' END AS country, CASE WHEN c_custkey % 2 = 0 THEN '04' ELSE '99' END AS admin, c_custkey * 1000 AS population FROM customer"""


@query(f"SELECT name, CASE WHEN admin = '04' THEN 'Punjab' END AS province, population FROM ({_GAZETTEER}) WHERE country = 'PK' AND (code = 'PPLA' OR population >= 50000) AND c_custkey % 7 > 2")
def gazetteer_cities(spark, d):
    """Written as a tab-separated file and read back."""
    k = F.col("c_custkey")
    e = F.lit("")
    name = F.when(k % 7 == 0, _say("Chak ", k)).when(k % 7 == 1, _say("Green Housing Society ", k)).when(k % 7 == 2, "Fata").otherwise(_say("Town ", k))
    line = [k.cast("string"), name, e, e, F.lit("31.5"), F.lit("74.3"), F.lit("P"), F.when(k % 5 == 0, "PPLA").otherwise("PPL"), F.when(k % 11 == 0, "IN").otherwise("PK"), e, F.when(k % 2 == 0, "04").otherwise("99"), e, e, e, (k * 1000).cast("string"), e, e, e, e]
    at = work_folder(spark, "gazetteer")
    table(spark, d, "customer").select(F.concat_ws("\t", *line).alias("value")).write.text(at)
    return places.gazetteer(dims.gazetteer(spark, at)).select("name", "province", "population")


@query(f"SELECT name, CASE WHEN admin = '04' THEN 'Punjab' END AS province, population FROM ({_GAZETTEER}) WHERE country = 'PK' AND (code = 'PPLA' OR population >= 50000) AND c_custkey % 7 > 2")
def gazetteer_archives(spark, d):
    """The same places, packed into archives beside a file that is not asked for."""
    k = F.col("c_custkey")
    e = F.lit("")
    name = F.when(k % 7 == 0, _say("Chak ", k)).when(k % 7 == 1, _say("Green Housing Society ", k)).when(k % 7 == 2, "Fata").otherwise(_say("Town ", k))
    line = [k.cast("string"), _say("Written ", name), name, e, F.lit("31.5"), F.lit("74.3"), F.lit("P"), F.when(k % 5 == 0, "PPLA").otherwise("PPL"), F.when(k % 11 == 0, "IN").otherwise("PK"), e, F.when(k % 2 == 0, "04").otherwise("99"), e, e, e, (k * 1000).cast("string"), e, e, e, e]
    at = work_folder(spark, "gazetteer-archives")
    rows = table(spark, d, "customer").select(F.concat_ws("\t", *line).alias("value"))
    files = rows.repartition(4, "value").mapInArrow(_zipped, "content binary")
    # Archives are bytes of a table here; a collector has them as files.
    files.write.parquet(at)
    return places.gazetteer(dims.places_in(dims.unzipped_lines(spark.read.parquet(at), "places.txt"))).select("name", "province", "population")


def _zipped(parts):
    """One archive a partition."""
    kept = io.BytesIO()
    with zipfile.ZipFile(kept, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("readme.txt", "not places")
        with z.open("places.txt", "w") as f:
            for part in parts:
                f.write("".join(f"{x}\n" for x in part.column("value").to_pylist()).encode())
    yield pa.RecordBatch.from_arrays([pa.array([kept.getvalue()], pa.binary())], ["content"])


@query("SELECT n_name AS name, r_name AS province, lower(n_name) AS alias FROM nation JOIN region ON n_regionkey = r_regionkey")
def city_file(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    each = F.struct(F.col("n_name").alias("name"), F.col("r_name").alias("province"), F.array(F.lower("n_name")).alias("aliases"))
    at = work_folder(spark, "cities")
    n.agg(F.to_json(F.struct(F.collect_list(each).alias("cities"))).alias("value")).write.text(at)
    return dims.cities(spark, at).select("name", "province", F.get("aliases", 0).alias("alias"))


@query("SELECT n_name AS city, s AS source, k AS category FROM nation CROSS JOIN (VALUES ('olx', 'cars'), ('olx', 'bikes')) AS c(s, k)")
def settings_units(spark, d):
    config = {"sources": {"olx": {"enabled": True, "categories": [{"key": "cars"}, {"key": "bikes", "label": "Bikes"}]}, "zameen": {"enabled": False, "categories": [{"key": "homes"}]}}}
    cities = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("pos"), F.lit(True).alias("enabled"))
    return planning.plan_units(cities, dims.source_categories(spark, config)).select("city", "source", "category")


_TOWN_OF = "SELECT n_name, r_name, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(f"""SELECT n_name || CASE WHEN k % 2 = 0 THEN ' (' || r_name || ')' ELSE '' END AS name, r_name AS province, k * 1000 AS population FROM ({_TOWN_OF})
UNION ALL SELECT CASE WHEN k % 4 = 0 THEN 'Far ' || n_name ELSE n_name || ' (Elsewhere)' END, 'Elsewhere', 0 FROM ({_TOWN_OF}) WHERE k % 2 = 0""")
def towns_apart(spark, d):
    """A site has every other name in two provinces; a fourth of those are shown under a name of their own."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    none = F.lit(None)
    row = lambda s, name, province, pop, pos: n.select(F.lit(s).alias("source"), name.alias("name"), province.cast("string").alias("province"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), pop.cast("long").alias("population"), pos.cast("long").alias("pos"), k.alias("k"))
    g = row("gazetteer", F.lower("n_name"), F.col("r_name"), k * 1000, k)
    a = row("site_a", F.col("n_name"), F.col("r_name"), none, k).union(row("site_a", F.col("n_name"), F.lit("Elsewhere"), none, k + 100).filter("k % 2 = 0"))
    b = row("site_b", F.col("n_name"), F.col("r_name"), none, k).filter("k % 3 = 0").union(row("site_b", F.col("n_name"), none, none, k).filter("k % 3 = 1"))
    empty = n.select(F.col("n_name").alias("name"), F.array().cast("array<string>").alias("variants")).limit(0)
    shown = n.filter(k % 4 == 0).select(F.col("n_name").alias("name"), F.lit("Elsewhere").alias("province"), F.concat(F.lit("Far "), "n_name").alias("shown"))
    return places.build_cities(g.union(a).union(b).drop("k"), empty, empty, shown).select("name", "province", "population")


@query("""SELECT n_name AS city, c.source, c.category, CASE WHEN c.source = 'olx' AND n_nationkey % 5 = 0 THEN 'pin-' || n_nationkey ELSE c.source || '-' || n_nationkey END AS identifier
FROM nation CROSS JOIN (VALUES ('olx', 'cars'), ('olx', 'bikes'), ('zameen', 'homes')) AS c(source, category) WHERE n_nationkey % 10 <> 5
UNION ALL SELECT 'New ' || r_name, c.source, c.category, NULL FROM region CROSS JOIN (VALUES ('olx', 'cars'), ('olx', 'bikes'), ('zameen', 'homes')) AS c(source, category)""")
def configured_units(spark, d):
    """A master list, overrides and settings as files: what is searched, and under which identifier."""
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    at = work_folder(spark, "configuration")
    each = F.struct(F.col("n_name").alias("name"), F.array(_say(F.col("n_name"), " Town")).alias("aliases"))
    n.agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct(k, each.alias("e")))), lambda x: x["e"]).alias("cities"))).alias("value")).write.text(f"{at}/cities.json")
    changed = n.filter(k % 5 == 0).select(_say("  - name: ", F.lower("n_name"), " town\n    olx_location_id: pin-", k, F.when(k % 10 == 5, "\n    enabled: false").otherwise("")).alias("value"))
    added = table(spark, d, "region").select(_say("  - name: New ", F.col("r_name")).alias("value"))
    spark.createDataFrame([("cities:",)], "value string").union(changed).union(added).coalesce(1).write.text(f"{at}/cities.yml")
    found = ["sources:", "  olx:", "    categories:", "      - key: cars", "      - key: bikes", "  zameen:", "    categories: [{key: homes}]", "  pakwheels:", "    enabled: false", "    categories: [{key: used}]"]
    spark.createDataFrame([("\n".join(found),)], "value string").write.text(f"{at}/settings.yml")
    cities, categories, _ = dims.configuration(spark, at)
    site = lambda s: n.select(F.lit(s).alias("source"), F.col("n_name").alias("name"), _say(f"{s}-", k).alias("identifier"), F.lit(None).cast("string").alias("province"), F.lit("city").alias("level"), k.cast("long").alias("pos"))
    units = planning.plan_units(cities, categories)
    return units.join(places.resolve(cities, site("olx").union(site("zameen"))), ["city", "source"]).select("city", "source", "category", "identifier")


@query("SELECT n_name AS city, (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS place FROM nation")
def picker_cities(spark, d):
    cities = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("pos"))
    shown = dims.picker(cities, dims.source_categories(spark, {}), {})["cities"]
    return spark.createDataFrame(list(enumerate(shown)), "place long, city string").select("city", "place")


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::DOUBLE WHEN n_nationkey % 3 = 0 THEN 9.0 END AS lat FROM nation")
def coordinates_filled(spark, d):
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    c = n.select(F.col("n_name").alias("name"), F.when(k % 2 == 0, k.cast("double")).alias("lat"), F.when(k % 2 == 0, F.lit(1.0)).alias("lon"))
    one = n.filter(k % 3 == 0).select(F.lower("n_name").alias("name"), F.lit(8.0).alias("lat"), F.lit(8.0).alias("lon"), F.lit(0).alias("pos"))
    two = one.select("name", F.lit(9.0).alias("lat"), F.lit(9.0).alias("lon"), F.lit(1).alias("pos"))
    return places.fill_coordinates(c, one.union(two)).select("name", "lat")


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 4 = 0 THEN false WHEN n_nationkey % 2 = 0 THEN true END AS covered FROM nation")
def coverage_carried(spark, d):
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    name = n.select(F.col("n_name").alias("name"))
    return places.carry_coverage(name, n.filter(k % 2 == 0).select(F.col("n_name").alias("name"), F.lit(True).alias("covered")), n.filter(k % 4 == 0).select(F.col("n_name").alias("name"))).select("name", "covered")


@query("SELECT lower(p_brand) AS name, count(*) AS count FROM part GROUP BY p_brand HAVING count(*) > 1")
def name_guard(spark, d):
    return places.duplicate_names(table(spark, d, "part").select(F.col("p_brand").alias("name")))


@query("""WITH c AS (SELECT n_name, r_name AS province, CASE n_nationkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'unchecked' END AS state FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT 'province' AS kind, province AS key, NULL AS state, count(*) AS n FROM c GROUP BY province UNION ALL SELECT 'coverage', 'site', state, count(*) FROM c GROUP BY state""")
def city_report(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey") % 3
    return places.report(n.select("n_name", F.col("r_name").alias("province"), F.create_map(F.lit("site"), F.when(k == 0, True).when(k == 1, False)).alias("coverage")))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'unsupported' ELSE 'completed' END AS status, CASE o_orderkey % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'no page' ELSE '' END AS reason, CASE WHEN o_orderkey % 4 > 1 THEN o_custkey ELSE 0 END AS listings FROM orders")
def unit_outcomes(spark, d):
    k = F.col("o_orderkey") % 4
    u = table(spark, d, "orders").select("o_orderkey", F.when(k == 0, "timeout").otherwise("").alias("error"), F.when(k <= 1, "no page").otherwise("").alias("unsupported"), F.col("o_custkey").alias("listings"))
    return crawlcut.outcome(u).select("o_orderkey", "status", "reason", "listings")


@query("SELECT DISTINCT c_mktsegment AS name FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def unknown_names(spark, d):
    known = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "name string")
    return planning.unknown(table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct(), known, "name")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN chr(200 + (event_id % 300)::INT) WHEN 1 THEN 'é' WHEN 2 THEN '¬hing;' ELSE '≠<' END || ' x' AS said FROM events")
def html_references(spark, d):
    """Numeric, named, unknown and longest-match references."""
    k = F.col("event_id")
    said = F.when(k % 4 == 0, _say("&#", 200 + k % 300, ";")).when(k % 4 == 1, "&eacute;").when(k % 4 == 2, "&nothing;").otherwise("&ne;&lt")
    return table(spark, d, "events").select("event_id", text.decode_entities(_say(said, " x")).alias("said"))


@query("SELECT o_orderkey, cast(o_orderdate AS date) AS day FROM orders")
def written_date(spark, d):
    """Dates in numbers, with times and words around them."""
    from tidemark.functions import dates

    o, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    said = F.when(k == 0, F.date_format(o, "MM/dd/yyyy")).when(k == 1, F.date_format(o, "yyyy/MM/dd")).when(k == 2, F.date_format(o, "'Posted on' MM-dd-yyyy")).when(k == 3, F.date_format(o, "yyyy-MM-dd hh:mm a")).otherwise(F.date_format(o, "EEE, d MMM yyyy HH:mm:ss"))
    return table(spark, d, "orders").select("o_orderkey", dates.parse_ad_date(said, NOW).alias("day"))
