"""Resolving cities against the locations that sources publish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.blobs import window_json
from tidemark.functions.text import city_keys, junk_name, match_key
from tidemark.operators.bounded import small

# Slugs and ids under which two sources file the provinces.
SLUG_PROVINCES = {
    "punjab": "Punjab", "sindh": "Sindh", "islamabad-capital-territory": "Islamabad Capital Territory", "khyber-pakhtunkhwa": "Khyber Pakhtunkhwa",
    "balochistan": "Balochistan", "azad-kashmir": "Azad Jammu & Kashmir", "northern-areas": "Gilgit-Baltistan",
}
ID_PROVINCES = {"1522": "Punjab", "1523": "Sindh", "1524": "Balochistan", "1525": "Khyber Pakhtunkhwa", "1526": "Gilgit-Baltistan", "961": "Azad Jammu & Kashmir", "1562": "Islamabad Capital Territory"}
# Gazetteer provinces and the codes of seats of administration.
GAZETTEER_PROVINCES = {"08": "Islamabad Capital Territory", "05": "Sindh", "04": "Punjab", "03": "Khyber Pakhtunkhwa", "07": "Gilgit-Baltistan", "02": "Balochistan", "06": "Azad Jammu & Kashmir"}
SEATS = ("PPLC", "PPLA", "PPLA2", "PPLA3")
# The host of the location sitemap, and the title of a page that
# is scoped to a city.
SITEMAP_HOST = r"olx\.com\.pk"
TITLE = r"(?i)<title>\s*([^<]*?)\s*</title>"
TITLE_CITY = r"(?i)\bfor sale in\s+(.+?)\s*(?:\||$)"
EXCLUDED = ("malal", "fata", "waziristan", "makran", "modeltown", "sharifabad", "malircantonment", "kurkalisindhpakistan")


def lookup(c: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


def sitemap_locations(pages: DataFrame, text: str = "text", source: str = "olx", host: str = SITEMAP_HOST) -> DataFrame:
    """Cities and localities of a location sitemap in document order.  Ids of
    seven digits from 20 are provinces, which hold for what follows, from 40
    cities; longer ids from 10 are localities; others are left out."""
    found = F.regexp_extract_all(F.col(text), F.lit(rf"(?i){host}/([a-z0-9\-]+_g\d+)"), F.lit(1))
    d = pages.withColumn("doc", F.monotonically_increasing_id()).select("doc", F.posexplode(found).alias("pos", "identifier"))
    d = d.withColumns({"slug": F.regexp_extract("identifier", r"^(.*)_g\d+$", 1), "num": F.regexp_extract("identifier", r"_g(\d+)$", 1)})
    kind = F.when((F.length("num") == 7) & F.col("num").startswith("20"), "province").when((F.length("num") == 7) & F.col("num").startswith("40"), "city").when((F.length("num") > 7) & F.col("num").startswith("10"), "locality")
    d = d.withColumn("level", kind).withColumn("_p", F.when(F.col("level") == "province", lookup(F.col("slug"), SLUG_PROVINCES)))
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("province", F.last("_p", ignorenulls=True).over(w)).filter(F.col("level").isin("city", "locality"))
    name = F.initcap(F.replace("slug", F.lit("-"), F.lit(" ")))
    return d.select(F.lit(source).alias("source"), name.alias("name"), "identifier", "province", "level", F.col("pos").cast("long").alias("pos"))


def state_cities(pages: DataFrame, text: str = "text", source: str = "zameen") -> DataFrame:
    """The city list in a page's state."""
    rows = F.from_json(F.get_json_object(window_json(F.col(text), "state"), "$.cities.data"), "array<struct<name:string,slug:string,parentID:string>>")
    d = pages.select(F.posexplode(rows).alias("pos", "e")).filter("coalesce(e.name, '') <> '' and coalesce(e.slug, '') <> ''")
    return d.select(F.lit(source).alias("source"), F.col("e.name").alias("name"), F.ltrim(F.col("e.slug"), F.lit("/")).alias("identifier"), lookup(F.col("e.parentID"), ID_PROVINCES).alias("province"), F.lit("city").alias("level"), F.col("pos").cast("long").alias("pos"))


def resolve(cities: DataFrame, locations: DataFrame) -> DataFrame:
    """Each city's location: what an override pins (``pins``, a map from source to
    identifier, where cities have it), else same key, no other known province, cities
    before localities, then document order.  Cities without one are unsupported."""
    keys = cities.select(F.col("name").alias("city"), F.col("province").alias("_want"), F.explode(city_keys(F.col("name"), F.col("aliases"))).alias("_key"))
    loc = locations.withColumn("_key", match_key(F.col("name")))
    j = keys.join(loc, "_key").filter(F.coalesce("_want", F.lit("")).isin("") | F.col("province").isNull() | (F.col("province") == F.col("_want")))
    rank = F.row_number().over(Window.partitionBy("city", "source").orderBy(F.when(F.col("level") == "city", 0).otherwise(1), "pos"))
    best = j.withColumn("_r", rank).filter("_r = 1").select("city", "source", "identifier", F.col("name").alias("matched"))
    want = cities.select(F.col("name").alias("city")).crossJoin(small(locations.select("source").distinct(), 1000, "sources"))
    out = want.join(best, ["city", "source"], "left")
    if "pins" in cities.columns:
        pinned = cities.select(F.col("name").alias("city"), F.explode("pins").alias("source", "_pin"))
        out = out.join(pinned, ["city", "source"], "left").withColumn("identifier", F.coalesce("_pin", "identifier")).withColumn("matched", F.when(F.col("_pin").isNull(), F.col("matched")).otherwise(F.col("city"))).drop("_pin")
    return out.withColumn("status", F.when(F.col("identifier").isNotNull(), "resolved").otherwise("unsupported"))


def find_city(cities: DataFrame, asked: DataFrame) -> DataFrame:
    """The city each asked name means: a city's own name before any alias, then
    list order.  cities has name, aliases and pos; asked has asked."""
    own = cities.select("name", "pos", match_key(F.col("name")).alias("_key"), F.lit(0).alias("_kind"))
    alias = cities.select("name", "pos", F.explode(city_keys(F.col("name"), F.col("aliases"))).alias("_key"), F.lit(1).alias("_kind"))
    j = asked.withColumn("_key", match_key(F.col("asked"))).join(own.unionByName(alias), "_key", "left")
    r = F.row_number().over(Window.partitionBy("asked").orderBy("_kind", "pos"))
    return j.withColumn("_r", r).filter("_r = 1").select("asked", "name")


def merge_overrides(cities: DataFrame, overrides: DataFrame) -> DataFrame:
    """Per city the first override that shares a key; overrides that fit none
    are appended as cities.  Both have name, aliases and pos; overrides may
    have enabled, province and pins, which win where they are set."""
    ck = cities.select(F.col("pos").alias("_c"), F.explode(city_keys(F.col("name"), F.col("aliases"))).alias("_key"))
    ok = overrides.select(F.col("pos").alias("_o"), F.explode(city_keys(F.col("name"), F.col("aliases"))).alias("_key"))
    best = ck.join(ok, "_key").groupBy("_c").agg(F.min("_o").alias("_o"))
    o = overrides.select(F.col("pos").alias("_o"), *[F.col(c).alias(f"o_{c}") for c in overrides.columns if c not in ("name", "pos")])
    j = cities.join(best, cities["pos"] == best["_c"], "left").join(o, "_o", "left")
    none = F.array().cast("array<string>")
    cols = [F.col("name"), F.concat(F.coalesce("aliases", none), F.coalesce("o_aliases", none)).alias("aliases"), F.col("pos")]
    rest = [c for c in dict.fromkeys([*cities.columns, *overrides.columns]) if c not in ("name", "aliases", "pos")]
    for c in rest:
        both = [F.col(x) for x, there in ((f"o_{c}", c in overrides.columns), (c, c in cities.columns)) if there]
        cols.append(F.coalesce(*both, *([F.lit(True)] if c == "enabled" else [])).alias(c))
    top = cities.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("_top"))
    new = overrides.join(best.select(F.col("_o").alias("pos")).distinct(), "pos", "left_anti").crossJoin(F.broadcast(top)).withColumn("pos", F.col("_top") + 1 + F.col("pos")).drop("_top")
    if "enabled" in new.columns:
        new = new.withColumn("enabled", F.coalesce("enabled", F.lit(True)))
    return j.select(*cols).unionByName(new, allowMissingColumns=True)


def in_city(located_in: Column, keys: Column) -> Column:
    """True where the ad does not say, or one of its places is the city."""
    places = F.transform(F.coalesce(located_in, F.array().cast("array<string>")), match_key)
    return (F.size(places) == 0) | F.arrays_overlap(places, keys)


def page_city(text: Column) -> Column:
    """The city a listing page is scoped to, from its title; null if none or
    the whole country."""
    city = F.trim(F.regexp_extract(F.regexp_extract(text, TITLE, 1), TITLE_CITY, 1))
    return F.when(~match_key(city).isin("pakistan", ""), city)


def gazetteer(rows: DataFrame, min_population: int = 50_000) -> DataFrame:
    """Cities of a gazetteer table (name, lat, lon, code, country, admin,
    population): seats of administration and large places."""
    keep = (F.col("country") == "PK") & (F.col("code").isin(*SEATS) | (F.col("population") >= min_population))
    d = rows.filter(keep).withColumn("province", lookup(F.col("admin"), GAZETTEER_PROVINCES))
    return d.filter(~junk_name(F.col("name")) & ~match_key(F.col("name")).isin(*EXCLUDED)).select("name", "province", "lat", "lon", "population")


def _towns(places: DataFrame, display: DataFrame | None) -> DataFrame:
    """Adds ``town`` to places with a key: the province, where the key names several
    towns.  It does where one site has it in two provinces, or ``display`` names it."""
    listed = places.filter(F.col("source").isin("site_a", "site_b") & F.col("province").isNotNull()).groupBy("key", "source", "province").agg(F.count(F.lit(1)).alias("n"))
    torn = listed.groupBy("key", "source").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("key").distinct()
    # A place that does not say belongs to the town that is listed most.
    most = listed.join(torn, "key", "left_semi").groupBy("key", "province").agg(F.sum("n").alias("n")).groupBy("key").agg(F.min_by("province", F.struct(-F.col("n"), F.col("province"))).alias("_most"))
    p = places.join(most, "key", "left").withColumn("town", F.when(F.col("_most").isNotNull(), F.coalesce("province", "_most"))).drop("_most")
    if display is None:
        return p.withColumn("display", F.lit(None).cast("string"))
    named = display.select(match_key(F.col("name")).alias("key"), "province", F.col("shown").alias("display")).groupBy("key", "province").agg(F.min("display").alias("display"))
    return p.join(named, ["key", "province"], "left").withColumn("town", F.coalesce("town", F.when(F.col("display").isNotNull(), F.col("province"))))


def build_cities(places: DataFrame, merges: DataFrame, alternates: DataFrame, display: DataFrame | None = None) -> DataFrame:
    """The master list from three sources.

    places: source (gazetteer, site_a, site_b), name, province, lat, lon,
    population, pos.  merges and alternates: name, variants (arrays).  The last
    row of a source and key counts; the sites' province wins over the
    gazetteer's, whose place is dropped where they differ; a merge name, then
    site_b's, site_a's and the gazetteer's name is shown.

    Where a site lists a name in several provinces, each is a town of its own, with
    the places of that province; it is shown with the province in brackets, or as
    ``display`` (name, province, shown) says, which also sets towns apart by itself."""
    alias = merges.select(F.col("name").alias("canon"), F.explode("variants").alias("v")).select(match_key(F.col("v")).alias("_k"), match_key(F.col("canon")).alias("_to"), "canon")
    p = places.withColumn("_k", match_key(F.col("name"))).join(alias.select("_k", "_to"), "_k", "left").withColumn("key", F.coalesce("_to", "_k"))
    p = _towns(p, display)
    pick = lambda c, s: F.max_by(F.when(F.col("source") == s, F.col(c)), F.when(F.col("source") == s, F.col("pos")))
    e = p.groupBy("key", "town").agg(F.max("display").alias("display"), *[pick(c, s).alias(f"{s}_{c}") for s in ("gazetteer", "site_a", "site_b") for c in ("name", "province")], *[pick(c, "gazetteer").alias(c) for c in ("lat", "lon", "population")])
    e = e.withColumn("province", F.coalesce("town", "site_a_province", "site_b_province", "gazetteer_province")).filter("province is not null")
    other = F.col("gazetteer_province").isNotNull() & (F.col("gazetteer_province") != F.col("province"))
    e = e.withColumns({"lat": F.when(~other, F.col("lat")), "lon": F.when(~other, F.col("lon")), "population": F.when(~other, F.coalesce("population", F.lit(0))).otherwise(F.lit(0))})
    canon = merges.select(match_key(F.col("name")).alias("key"), F.col("name").alias("canon"), F.col("variants").alias("_m"))
    e = e.join(canon, "key", "left").withColumn("name", F.coalesce("canon", "site_b_name", "site_a_name", "gazetteer_name"))
    e = e.withColumn("name", F.coalesce("display", F.when(F.col("town").isNotNull(), F.concat("name", F.lit(" ("), "town", F.lit(")"))), "name"))
    e = e.join(alternates.select("name", F.col("variants").alias("_a")), "name", "left")
    none = F.array().cast("array<string>")
    names = F.array_union(F.array_union(F.array_compact(F.array("gazetteer_name", "site_a_name", "site_b_name")), F.coalesce("_m", none)), F.coalesce("_a", none))
    e = e.withColumn("aliases", F.array_sort(F.filter(names, lambda n: match_key(n) != match_key(F.col("name")))))
    return e.select("name", "province", "aliases", "lat", "lon", F.col("population").cast("long").alias("population")).orderBy(F.col("population").desc(), "name")


def fill_coordinates(cities: DataFrame, points: DataFrame) -> DataFrame:
    """lat and lon from (name, lat, lon, pos) where a city has none; the last of a key counts."""
    last = points.groupBy(match_key(F.col("name")).alias("_k")).agg(F.max_by("lat", "pos").alias("_lat"), F.max_by("lon", "pos").alias("_lon"))
    j = cities.withColumn("_k", match_key(F.col("name"))).join(last, "_k", "left")
    none = F.col("lat").isNull()
    return j.withColumns({"lon": F.when(none, F.col("_lon")).otherwise(F.col("lon")), "lat": F.coalesce("lat", "_lat")}).drop("_k", "_lat", "_lon")


def carry_coverage(cities: DataFrame, previous: DataFrame, dropped: DataFrame) -> DataFrame:
    """Adds ``covered`` of an earlier snapshot (name, covered); names dropped then are not."""
    known = previous.select("name", "covered").unionByName(dropped.select("name", F.lit(False).alias("covered"))).groupBy("name").agg(F.min("covered").alias("covered"))
    return cities.join(known, "name", "left")


def duplicate_names(cities: DataFrame) -> DataFrame:
    return cities.groupBy(F.lower("name").alias("name")).count().filter("count > 1")


def report(cities: DataFrame) -> DataFrame:
    """(kind, key, state, n): cities by province, and by site whether they are
    covered, are not, or were not checked."""
    by = cities.groupBy(F.col("province").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("province").alias("kind"), "key", F.lit(None).cast("string").alias("state"), "n")
    each = cities.select(F.explode("coverage").alias("key", "covered"))
    state = F.when(F.col("covered").isNull(), "unchecked").when(F.col("covered"), "true").otherwise("false")
    sites = each.groupBy("key", state.alias("state")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("coverage").alias("kind"), "key", "state", "n")
    return by.unionByName(sites)
