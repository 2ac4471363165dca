"""Registered queries, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import blobs, dates, money, phone, text, urls
from tidemark.operators import crawlcut, listings, merge, places, planning, taxonomy, validate
from tidemark.plans.views import LISTINGS_SQL, SIGHTINGS_SQL, UNITS_SQL, listings as view, sightings, table, unit_ads

NOW = datetime(2026, 9, 19, 12)
SINCE = datetime(1996, 1, 1)
_Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = (f, sql)
        return f

    return add


def _all() -> None:
    """Registers the queries of the other modules too."""
    from tidemark.plans import catalog_pages, catalog_store  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return {k: f for k, (f, _) in _Q.items()}


def oracle_sql() -> dict[str, str]:
    _all()
    return {k: s for k, (_, s) in _Q.items() if s}


def _from(view_sql: str, body: str) -> str:
    return f"WITH {view_sql} {body}"


# ------------------------------------------------------------------ query layer

_SUMMARY = "SELECT city, source, count(*) AS listings, count(price) AS with_price, count(phone) AS with_phone, cast(trunc(avg(price)) AS bigint) AS avg_price, min(ad_date) AS oldest_ad, max(ad_date) AS newest_ad FROM L"


@query(_from(LISTINGS_SQL, f"{_SUMMARY} GROUP BY city, source"))
def summary_by_city(spark, d):
    return listings.summary_by_city(view(spark, d))


@query(_from(LISTINGS_SQL, f"{_SUMMARY} WHERE last_seen_at >= TIMESTAMP '1996-01-01' GROUP BY city, source"))
def summary_seen_since(spark, d):
    return listings.summary_by_city(view(spark, d), seen_since=SINCE)


@query(_from(LISTINGS_SQL, "SELECT count(*) AS listings, count(price) AS with_price, count(phone) AS with_phone, count(DISTINCT city) AS cities, count(DISTINCT source) AS sources FROM L"))
def totals(spark, d):
    return listings.totals(view(spark, d))


@query(_from(LISTINGS_SQL, "SELECT count(*) FILTER (first_seen_at >= TIMESTAMP '1996-01-01') AS new, count(*) FILTER (last_seen_at >= TIMESTAMP '1996-01-01') AS total_seen, count(*) FILTER (last_seen_at >= TIMESTAMP '1996-01-01') - count(*) FILTER (first_seen_at >= TIMESTAMP '1996-01-01') AS refreshed FROM L"))
def counts_since(spark, d):
    return listings.counts_since(view(spark, d), SINCE)


@query(_from(LISTINGS_SQL, "SELECT id, city, source, price, ad_date FROM L WHERE city = (SELECT min(n_name) FROM nation) ORDER BY last_seen_at DESC NULLS LAST, id DESC LIMIT 50 OFFSET 10"))
def search_page_eq(spark, d):
    first = table(spark, d, "nation").agg(F.min("n_name")).first()[0]
    return listings.page(listings.search(view(spark, d), city=first), limit=50, offset=10).select("id", "city", "source", "price", "ad_date")


@query(_from(LISTINGS_SQL, "SELECT id, title FROM L WHERE translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%000_1%urgent%' OR translate(description, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%000_1%urgent%'"))
def search_text(spark, d):
    return listings.search(view(spark, d), q="000_1%URGENT").select("id", "title")


@query("SELECT doc_id, source FROM documents WHERE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%license%'")
def search_documents(spark, d):
    docs = table(spark, d, "documents")
    return docs.filter(listings.matches("LICENSE", F.col("text"))).select("doc_id", "source")


@query(_from(LISTINGS_SQL, "SELECT id, phone FROM L WHERE phone IS NOT NULL ORDER BY price ASC NULLS FIRST, id DESC LIMIT 200"))
def search_with_phone(spark, d):
    return listings.page(listings.search(view(spark, d), has_phone=True), "price", descending=False, limit=200).select("id", "phone")


@query(_from(LISTINGS_SQL, "SELECT count(*) AS n FROM L WHERE phone IS NULL"))
def search_without_phone(spark, d):
    return listings.search(view(spark, d), has_phone=False).agg(F.count(F.lit(1)).alias("n"))


@query(_from(LISTINGS_SQL, "SELECT id, price FROM L WHERE price >= 100000 AND price <= 150000"))
def search_price(spark, d):
    return listings.search(view(spark, d), min_price=100000, max_price=150000).select("id", "price")


@query(_from(LISTINGS_SQL, "SELECT DISTINCT 'source' AS col, source AS val FROM L UNION ALL SELECT DISTINCT 'city', city FROM L UNION ALL SELECT DISTINCT 'category', category FROM L"))
def distinct_filters(spark, d):
    v = view(spark, d)
    each = [listings.distinct_values(v, c).select(F.lit(c).alias("col"), F.col(c).alias("val")) for c in ("source", "city", "category")]
    return each[0].union(each[1]).union(each[2])


@query(_from(LISTINGS_SQL, "SELECT DISTINCT city FROM L WHERE first_seen_at >= TIMESTAMP '1996-01-01'"))
def cities_present(spark, d):
    return listings.cities_present(view(spark, d), since=SINCE)


@query(_from(LISTINGS_SQL, "SELECT id, city, source, ad_date FROM L WHERE first_seen_at >= TIMESTAMP '1996-01-01'"))
def all_listings_ordered(spark, d):
    return listings.all_listings(view(spark, d), since=SINCE).select("id", "city", "source", "ad_date")


@query(_from(LISTINGS_SQL, "SELECT 2::BIGINT AS page, 50::BIGINT AS page_size, count(*) AS total, greatest(1, ceil(count(*) / 50))::BIGINT AS pages FROM L WHERE source = 'building'"))
def page_envelope(spark, d):
    return listings.envelope(listings.search(view(spark, d), source="building"), 2, 50)


@query(_from(LISTINGS_SQL, f", S AS ({_SUMMARY} GROUP BY city, source) SELECT city, source, listings, with_price, with_phone FROM S UNION ALL SELECT 'TOTAL', '', sum(listings)::BIGINT, sum(with_price)::BIGINT, sum(with_phone)::BIGINT FROM S"))
def stats_footer(spark, d):
    return listings.footer(listings.summary_by_city(view(spark, d)))


@query(_from(LISTINGS_SQL, "SELECT id, city, title, CASE WHEN length(trim(regexp_replace(description, '\\s+', ' ', 'g'))) <= 20 THEN trim(regexp_replace(description, '\\s+', ' ', 'g')) ELSE rtrim(substr(trim(regexp_replace(description, '\\s+', ' ', 'g')), 1, 20)) || '...' END AS taste FROM L"))
def export_preview(spark, d):
    return view(spark, d).select("id", "city", "title", text.preview(F.col("description"), 20).alias("taste"))


@query(_from(LISTINGS_SQL, ", W AS (SELECT 'p' || (id + id % 2) AS p, source, url, id FROM L) SELECT w.id AS asked, coalesce(a.id, b.id) AS id FROM W w LEFT JOIN L a ON 'p' || a.id = w.p LEFT JOIN L b ON b.source = w.source AND b.url = w.url"))
def stored_lookup_all(spark, d):
    v = view(spark, d).select("id", F.concat(F.lit("p"), "id").alias("fingerprint"), "source", F.col("url").alias("url_canonical"))
    w = v.select(F.col("id").alias("asked"), F.concat(F.lit("p"), F.col("id") + F.col("id") % 2).alias("fingerprint"), "source", "url_canonical")
    return listings.lookup(v, w).select("asked", "id")


@query(_from(LISTINGS_SQL, "SELECT city, source, CASE WHEN count(*) = 0 THEN 0 ELSE cast(round_even(100.0 * count(phone) / count(*), 0) AS bigint) END AS pct FROM L GROUP BY city, source"))
def percent_with_phone(spark, d):
    g = view(spark, d).groupBy("city", "source").agg(F.count("phone").alias("a"), F.count(F.lit(1)).alias("b"))
    return g.select("city", "source", listings.percent(F.col("a"), F.col("b")).alias("pct"))


@query(_from(LISTINGS_SQL, "SELECT city, count(*) AS n FROM L GROUP BY city"))
def per_city_map(spark, d):
    g = view(spark, d).groupBy("city").agg(F.count(F.lit(1)).alias("n"))
    return listings.map_of_counts(g, "city", "n").select(F.explode("counts").alias("city", "n"))


@query(_from(LISTINGS_SQL, "SELECT id FROM L ORDER BY id DESC LIMIT 25"))
def newest_jobs(spark, d):
    return listings.newest(view(spark, d).select("id"), "id", 25)


# ----------------------------------------------------- windows and validation


def _window_sql(keep: bool) -> str:
    u = "in" if keep else "undated"
    return _from(LISTINGS_SQL, f"SELECT id, CASE WHEN ad_date IS NULL THEN '{u}' WHEN ad_date < DATE '1995-01-01' OR ad_date > DATE '1996-12-31' THEN 'filtered' ELSE 'in' END AS verdict FROM L")


@query(_window_sql(False))
def date_window_strict(spark, d):
    return validate.date_window(view(spark, d), "1995-01-01", date(1996, 12, 31), keep_undated=False).select("id", "verdict")


@query(_window_sql(True))
def date_window_keep_undated(spark, d):
    return validate.date_window(view(spark, d), "1995-01-01T10:00:00", "1996-12-31").select("id", "verdict")


def _dirty(spark, d):
    k = F.col("id")
    return view(spark, d).select(
        "id", F.when(k % 11 == 0, "nowhere").otherwise("olx").alias("source"), F.when(k % 13 == 0, "  ").otherwise(F.col("city")).alias("city"), F.when(k % 17 == 0, F.lit("")).when(k % 19 == 0, F.repeat(F.lit("t"), 501)).otherwise(F.col("title")).alias("title"),
        F.when(k % 23 == 0, "item/1").otherwise(F.col("url")).alias("url"), F.when(k % 29 == 0, F.lit(-5).cast("decimal(18,2)")).when(k % 31 == 0, F.lit(2_000_000_000_000).cast("decimal(18,2)")).otherwise(F.col("price")).alias("price"),
        F.when(k % 37 == 0, F.lit(date(2030, 1, 1))).when(k % 41 == 0, F.lit(date(2004, 12, 31))).otherwise(F.lit(date(2020, 2, 2))).alias("ad_date"),
    )


_DIRTY_SQL = (
    LISTINGS_SQL
    + """, D AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'nowhere' ELSE 'olx' END AS source, CASE WHEN id % 13 = 0 THEN '  ' ELSE city END AS city, CASE WHEN id % 17 = 0 THEN '' WHEN id % 19 = 0 THEN repeat('t', 501) ELSE title END AS title,
 CASE WHEN id % 23 = 0 THEN 'item/1' ELSE url END AS url, CASE WHEN id % 29 = 0 THEN -5::decimal(18,2) WHEN id % 31 = 0 THEN 2000000000000::decimal(18,2) ELSE price END AS price,
 CASE WHEN id % 37 = 0 THEN DATE '2030-01-01' WHEN id % 41 = 0 THEN DATE '2004-12-31' ELSE DATE '2020-02-02' END AS ad_date FROM L),
R AS (SELECT *, list_filter([CASE WHEN source <> 'olx' THEN 'unknown source ''' || source || '''' END, CASE WHEN trim(city) = '' THEN 'city is empty' END, CASE WHEN trim(title) = '' THEN 'title is empty' WHEN length(title) > 500 THEN 'title is implausibly long' END,
 CASE WHEN url NOT LIKE 'http%' THEN 'url is not absolute: ''' || url || '''' END, CASE WHEN price < 0 THEN 'negative price: ' || price WHEN price > 1000000000000 THEN 'price out of plausible range: ' || price END,
 CASE WHEN ad_date > DATE '2026-09-19' THEN 'ad_date is in the future: ' || ad_date WHEN year(ad_date) < 2005 THEN 'ad_date is implausibly old: ' || ad_date END], lambda x: x IS NOT NULL) AS reasons FROM D)"""
)


@query(_from(_DIRTY_SQL, "SELECT id FROM R WHERE len(reasons) = 0"))
def validate_split(spark, d):
    return validate.split_valid(_dirty(spark, d), NOW.date())[0].select("id")


@query(_from(_DIRTY_SQL, "SELECT source, url, array_to_string(reasons, '; ') AS reasons FROM R WHERE len(reasons) > 0"))
def reject_reasons(spark, d):
    return validate.split_valid(_dirty(spark, d), NOW.date())[1].select("source", "url", "reasons")


# --------------------------------------------------------------------- scalars

_CANON = r"""U AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages), P AS (SELECT page_id, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme, regexp_replace(lower(regexp_extract(u, '^[^/?]*//([^/?]*)', 1)), '^www\.', '') AS host,
 regexp_replace(regexp_extract(u, '^(?:[^/?]*//[^/?]*)?([^?]*)', 1), '/+$', '') AS path,
 list_sort(list_filter(list_transform(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: {'k': regexp_extract(p, '^([^=]*)', 1), 'v': regexp_extract(p, '^[^=]*=(.*)$', 1)}), lambda p: p.v <> '' AND NOT regexp_matches(lower(p.k), '^(utm_|gclid|fbclid|referrer|campaign|_ga|msclkid|igshid)|^ref$'))) AS kept FROM U),
C AS (SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_transform(kept, lambda p: p.k || '=' || p.v), '&') ELSE '' END AS canonical FROM P)"""


@query(_from(_CANON, "SELECT page_id, canonical FROM C"))
def canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query(_from(_CANON, "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'web:id:' || page_id WHEN page_id % 3 = 1 THEN 'web:url:' || canonical ELSE 'web:hash:' || substr(sha256('web|c|k|' || page_id || '|'), 1, 32) END AS fingerprint FROM C JOIN pages USING (page_id)"))
def fingerprint(spark, d):
    k = F.col("page_id")
    p = table(spark, d, "pages")
    return p.select("page_id", urls.fingerprint(F.lit("web"), F.when(k % 3 == 0, k.cast("string")), F.when(k % 3 == 1, F.col("url")), F.lit("c"), F.lit("k"), k.cast("string"), F.lit("")).alias("fingerprint"))


@query("SELECT page_id, sha256(url) || '.json' AS name FROM pages")
def cache_names(spark, d):
    return table(spark, d, "pages").select("page_id", urls.cache_name(F.col("url")).alias("name"))


_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(translate(replace(%s, chr(8203), ''), chr(160), ' '), '[ \t\r\f\x0B]+', ' ', 'g'), '\n\s*\n\s*', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')""" % (
    r"""regexp_replace(replace(replace(replace(replace(replace(replace(%s, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g')"""
    % r"""regexp_replace(regexp_replace(%s, '(?i)<\s*(?:br|/p|/div|/li|/tr|/h[1-6])\s*/?\s*>', chr(10), 'g'), '<[a-zA-Z/!][^>]*>', '', 'g')"""
)


@query(f"SELECT page_id, md5({_CLEAN % 'html'}) AS cleaned FROM pages")
def clean_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.clean_text(F.col("html")).cast("binary")).alias("cleaned"))


@query(r"""WITH c AS (SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') AS t FROM documents), m AS (SELECT doc_id, CASE WHEN length(t) > 30000 THEN substr(t, 1, 29997) || '...' ELSE t END AS t FROM c)
SELECT doc_id, md5(CASE WHEN substr(t, 1, 1) IN ('=', '+', '-', '@') THEN chr(39) || t ELSE t END) AS cell FROM m""")
def excel_safe_whole(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.safe_cell(F.col("text")).cast("binary")).alias("cell"))


_WORDS = "['lakh', 'crore', 'k', 'million', 'sheep', '']"


@query(f"""WITH p AS (SELECT p_partkey, {_WORDS}[1 + p_partkey % 6] AS w, cast(p_retailprice AS decimal(18,2)) AS price FROM part) SELECT p_partkey, cast(price * CASE w WHEN 'lakh' THEN 100000 WHEN 'crore' THEN 10000000 WHEN 'k' THEN 1000 WHEN 'million' THEN 1000000 ELSE 1 END AS decimal(18,2)) AS amount,
 CASE WHEN p_partkey % 4 = 0 THEN 'USD' ELSE 'PKR' END AS currency FROM p""")
def parse_price(spark, d):
    w = F.get(F.array(*[F.lit(x) for x in ("lakh", "crore", "k", "million", "sheep", "")]), (F.col("p_partkey") % 6).cast("int"))
    raw = F.concat(F.when(F.col("p_partkey") % 4 == 0, "USD ").otherwise("Rs "), F.format_number(F.col("p_retailprice").cast("decimal(18,2)"), 2), F.lit(" "), w)
    p = table(spark, d, "part").select("p_partkey", money.parse_price(raw).alias("p"))
    return p.select("p_partkey", F.col("p.amount").cast("decimal(18,2)").alias("amount"), "p.currency")


@query("""WITH c AS (SELECT c_custkey, lpad(cast(c_custkey * 7919 % 1000000000 AS varchar), 9, '0') AS n FROM customer), n AS (SELECT c_custkey, '3' || n AS national FROM c)
SELECT c_custkey, CASE WHEN len(list_distinct(string_split(national, ''))) > 2 THEN '+92' || national END AS phone FROM n""")
def normalize_phone(spark, d):
    n = F.concat(F.lit("3"), F.lpad((F.col("c_custkey") * 7919 % 1000000000).cast("string"), 9, "0"))
    k = F.col("c_custkey") % 4
    shown = F.when(k == 0, F.concat(F.lit("0"), n)).when(k == 1, F.concat(F.lit("+92 "), n)).when(k == 2, F.concat(F.lit("0092-"), n)).otherwise(n)
    return table(spark, d, "customer").select("c_custkey", phone.normalize_phone(shown).alias("phone"))


@query("""WITH c AS (SELECT c_custkey, '3' || lpad(cast(c_custkey * 7919 % 1000000000 AS varchar), 9, '0') AS n FROM customer) SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 AND len(list_distinct(string_split(n, ''))) > 2 THEN '+92' || n END AS phone FROM c""")
def extract_phone(spark, d):
    n = F.concat(F.lit("3"), F.lpad((F.col("c_custkey") * 7919 % 1000000000).cast("string"), 9, "0"))
    k = F.col("c_custkey") % 3
    said = F.concat(F.lit("Mileage 41500\n2019 import, call "), F.when(k == 0, F.concat(F.lit("0"), F.substring(n, 1, 3), F.lit("-"), F.substring(n, 4, 7))).when(k == 1, F.concat(F.lit("+92 "), n)).otherwise(n), F.lit(" today"))
    return table(spark, d, "customer").select("c_custkey", phone.extract_phone(said).alias("phone"))


@query("""WITH e AS (SELECT event_id, event_id % 9 + 1 AS k, ['second','minute','hour','day','week','month','year'][1 + event_id % 7] AS u FROM events)
SELECT event_id, cast(TIMESTAMP '2026-09-19 12:00:00' - to_seconds(k * CASE u WHEN 'second' THEN 1 WHEN 'minute' THEN 60 WHEN 'hour' THEN 3600 WHEN 'day' THEN 86400 WHEN 'week' THEN 604800 WHEN 'month' THEN 2592000 ELSE 31536000 END) AS date) AS day FROM e""")
def relative_date(spark, d):
    u = F.get(F.array(*[F.lit(x) for x in ("second", "minute", "hour", "day", "week", "month", "year")]), (F.col("event_id") % 7).cast("int"))
    said = F.concat(F.lit("Updated "), (F.col("event_id") % 9 + 1).cast("string"), F.lit(" "), u, F.lit("s ago"))
    return table(spark, d, "events").select("event_id", dates.parse_ad_date(said, NOW).alias("day"))


@query("SELECT o_orderkey, cast(o_orderdate AS date) AS day FROM orders")
def absolute_date(spark, d):
    o = F.col("o_orderdate")
    k = F.col("o_orderkey") % 4
    said = F.when(k == 0, F.date_format(o, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(o, "MMM d, yyyy")).when(k == 2, F.date_format(o, "d MMMM yyyy")).otherwise((F.unix_timestamp(o.cast("timestamp")) * 1000).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", dates.parse_ad_date(said, NOW).alias("day"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS key, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def match_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", text.match_key(F.concat("p_name", F.lit(" (new)"))).alias("key"), text.url_slug(F.col("p_name")).alias("slug"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(regexp_replace(p_name, ' ', '-', 'g') || '-tv-of-it', '-'), lambda w, i: CASE WHEN lower(w) IN ('tv', 'it') THEN upper(w) WHEN i > 1 AND lower(w) = 'of' THEN 'of' ELSE upper(substr(lower(w), 1, 1)) || substr(lower(w), 2) END), ' ') AS label FROM part")
def humanize(spark, d):
    return table(spark, d, "part").select("p_partkey", text.humanize(F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("-tv-of-it"))).alias("label"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ',') AS aliases FROM part")
def alias_array_ops(spark, d):
    words = F.split("p_name", " ")
    keys = F.array_union(text.csv_list(F.array_join(words, " , ")), F.array_distinct(words))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(keys), ",").alias("aliases"))


@query("SELECT event_id, cast(event_id AS varchar) AS digits FROM events")
def normalize_digits(spark, d):
    return table(spark, d, "events").select("event_id", text.normalize_digits(F.translate(F.col("event_id").cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")).alias("digits"))


# ----------------------------------------------------------------------- merge

_FOLD = """SELECT entity, arg_max(title, seq) AS title, arg_max(description, row(length(description), seq)) AS description, arg_max(price, CASE WHEN price IS NOT NULL THEN seq END) AS price,
 coalesce(arg_max(phone, CASE WHEN phone <> '' THEN seq END), CASE WHEN bool_or(phone = '') THEN '' END) AS phone, arg_min(url_canonical, seq) AS url_canonical, arg_min(seen_at, seq) AS first_seen_at, arg_max(seen_at, seq) AS last_seen_at, count(*) AS sightings FROM V GROUP BY entity"""


@query(_from(SIGHTINGS_SQL, _FOLD))
def upsert_merge(spark, d):
    return merge.fold(sightings(spark, d)).select("entity", "title", "description", "price", "phone", "url_canonical", "first_seen_at", "last_seen_at", "sightings")


@query("SELECT count(DISTINCT l_orderkey) AS inserted, count(*) - count(DISTINCT l_orderkey) AS updated FROM lineitem")
def upsert_counts(spark, d):
    n = sightings(spark, d).groupBy("entity").agg(F.count(F.lit(1)).alias("touched")).withColumn("action", F.lit("inserted"))
    return merge.batch_counts(n)


@query("SELECT user_id, event_type, min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) AS n FROM events GROUP BY user_id, event_type")
def first_seen_last_seen(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"), F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT o_orderkey) AS entities, count(DISTINCT o_orderkey) AS inserted FROM orders")
def entity_upsert(spark, d):
    v = view(spark, d)
    two = lambda n, ident: v.select("source", ident.alias("source_listing_id"), "city", F.lit("").alias("area"), "category", "title", "description", F.col("price").cast("decimal(38,6)").alias("price"), "price_currency", F.lit("").alias("price_raw"), "phone", F.lit(None).cast("string").alias("seller_name"), "ad_date", "url", (F.col("id") * 2 + n).alias("seq"), F.col("first_seen_at").alias("seen_at"))
    both = two(0, F.lit(None).cast("string")).unionByName(two(1, F.col("source_listing_id")))
    m = merge.upsert(None, both)
    return m.agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("action") == "inserted").alias("inserted"))


# ------------------------------------------------------------------ unit rules


@query(_from(UNITS_SQL, "SELECT unit, rn FROM (SELECT unit, rn, row_number() OVER (PARTITION BY unit ORDER BY rn) AS k FROM G) WHERE k <= 10"))
def unit_limit(spark, d):
    return crawlcut.limit(unit_ads(spark, d), 10).select("unit", "rn")


@query(_from(UNITS_SQL, "SELECT unit, key, min(rn) AS rn FROM G GROUP BY unit, key"))
def url_dedup(spark, d):
    return crawlcut.dedup(unit_ads(spark, d)).select("unit", "key", "rn")


@query(_from(UNITS_SQL, ", S AS (SELECT unit, page, NOT bool_or(fresh) AS stale FROM F GROUP BY unit, page), C AS (SELECT unit, min(page) AS cut FROM (SELECT *, lag(stale) OVER (PARTITION BY unit ORDER BY page) AS p FROM S) WHERE stale AND p GROUP BY unit) SELECT unit, page, rn, key FROM F LEFT JOIN C USING (unit) WHERE fresh AND (cut IS NULL OR page < cut)"))
def stale_stop(spark, d):
    return crawlcut.stale_stop(unit_ads(spark, d)).select("unit", "page", "rn", "key")


@query(_from(UNITS_SQL, ", S AS (SELECT unit, page, count(*) FILTER (own AND inw) AS n FROM F GROUP BY unit, page HAVING bool_or(fresh)), I AS (SELECT *, sum((n > 0)::INT) OVER (PARTITION BY unit ORDER BY page) AS island FROM S), R AS (SELECT *, count(*) FILTER (n = 0) OVER (PARTITION BY unit, island ORDER BY page) AS run FROM I), C AS (SELECT unit, min(page) AS cut FROM R WHERE n = 0 AND run >= 2 GROUP BY unit) SELECT unit, page, rn, key FROM F LEFT JOIN C USING (unit) WHERE fresh AND (cut IS NULL OR page <= cut)"))
def barren_stop(spark, d):
    return crawlcut.barren_stop(unit_ads(spark, d), 2).select("unit", "page", "rn", "key")


_WALK = """, P AS (SELECT unit, page, CASE WHEN (unit + page * 7) % 13 = 0 THEN 0 ELSE count(*) END AS n FROM G GROUP BY unit, page),
X AS (SELECT unit, min(page) AS e FROM P WHERE n = 0 GROUP BY unit),
A AS (SELECT G.*, own AND row_number() OVER (PARTITION BY G.unit, key, own ORDER BY rn) = 1 AS fresh FROM G LEFT JOIN X ON G.unit = X.unit WHERE e IS NULL OR page < e),
S AS (SELECT unit, page, NOT bool_or(fresh) AS stale, count(*) FILTER (own AND inw) AS n FROM A GROUP BY unit, page),
C AS (SELECT unit, min(page) AS cut FROM (SELECT *, lag(stale) OVER (PARTITION BY unit ORDER BY page) AS p FROM S) WHERE stale AND p GROUP BY unit),
I AS (SELECT *, sum((n > 0)::INT) OVER (PARTITION BY unit ORDER BY page) AS island FROM S WHERE NOT stale),
R AS (SELECT *, count(*) FILTER (n = 0) OVER (PARTITION BY unit, island ORDER BY page) AS run FROM I),
B AS (SELECT unit, min(page) AS idle FROM R WHERE n = 0 AND run >= 3 GROUP BY unit),
W AS (SELECT A.*, count(*) FILTER (fresh AND inw) OVER (PARTITION BY A.unit ORDER BY rn) AS made FROM A LEFT JOIN C ON A.unit = C.unit LEFT JOIN B ON A.unit = B.unit WHERE page <= coalesce(least(cut, idle), page)),
K AS (SELECT unit, rn AS r, page AS p FROM W WHERE fresh AND inw AND made = 4),
Z AS (SELECT W.*, r, fresh AND rn <= coalesce(r, rn) AS given FROM W LEFT JOIN K ON W.unit = K.unit WHERE page <= coalesce(p, page)),
V AS (SELECT unit, string_agg(place, ',' ORDER BY rn, place) AS places FROM (SELECT unit, place, min(rn) AS rn, row_number() OVER (PARTITION BY unit ORDER BY min(rn), place) AS k FROM Z WHERE NOT own GROUP BY unit, place) WHERE k <= 5 GROUP BY unit),
T AS (SELECT unit, coalesce(max(page) FILTER (fresh), 0) AS pages_read, count(*) FILTER (NOT own) AS foreign_ads, count(*) FILTER (given AND inw) AS produced, count(*) FILTER (given AND NOT inw) AS out_of_window, max(page) AS last_page, bool_or(r IS NOT NULL) AS budget_spent FROM Z GROUP BY unit)
SELECT U.unit, coalesce(pages_read, 0)::BIGINT AS pages_read, coalesce(foreign_ads, 0)::BIGINT AS foreign_ads, coalesce(produced, 0)::BIGINT AS produced, coalesce(out_of_window, 0)::BIGINT AS out_of_window, coalesce(last_page, 0)::BIGINT AS last_page, coalesce(budget_spent, false) AS budget_spent, coalesce(places, '') AS places
FROM (SELECT DISTINCT unit FROM P) AS U LEFT JOIN T ON U.unit = T.unit LEFT JOIN V ON U.unit = V.unit"""


@query(_from(UNITS_SQL, _WALK))
def unit_walk(spark, d):
    """What is seen of every unit until an empty page, stale or barren pages or its limit end it."""
    ads = unit_ads(spark, d)
    empty = (F.col("unit") + F.col("page") * 7) % 13 == 0
    on_page = ads.groupBy("unit", "page").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.when(empty, 0).otherwise(F.col("n")))
    seen = crawlcut.walk(on_page, ads, stale=2, barren=3, most=4)[1]
    return seen.select("unit", "pages_read", "foreign_ads", "produced", "out_of_window", "last_page", "budget_spent", F.array_join("foreign_places", ",").alias("places"))


@query(_from(UNITS_SQL, "SELECT unit, rn FROM G WHERE page <= 3"))
def page_cap(spark, d):
    return crawlcut.page_cap(unit_ads(spark, d), 3).select("unit", "rn")


@query(_from(UNITS_SQL, ", P AS (SELECT unit, page, count(*) FILTER (own) AS n FROM G GROUP BY unit, page), C AS (SELECT unit, min(page) AS cut FROM P WHERE n = 0 GROUP BY unit) SELECT unit, page, n FROM P LEFT JOIN C USING (unit) WHERE cut IS NULL OR page < cut"))
def empty_stop(spark, d):
    p = unit_ads(spark, d).groupBy("unit", "page").agg(F.count_if("own").alias("n"))
    return crawlcut.empty_stop(p).select("unit", "page", "n")


@query("SELECT unit_no, stored FROM (SELECT *, coalesce(sum(stored) OVER (ORDER BY unit_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT user_id AS unit_no, count(*) AS stored FROM events GROUP BY user_id)) WHERE before < 500")
def run_cap(spark, d):
    u = table(spark, d, "events").groupBy(F.col("user_id").alias("unit_no")).agg(F.count(F.lit(1)).alias("stored"))
    return crawlcut.run_cap(u, 500).select("unit_no", "stored")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events")
def carry_forward(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_type") == "signup", F.col("value")))
    return e.select("event_id", crawlcut.carry_forward(e, "v", "event_id", ["user_id"]).alias("carried"))


@query(_from(UNITS_SQL, ", X AS (SELECT unit, place, min(rn) AS m FROM G WHERE NOT own GROUP BY unit, place), N AS (SELECT unit, array_to_string(list_slice(list(place ORDER BY m), 1, 2), ',') AS foreign_places FROM X GROUP BY unit) SELECT g.unit, count(DISTINCT page) AS pages_read, count(*) FILTER (own) AS own_ads, count(*) FILTER (NOT own) AS foreign_ads, count(*) FILTER (own AND NOT inw) AS out_of_window, coalesce(any_value(foreign_places), '') AS foreign_places FROM G g LEFT JOIN N ON g.unit = N.unit GROUP BY g.unit"))
def page_coverage(spark, d):
    return crawlcut.coverage(unit_ads(spark, d), 2).withColumn("foreign_places", F.array_join("foreign_places", ","))


# ------------------------------------------------------------ places and plans

_CITIES = "SELECT n_name AS name, n_nationkey AS pos FROM nation"


@query("SELECT row_number() OVER (ORDER BY n_nationkey, s, k) AS unit_no, n_name AS city, source, category FROM nation CROSS JOIN (VALUES ('olx', 'cars', 0, 0), ('olx', 'bikes', 0, 1), ('pakwheels', 'used-cars', 1, 0)) AS c(source, category, s, k)")
def unit_plan(spark, d):
    cities = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("pos"), F.lit(True).alias("enabled"))
    cats = spark.createDataFrame([("olx", "cars", 0, True), ("olx", "bikes", 1, True), ("olx", "phones", 2, True), ("pakwheels", "used-cars", 0, True), ("zameen", "homes", 0, False)], "source string, key string, pos int, enabled boolean")
    return planning.plan_units(cities, cats, selections={"olx": ["Cars", "bikes", "nothing"], "pakwheels": [], "zameen": []})


@query("SELECT n_name AS city, 'site' AS source, CASE WHEN n_nationkey % 4 <> 3 THEN 'id' || (100 * (n_nationkey % 2) + n_nationkey) END AS identifier, CASE WHEN n_nationkey % 4 <> 3 THEN 'resolved' ELSE 'unsupported' END AS status FROM nation")
def best_location(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cities = n.select(F.col("n_name").alias("name"), F.col("r_name").alias("province"), F.array(F.concat("n_name", F.lit(" Town"))).alias("aliases"))
    k = F.col("n_nationkey")
    loc = lambda name, ident, province, level, pos: n.select(F.lit("site").alias("source"), name.alias("name"), F.concat(F.lit("id"), ident.cast("string")).alias("identifier"), province.alias("province"), F.lit(level).alias("level"), F.lit(pos).cast("long").alias("pos"), k.alias("k"))
    a = loc(F.lower("n_name"), k, F.col("r_name"), "city", 5).filter("k % 4 <> 3 and k % 2 = 0")
    b = loc(F.concat("n_name", F.lit("-town")), 100 + k, F.lit(None).cast("string"), "city", 6).filter("k % 4 = 1")
    c = loc(F.col("n_name"), 500 + k, F.col("r_name"), "locality", 1).filter("k % 4 <> 3")
    e = loc(F.col("n_name"), 900 + k, F.lit("elsewhere"), "city", 0)
    return places.resolve(cities, a.union(b).union(c).union(e).drop("k")).select("city", "source", "identifier", "status")


@query("SELECT s_suppkey, n_name AS asked, n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def find_city(spark, d):
    n = table(spark, d, "nation")
    cities = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("pos"), F.array(F.lit("Everywhere")).alias("aliases"))
    asked = n.select(F.lower("n_name").alias("asked"), F.col("n_name").alias("shown"), "n_nationkey")
    f = places.find_city(cities, asked.select("asked")).join(asked, "asked")
    return table(spark, d, "supplier").join(f, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("shown").alias("asked"), "name")


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'pinned' ELSE r_name END AS province, n_nationkey % 10 <> 5 AS enabled FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'Newtown', 'new', true")
def override_merge(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.array().cast("array<string>")
    cities = n.select(F.col("n_name").alias("name"), F.col("r_name").alias("province"), none.alias("aliases"), F.col("n_nationkey").cast("int").alias("pos"))
    o = n.filter("n_nationkey % 5 = 0").select(F.lower("n_name").alias("name"), F.lit("pinned").alias("province"), none.alias("aliases"), F.when(F.col("n_nationkey") % 10 == 5, F.lit(False)).alias("enabled"), F.col("n_nationkey").cast("int").alias("pos"))
    extra = spark.createDataFrame([("Newtown", "new", [], None, 99)], "name string, province string, aliases array<string>, enabled boolean, pos int")
    return places.merge_overrides(cities, o.union(extra)).select("name", "province", "enabled")


@query("SELECT s_suppkey AS category_id, s_suppkey % 3 = 0 AS curated FROM supplier UNION ALL SELECT -s_suppkey, true FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey > 0")
def synced_curated(spark, d):
    s = table(spark, d, "supplier")
    c = s.filter("s_suppkey % 3 = 0")
    both = c.select(F.col("s_suppkey").alias("category_id")).union(c.select(-F.col("s_suppkey")))
    return taxonomy.merge_curated(s.select(F.col("s_suppkey").alias("category_id")), both)


@query("SELECT p_size AS id, arg_min(p_type, row(length(p_type), p_type)) AS slug FROM part GROUP BY p_size")
def canonical_slug_min(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_size").alias("id")).agg(taxonomy.shortest(F.col("p_type")).alias("slug"))


@query("WITH k AS (SELECT p_partkey, p_brand || p_size AS k, count(*) OVER (PARTITION BY p_brand || p_size) AS n FROM part) SELECT CASE WHEN n > 1 THEN k || '-c' || p_partkey ELSE k END AS key, cast(p_partkey AS varchar) AS category_id FROM k")
def key_collision(spark, d):
    p = table(spark, d, "part").select(F.concat("p_brand", F.col("p_size").cast("string")).alias("key"), F.lit("x").alias("label"), F.lit("x").alias("group"), F.col("p_partkey").cast("string").alias("category_id"))
    return taxonomy.tell_apart(p).select("key", "category_id")


@query("SELECT p_brand AS category_id, min(p_partkey) AS first_key FROM part GROUP BY p_brand")
def first_by_id(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("category_id"), F.col("p_partkey").alias("first_key"))
    return taxonomy.first_by_id(p, "category_id", "first_key")


@query("SELECT n_name AS name, coalesce(CASE WHEN n_nationkey % 3 <> 0 THEN 'a' || n_regionkey END, CASE WHEN n_nationkey % 2 = 0 THEN 'b' || n_regionkey END, 'g') AS province, CASE WHEN n_nationkey % 6 = 3 THEN n_nationkey * 1000 ELSE 0 END::BIGINT AS population FROM nation")
def city_build(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    row = lambda s, name, province, pop: n.select(F.lit(s).alias("source"), name.alias("name"), province.alias("province"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), pop.cast("long").alias("population"), k.alias("pos"), k.alias("k"))
    g = row("gazetteer", F.lower("n_name"), F.lit("g"), k * 1000)
    a = row("site_a", F.upper("n_name"), F.concat(F.lit("a"), "n_regionkey"), F.lit(None)).filter("k % 3 <> 0")
    b = row("site_b", F.col("n_name"), F.concat(F.lit("b"), "n_regionkey"), F.lit(None)).filter("k % 2 = 0")
    pairs = n.select(F.col("n_name").alias("name"), F.array(F.concat("n_name", F.lit(" City"))).alias("variants"))
    return places.build_cities(g.union(a).union(b).drop("k"), pairs, pairs).select("name", "province", "population")


@query("SELECT c_custkey, c_nationkey % 2 = 0 AS inside FROM customer")
def in_city_guard(spark, d):
    k = F.col("c_nationkey")
    at = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 2 == 0, F.array(F.lit("Garden (East)"), F.lit("La-Hore"))).otherwise(F.array(F.lit("Multan")))
    return table(spark, d, "customer").select("c_custkey", places.in_city(at, F.array(F.lit("lahore"))).alias("inside"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS city FROM nation")
def page_city(spark, d):
    t = F.concat(F.lit("<html><title> Used Cars for sale in "), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("Pakistan"), F.lit(" | Site</title>"))
    return table(spark, d, "nation").select("n_nationkey", places.page_city(t).alias("city"))


# ------------------------------------------------------------------- HTML, JSON


@query(r"""SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*["'']([^"'']*)["''][^>]*>.*?</a\s*>', 1)) AS href FROM pages""")
def anchor_links(spark, d):
    from tidemark.operators.pages import anchors

    return table(spark, d, "pages").select("page_id", F.explode(anchors(F.col("html"))).alias("a")).select("page_id", "a.href")


@query("SELECT event_id, cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events")
def event_props_json(spark, d):
    return table(spark, d, "events").select("event_id", F.expr("variant_get(parse_json(props), '$.k', 'bigint')").alias("k"))


@query("SELECT event_id, cast(json_extract(props, '$.k') AS varchar) AS k FROM events")
def first_key_json(spark, d):
    nested = F.concat(F.lit('{"a": [{"k": ""}, {"b": '), "props", F.lit("}]}"))
    return table(spark, d, "events").select("event_id", blobs.find_first_key(nested, "k").alias("k"))


@query("SELECT event_id, cast(json_extract(props, '$.k') AS bigint) AS k FROM events")
def window_json(spark, d):
    page = F.concat(F.lit('<script>var x = "}"; window.state = '), "props", F.lit(';window.other = {"k": {"}": 1}};</script>'))
    return table(spark, d, "events").select("event_id", F.get_json_object(blobs.window_json(page, "state"), "$.k").cast("long").alias("k"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 'Area ' || (o_orderkey % 10) ELSE '' END AS area, CASE WHEN o_orderkey % 3 <> 0 THEN 'Town,Area ' || (o_orderkey % 10) ELSE 'Town' END AS places FROM orders")
def location_levels(spark, d):
    k = F.col("o_orderkey")
    s = lambda level, name: F.struct(F.lit(level).alias("level"), name.alias("name"))
    full = F.array(s(0, F.lit("Land")), s(1, F.lit("Province")), s(2, F.lit("Town")), s(3, F.concat(F.lit("Area "), (k % 10).cast("string"))))
    loc = F.when(k % 3 != 0, full).otherwise(F.slice(full, 1, 3))
    return table(spark, d, "orders").select("o_orderkey", blobs.area_of(loc).alias("area"), F.array_join(blobs.places_of(loc), ",").alias("places"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 <> 0 THEN '+923' || lpad(cast(n_nationkey + 12000456 AS varchar), 9, '0') END AS phone FROM nation")
def published_phone(spark, d):
    k = F.col("n_nationkey")
    n = F.concat(F.lit("03"), F.lpad((k + 12000456).cast("string"), 9, "0"))
    none = F.lit(None).cast("string")
    return table(spark, d, "nation").select("n_nationkey", phone.published_phone(k % 3 == 0, none, F.lit("123"), F.array(none), F.array(n), none).alias("phone"))


_TREES = """T AS (SELECT p_brand AS brand, p_partkey AS k, 'size-' || p_size AS slug, 'Size ' || p_size AS label, count(*) OVER (PARTITION BY p_size) AS n FROM part)"""


@query(_from(_TREES, """SELECT DISTINCT lower(brand) AS key, brand AS label, 'b' || brand AS category_id, brand AS "group", 0 AS level FROM T
UNION ALL SELECT CASE WHEN n > 1 THEN slug || '-cp' || k ELSE slug END, CASE WHEN n > 1 THEN label || ' (' || brand || ')' ELSE label END, 'p' || k, brand, 1 FROM T
UNION ALL SELECT 'leaf-' || k, 'Leaf', 'l' || k, brand, 2 FROM T WHERE k % 2 = 0"""))
def tree_flatten(spark, d):
    """A page a part: its brand, with the part's size under it and a leaf under every other one; nodes without an id or a slug are walked through."""
    p, k = table(spark, d, "part"), F.col("p_partkey").cast("string")
    leaf = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(',"children":[{"name":"","slug":"no"},{"name":"Leaf","slug":"leaf-'), k, F.lit('","externalID":"l'), k, F.lit('"}]'))).otherwise("")
    size = F.col("p_size").cast("string")
    child = F.concat(F.lit('{"name":"Size '), size, F.lit('","slug":"Size-'), size, F.lit('","externalID":"p'), k, F.lit('"'), leaf, F.lit("}"))
    state = F.concat(F.lit('{"categories":{"data":[{"name":"'), "p_brand", F.lit('","slug":"'), "p_brand", F.lit('","externalID":"b'), "p_brand", F.lit('","children":['), child, F.lit(","), child, F.lit("]}]}}"))
    return taxonomy.flatten_tree(p.select(state.alias("state"))).select("key", "label", "category_id", "group", "level")


@query("""WITH m AS (SELECT DISTINCT p_size AS id, lower(regexp_replace(p_type, ' ', '-', 'g')) AS slug FROM part), c AS (SELECT id, arg_min(slug, row(length(slug), slug)) AS slug FROM m GROUP BY id),
n AS (SELECT *, count(*) OVER (PARTITION BY slug) > 1 AS shared, array_to_string(list_transform(string_split(slug, '-'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS label FROM c)
SELECT CASE WHEN shared THEN slug || '-c' || id ELSE slug END AS key, CASE WHEN shared THEN label || ' (c' || id || ')' ELSE label END AS label, cast(id AS varchar) AS category_id FROM n""")
def sitemap_categories(spark, d):
    """A sitemap a part: its type as slug and its size as id, so ids have many slugs."""
    xml = F.concat(F.lit("<loc>https://site.example/"), F.replace("p_type", F.lit(" "), F.lit("-")), F.lit("_c"), F.col("p_size").cast("string"), F.lit("</loc><loc>https://site.example/about</loc>"))
    return taxonomy.sitemap_categories(table(spark, d, "part").select(xml.alias("text")), host=r"site\.example").select("key", "label", "category_id")


_SITEMAP = "SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'Punjab' WHEN 1 THEN 'Azad Jammu & Kashmir' END AS p FROM supplier"


@query(f"""SELECT 'Old Town ' || k AS name, 'old-town-' || k || '_g40' || lpad(cast(k % 100000 AS varchar), 5, '0') AS identifier, p AS province, 'city' AS level FROM ({_SITEMAP})
UNION ALL SELECT 'Far ' || k, 'far-' || k || '_g10' || lpad(cast(k AS varchar), 14, '0'), coalesce(p, 'Sindh'), 'locality' FROM ({_SITEMAP})""")
def sitemap_locations(spark, d):
    """A sitemap a supplier: a province (or one that nobody knows), a city, what is neither; then perhaps another province, and a locality."""
    k = F.col("s_suppkey")
    at = lambda slug, number: F.concat(F.lit("https://site.example/"), slug if not isinstance(slug, str) else F.lit(slug), F.lit("_g"), number if not isinstance(number, str) else F.lit(number), F.lit(" "))
    head = F.when(k % 3 == 0, at("punjab", "2003006")).when(k % 3 == 1, at("azad-kashmir", "2003007")).otherwise(at("moon", "2009999"))
    word = lambda w: F.concat(F.lit(w), k.cast("string"))
    later = F.when(k % 3 == 2, at("sindh", "2003008")).otherwise("")
    xml = F.concat(head, at(word("old-town-"), F.concat(F.lit("40"), F.lpad((k % 100000).cast("string"), 5, "0"))), at("somewhere", "5000001"), later, at(word("far-"), F.concat(F.lit("10"), F.lpad(k.cast("string"), 14, "0"))))
    return places.sitemap_locations(table(spark, d, "supplier").select(xml.alias("text")), host=r"site\.example").select("name", "identifier", "province", "level")


@query("SELECT n_name AS city, i::BIGINT AS page, 'https://site.example/' || lower(n_name) || CASE WHEN i = 1 THEN '' ELSE '?page=' || i END AS url FROM nation CROSS JOIN range(1, 4) AS r(i)")
def page_urls(spark, d):
    u = crawlcut.next_pages(F.concat(F.lit("https://site.example/"), F.lower("n_name")), 1, 3, "?page=%d")
    return table(spark, d, "nation").select(F.col("n_name").alias("city"), F.posexplode(u).alias("p", "url")).select("city", (F.col("p") + 1).cast("long").alias("page"), "url")


@query("""SELECT s_suppkey, s AS source, i::BIGINT AS page, CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s = 'olx' THEN 'https://site.example/c' || s_suppkey || '/cars/' || CASE WHEN i > 1 THEN '?page=' || i ELSE '' END
 WHEN s = 'pakwheels' THEN 'https://site.example/cars/ct_c' || s_suppkey || '/?page=' || i WHEN s = 'zameen' THEN 'https://site.example/cars/c' || s_suppkey || '-' || i || '.html' END AS url
FROM supplier CROSS JOIN (VALUES ('olx'), ('pakwheels'), ('zameen'), ('other')) AS t(s) CROSS JOIN range(1, 4) AS r(i)""")
def index_urls(spark, d):
    """Three pages of every source; every tenth place has no identifier."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select("s_suppkey", F.when(k % 10 != 0, F.concat(F.lit("c"), k.cast("string"))).alias("ident"), F.explode(F.array(*[F.lit(x) for x in ("olx", "pakwheels", "zameen", "other")])).alias("source"))
    s = s.select("*", F.explode(F.sequence(F.lit(1), F.lit(3)).cast("array<long>")).alias("page"))
    return s.select("s_suppkey", "source", "page", crawlcut.index_url(F.col("source"), F.lit("https://site.example"), F.col("ident"), F.lit("cars"), F.col("page")).alias("url"))
