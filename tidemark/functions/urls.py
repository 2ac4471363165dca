"""URLs and the identity of a listing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = r"^(utm_|gclid|fbclid|referrer|campaign|_ga|msclkid|igshid)|^ref$"


# A URL that is canonical as it stands: nothing to lower, cut off or sort.
PLAIN = r"^[a-z][a-z0-9+.\-]*://(?!www\.)[a-z0-9.:\-]+/[^?#]*[^?#/ ]\z"


def _decoded(part: Column) -> Column:
    """A name or value of a query: + is a blank, a percent sign that begins no escape is
    itself, bytes that are no UTF-8 become U+FFFD."""
    return F.when(part.rlike("[%+]"), F.try_url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25"))).otherwise(part)


def _encoded(part: Column) -> Column:
    """Everything but letters, digits and _ . - ~ in escapes; a blank is +."""
    return F.when(part.rlike(r"^[A-Za-z0-9_.~-]*$"), part).otherwise(F.replace(F.replace(F.url_encode(part), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")))


def canonical_url(url: Column) -> Column:
    """No fragment, tracking or blank parameters; the rest read, sorted and written
    anew, so two ways to escape a parameter are one; lower-case host without 'www.';
    no slash at the end.  Escapes of the path stay as written."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[^/?]*//([^/?]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^(?:[^/?]*//[^/?]*)?([^?]*)", 1), r"/+$", "")
    parts = F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&")
    pairs = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^([^=]*)", 1).alias("k"), F.regexp_extract(p, r"^[^=]*=(.*)$", 1).alias("v")))
    read = F.transform(F.filter(pairs, lambda p: p["v"] != ""), lambda p: F.struct(_decoded(p["k"]).alias("k"), _decoded(p["v"]).alias("v")))
    kept = F.array_sort(F.filter(read, lambda p: ~F.lower(p["k"]).rlike(TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    base = F.concat(F.when(scheme == "", F.lit("https")).otherwise(scheme), F.lit("://"), host, F.when(path == "", F.lit("/")).otherwise(path))
    return F.when(url.rlike(PLAIN), url).when(u.contains("?"), F.concat_ws("?", base, F.nullif(query, F.lit("")))).otherwise(base)


def content_hash(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def fingerprint(source: Column, listing_id: Column, url: Column, city: Column, category: Column, title: Column, price_raw: Column) -> Column:
    """By the source's own id, else by URL, else by content."""
    by_id = F.when(F.coalesce(listing_id, F.lit("")) != "", F.concat(source, F.lit(":id:"), listing_id))
    by_url = F.when(F.coalesce(url, F.lit("")) != "", F.concat(source, F.lit(":url:"), canonical_url(url)))
    return F.coalesce(by_id, by_url, F.concat(source, F.lit(":hash:"), content_hash(source, city, category, title, price_raw)))


def cache_name(url: Column) -> Column:
    return F.concat(F.sha2(url, 256), F.lit(".json"))
