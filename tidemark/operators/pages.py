"""Records out of captured pages, by source.

captures: url, text, base_url, city, category (label), as the caller asked for
them.  Every reader is a function (captures, now) -> records; ``READERS`` names
them, and ``register`` adds more.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.blobs import LEVELS, area_of, find_first_key, jsonld, jsonld_of_type, places_of, window_json, window_parts
from tidemark.functions.dates import parse_ad_date
from tidemark.functions.money import parse_price
from tidemark.functions.phone import phone_policy, published_phone
from tidemark.functions.text import city_slug, clean_text, let, match_key
from tidemark.operators.places import page_city
from tidemark.schema import RECORD

_HIT = (
    "struct<externalID:string,id:string,title:string,description:string,slug:string,price:string,extraFields:struct<price:string>,"
    "formattedExtraFields:array<struct<attribute:string,formattedValue:string>>,agency:struct<name:string>,contactInfo:struct<name:string>,"
    f"createdAt:string,updatedAt:string,location:{LEVELS}>"
)

# How the sites write their links to ads and two lines of a table.
AD_LINK = r"(?i)/item/([^/?#]*?)-iid-(\d+)"
USED_LINK = r"(?i)/(?:used-cars|used-bikes)/[^/?#]*?-(\d{5,})(?:[/?#]|$)"
USED_TOWN = r"(?i)-for-sale-in-(.+?)-\d{5,}(?:[/?#]|$)"
PROPERTY_LINK = r"(?i)/Property/[^\s\"']*?-(\d{5,})(?:-\d+)*\.html"
LAST_UPDATED = r"(?i)Last Updated:\s*([A-Za-z]{3,9}\s+\d{1,2},\s*\d{4})"
AD_REF = r"(?i)Ad Ref\s*#\s*(\d+)"


def _none() -> Column:
    return F.lit(None).cast("string")


def given(c: Column) -> Column:
    """Null for the values that stand for no price."""
    return F.when(~F.coalesce(c, F.lit("")).isin("", "0", "0.0"), c)


def anchors(text: Column) -> Column:
    """array<struct<href, attrs, inner>> of a page's links in order."""
    p = F.lit(r"""(?is)<a\b([^>]*\bhref\s*=\s*["']([^"']*)["'][^>]*)>(.*?)</a\s*>""")
    parts = [F.regexp_extract_all(text, p, F.lit(i)) for i in (2, 1, 3)]
    return F.transform(F.arrays_zip(*[x.alias(n) for x, n in zip(parts, ("href", "attrs", "inner"), strict=True)]), lambda s: F.struct(s["href"].alias("href"), s["attrs"].alias("attrs"), s["inner"].alias("inner")))


def attr(attrs: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(attrs, rf"""(?i)\b{name}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))


def absolute(base: Column, href: Column) -> Column:
    return F.when(href.rlike("^https?://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(href, F.lit("/"))))


def first_text(text: Column, *patterns: str) -> Column:
    """The first pattern's first group that holds text."""
    return F.coalesce(*[F.nullif(clean_text(F.regexp_replace(F.regexp_extract(text, p, 1), "<[^>]+>", " ")), F.lit("")) for p in patterns], F.lit(""))


def _price(ad: str) -> Column:
    extra = F.get(F.filter(F.col(f"{ad}.formattedExtraFields"), lambda f: F.lower(f["attribute"]) == "price"), 0)["formattedValue"]
    raw = F.coalesce(given(F.col(f"{ad}.extraFields.price")), given(F.col(f"{ad}.price")), given(extra))
    return parse_price(let(raw, lambda v: F.when(v.startswith("{"), F.coalesce(*[given(F.get_json_object(v, f"$.{k}")) for k in ("value", "raw", "display_value")])).otherwise(v)))


def _seller(ad: str) -> Column:
    return F.coalesce(*[F.nullif(clean_text(F.col(f"{ad}.{k}.name")), F.lit("")) for k in ("agency", "contactInfo")])


def _finish(d: DataFrame) -> DataFrame:
    empty = {"area": F.lit(""), "description": F.lit(""), "price": F.lit(None).cast("decimal(38,6)"), "price_currency": F.lit("PKR"), "price_raw": F.lit(""), "phone": _none(), "seller_name": _none(), "ad_date": F.lit(None).cast("date"), "located_in": F.array().cast("array<string>")}
    for c, e in empty.items():
        if c not in d.columns:
            d = d.withColumn(c, e)
    return d.select("source", "source_listing_id", "city", "area", "category", "title", "description", "price", "price_currency", "price_raw", "phone", "seller_name", "ad_date", "url", "located_in", "page_url", "pos")


def _once(d: DataFrame) -> DataFrame:
    """The first link of each ad on a page."""
    keys = ["page_url", "city", "category", "source_listing_id"]
    rest = [c for c in d.columns if c not in keys]
    return d.groupBy(*keys).agg(F.min_by(F.struct(*rest), "pos").alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def olx_index(captures: DataFrame, now: datetime, collect_phone: bool = True) -> DataFrame:
    """The ads in the page's state; where it has none, its links to ads, each once.

    A page is read once, and its ads come out of one generator: no shuffle."""
    name = lambda x: clean_text(x["title"])
    number = lambda x: F.coalesce(F.nullif(x["externalID"], F.lit("")), F.nullif(x["id"], F.lit("")), F.lit(""))
    hits = F.from_json(F.get(window_parts(F.col("text"), "state", ("algolia", "content", "hits")), 0), f"array<{_HIT}>")
    s = captures.withColumn("_hits", F.transform(hits, lambda h: F.struct(h.alias("ad"), number(h).alias("ident"), name(h).alias("title"))))
    s = s.withColumn("_good", F.exists(F.coalesce("_hits", F.array().cast(s.schema["_hits"].dataType)), lambda h: (h["ident"] != "") & (h["title"] != "")))
    links = F.filter(anchors(F.col("text")), lambda a: a["href"].rlike(AD_LINK))
    links = F.transform(links, lambda a: F.struct(F.regexp_extract(a["href"], AD_LINK, 2).alias("ident"), a.alias("a")))
    first = let(links, lambda all: F.filter(all, lambda x, i: F.array_position(F.transform(all, lambda y: y["ident"]), x["ident"]) == i + 1))
    kind = s.schema["_hits"].dataType.elementType
    none = lambda t: F.lit(None).cast(t)
    link = "struct<href:string,attrs:string,inner:string>"
    from_state = F.transform("_hits", lambda h: F.struct(h["ident"].alias("ident"), h["ad"].alias("ad"), h["title"].alias("title"), none(link).alias("a")))
    from_links = F.transform(first, lambda x: F.struct(x["ident"].alias("ident"), none(kind["ad"].dataType).alias("ad"), none("string").alias("title"), x["a"].alias("a")))
    d = s.select("city", "category", "base_url", F.col("url").alias("page_url"), F.posexplode(F.when(F.col("_good"), from_state).otherwise(from_links)).alias("pos", "x")).select("*", "x.*")
    linked = F.col("a").isNotNull()
    d = d.filter(linked | ((F.col("ident") != "") & (F.col("title") != "")))
    shown = clean_text(F.regexp_replace("a.inner", "<[^>]+>", " "))
    from_slug = F.initcap(F.replace(F.regexp_extract("a.href", AD_LINK, 1), F.lit("-"), F.lit(" ")))
    slug = F.coalesce(F.nullif("ad.slug", F.lit("")), F.substring(city_slug(F.col("title")), 1, 80))
    own = lambda c, other=None: F.when(~linked, c).otherwise(other if other is not None else F.lit(""))
    d = d.select(
        F.lit("olx").alias("source"), F.col("ident").alias("source_listing_id"), "city", "category", own(F.col("title"), F.coalesce(F.nullif(shown, F.lit("")), from_slug)).alias("title"), own(clean_text(F.col("ad.description"))).alias("description"),
        _price("ad").alias("p"), _seller("ad").alias("seller_name"), own(area_of(F.col("ad.location"))).alias("area"), own(places_of(F.col("ad.location")), F.array().cast("array<string>")).alias("located_in"),
        parse_ad_date(F.coalesce(F.nullif("ad.createdAt", F.lit("")), F.col("ad.updatedAt")), now).alias("ad_date"),
        own(F.concat(F.rtrim("base_url", F.lit("/")), F.lit("/item/"), slug, F.lit("-iid-"), "ident"), absolute(F.col("base_url"), F.col("a.href"))).alias("url"), "page_url", "pos", linked.alias("_linked"),
    )
    price = {"price": F.col("p.amount"), "price_currency": F.coalesce(F.when(~F.col("_linked"), F.col("p.currency")), F.lit("PKR")), "price_raw": F.when(~F.col("_linked"), F.col("p.raw")).otherwise("")}
    said = F.when(~F.col("_linked"), phone_policy(_none(), [F.col("description"), F.col("title")], collect_phone))
    return _finish(d.withColumns(price | {"phone": said}).drop("p", "_linked"))


def pakwheels_index(captures: DataFrame, now: datetime, collect_phone: bool = True) -> DataFrame:
    """Links to ads with the id at their end; prices by URL from the page's JSON-LD."""
    s = captures.withColumn("_ld", jsonld(F.col("text")))
    a = anchors(F.col("text"))
    named = F.filter(a, lambda x: x["attrs"].rlike(r"(?i)\bclass\s*=\s*[\"'][^\"']*\bcar-name\b"))
    links = s.select("*", F.posexplode(F.when(F.size(named) > 0, named).otherwise(a)).alias("pos", "a"))
    pattern = USED_LINK
    title = clean_text(F.coalesce(attr(F.col("a.attrs"), "title"), F.regexp_replace("a.inner", "<[^>]+>", " ")))
    town = F.nullif(F.regexp_extract("a.href", USED_TOWN, 1), F.lit(""))
    d = links.filter(F.col("a.href").rlike(pattern)).select(F.lit("pakwheels").alias("source"), F.regexp_extract("a.href", pattern, 1).alias("source_listing_id"), "city", "category", title.alias("title"), absolute(F.col("base_url"), F.col("a.href")).alias("url"), F.array_compact(F.array(F.replace(town, F.lit("-"), F.lit(" ")))).alias("located_in"), F.col("url").alias("page_url"), "pos")
    d = _once(d).filter("title <> ''")
    offer = lambda x, k: F.coalesce(F.get_json_object(x, f"$.offers.{k}"), F.get_json_object(x, f"$.offers[0].{k}"))
    prices = s.select(F.col("url").alias("page_url"), F.posexplode("_ld").alias("_n", "x")).filter(F.lower(F.get_json_object("x", "$.@type")).contains("product"))
    prices = prices.select("page_url", F.rtrim(offer(F.col("x"), "url"), F.lit("/")).alias("_u"), offer(F.col("x"), "price").alias("_p"), "_n").filter("_u is not null and _p is not null").groupBy("page_url", "_u").agg(F.max_by("_p", "_n").alias("_p"))
    d = d.withColumn("_u", F.rtrim("url", F.lit("/"))).join(prices, ["page_url", "_u"], "left").withColumn("p", parse_price(F.col("_p")))
    return _finish(d.withColumns({"price": F.col("p.amount"), "price_currency": F.col("p.currency"), "price_raw": F.col("p.raw")}))


def zameen_index(captures: DataFrame, now: datetime, collect_phone: bool = True) -> DataFrame:
    """Own property links, the first long number as id; places by id from the state."""
    s = captures.withColumn("_state", window_json(F.col("text"), "state"))
    links = s.select("*", F.posexplode(anchors(F.col("text"))).alias("pos", "a"))
    own = F.col("a.href").startswith("/Property/") | F.startswith("a.href", F.concat(F.rtrim("base_url", F.lit("/")), F.lit("/Property/")))
    pattern = PROPERTY_LINK
    ident = F.regexp_extract("a.href", pattern, 1)
    title = clean_text(F.coalesce(attr(F.col("a.attrs"), "title"), attr(F.col("a.attrs"), "aria-label"), F.regexp_replace("a.inner", "<[^>]+>", " ")))
    d = links.filter(own & F.col("a.href").rlike(pattern)).select(F.lit("zameen").alias("source"), ident.alias("source_listing_id"), "city", "category", F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("Zameen listing "), ident)).alias("title"), absolute(F.col("base_url"), F.col("a.href")).alias("url"), F.col("url").alias("page_url"), "pos")
    hits = s.select(F.col("url").alias("page_url"), F.explode(F.from_json(F.get_json_object("_state", "$.algolia.content.hits"), f"array<struct<externalID:string,location:{LEVELS}>>")).alias("h"))
    places = hits.select("page_url", F.col("h.externalID").alias("source_listing_id"), places_of(F.col("h.location")).alias("located_in")).dropDuplicates(["page_url", "source_listing_id"])
    d = _once(d).join(places, ["page_url", "source_listing_id"], "left").withColumn("located_in", F.coalesce("located_in", F.array().cast("array<string>")))
    return _finish(d)


READERS: dict[str, Callable[[DataFrame, datetime], DataFrame]] = {"olx": olx_index, "pakwheels": pakwheels_index, "zameen": zameen_index}


#: Columns of a record, as store and validation take it.
RECORD_COLUMNS = tuple(f.strip().split()[0] for f in RECORD.replace("(38,6)", "").split(","))
#: Sources whose ads have readable pages of their own.
DETAILED = ("olx", "pakwheels", "zameen")


#: Sources that answer an unknown city with the whole country's ads: the city that a
#: page of theirs says it is of.
SCOPES: dict[str, Callable[[Column], Column]] = {"pakwheels": page_city}


def register(source: str, reader: Callable[[DataFrame, datetime], DataFrame], scope: Callable[[Column], Column] | None = None) -> None:
    """A source's reader and, where its pages have to be of the city asked for, how they say which it is."""
    READERS[source] = reader
    SCOPES.pop(source, None)
    if scope is not None:
        SCOPES[source] = scope


def astray(source: Column, text: Column, keys: Column) -> Column:
    """Whether a page of a scoped source is of none of the names."""
    out = F.lit(False)
    for name, scope in SCOPES.items():
        of = F.array_contains(keys, match_key(F.coalesce(scope(text), F.lit(""))))
        out = F.when(source == name, ~F.coalesce(of, F.lit(False))).otherwise(out)
    return out


def details(captures: DataFrame, source: str, now: datetime) -> DataFrame:
    """(url, d_*) of detail pages: state before JSON-LD or the other way, as
    each source is best read; then marked-up text."""
    s = captures.select("url", "text", window_json(F.col("text"), "state").alias("state"), jsonld(F.col("text")).alias("ld"))
    kinds = {"olx": ("Product", "Car", "WebPage"), "pakwheels": ("Car", "Product", "Vehicle", "Motorcycle"), "zameen": ("Product", "Residence", "Offer", "RealEstateListing", "Place")}[source]
    s = s.withColumn("x", jsonld_of_type(F.col("ld"), *kinds))
    ld = lambda k: F.get_json_object("x", k)
    offer = lambda k: F.coalesce(ld(f"$.offers.{k}"), ld(f"$.offers[0].{k}"))
    empty = lambda c: F.nullif(c, F.lit(""))
    css = lambda *p: empty(first_text(F.col("text"), *p))
    price_css = css(r"""(?is)class=["'][^"']*price-box[^"']*["'][^>]*>(.*?)</""", r"""(?is)aria-label=["']Price["'][^>]*>(.*?)</""", r"""(?is)<span[^>]*class=["'][^"']*price[^"']*["'][^>]*>(.*?)</""", r"""(?is)itemprop=["']price["'][^>]*>(.*?)</""")
    text_css = css(r"""(?is)id=["']scroll_seller_comments["'].*?</[^>]+>\s*<div[^>]*>(.*?)</div>""", r"""(?is)aria-label=["']Property description["'][^>]*>(.*?)</div>""", r"""(?is)itemprop=["']description["'][^>]*>(.*?)</""")
    if source == "olx":
        s = s.withColumn("ad", F.from_json(F.get_json_object("state", "$.ad.data"), _HIT))
        p = F.when(F.col("ad").isNotNull(), _price("ad")).otherwise(parse_price(offer("price")))
        cols = {"title": F.when(F.col("ad").isNotNull(), empty(clean_text(F.col("ad.title")))).otherwise(empty(clean_text(ld("$.name")))), "description": F.when(F.col("ad").isNotNull(), empty(clean_text(F.col("ad.description")))).otherwise(empty(clean_text(ld("$.description")))), "p": p, "currency": _none(), "ad_date": parse_ad_date(F.coalesce(empty(F.col("ad.createdAt")), F.col("ad.updatedAt")), now), "seller_name": _seller("ad"), "area": empty(area_of(F.col("ad.location"))), "source_listing_id": F.when(F.col("ad").isNotNull(), empty(F.col("ad.externalID"))).otherwise(empty(ld("$.sku"))), "phone": _none()}
    elif source == "pakwheels":
        spec = first_text(F.col("text"), r"""(?is)id=["']scroll_car_detail["'][^>]*>(.*?)</(?:ul|table|section)>""", r"""(?is)id=["']scroll_car_detail["'][^>]*>(.*)$""")
        day = parse_ad_date(empty(F.regexp_extract(spec, LAST_UPDATED, 1)), now)
        seller = css(r"""(?is)class=["'][^"']*owner-detail[^"']*["'].*?<meta[^>]*itemprop=["']name["'][^>]*content=["']([^"']*)["']""", r"""(?is)class=["'][^"']*owner-detail[^"']*["'].*?<h5[^>]*>(.*?)</h5>""")
        cols = {"title": empty(clean_text(ld("$.name"))), "description": F.coalesce(empty(clean_text(ld("$.description"))), text_css), "p": parse_price(F.coalesce(offer("price"), price_css)), "currency": offer("priceCurrency"), "ad_date": day, "seller_name": F.when(F.length(seller) <= 80, seller), "area": _none(), "source_listing_id": empty(F.regexp_extract(spec, AD_REF, 1)), "phone": _none()}
    else:
        key = lambda *k: find_first_key(F.col("state"), *k)
        data = lambda k: F.coalesce(F.get_json_object("state", f"$.property.data.{k}"), F.when(F.get_json_object("state", "$.property.data").isNull(), F.get_json_object("state", f"$.{k}")))
        numbers = lambda k: F.from_json(data(f"phoneNumber.{k}"), "array<string>")
        plain = data("phoneNumber")
        phone = published_phone(F.coalesce(data("requiresLoginForContact"), F.lit("")) == "true", data("primaryPhoneNumber"), data("mobilePhoneNumber"), numbers("mobileNumbers"), numbers("phoneNumbers"), F.coalesce(data("phoneNumber.whatsapp"), F.when(~plain.startswith("{"), plain)))
        cols = {"title": empty(clean_text(ld("$.name"))), "description": F.coalesce(empty(clean_text(ld("$.description"))), empty(clean_text(key("description", "descriptionText"))), text_css), "p": parse_price(F.coalesce(offer("price"), key("price", "priceValue"), price_css)), "currency": offer("priceCurrency"), "ad_date": F.coalesce(parse_ad_date(key("createdAt", "created_at", "activeDate", "creationDate"), now), parse_ad_date(css(r"""(?is)aria-label=["']Creation date["'][^>]*>(.*?)</"""), now)), "seller_name": empty(clean_text(F.coalesce(data("contactName"), key("contactName")))), "area": empty(area_of(F.from_json(data("location"), LEVELS))), "source_listing_id": key("externalID", "id", "listingId"), "phone": phone}
    return s.select("url", *[c.alias(f"d_{n}") for n, c in cols.items()])


#: Columns that a detail page replaces; it only fills the others.
_REPLACES = {"olx": ("title", "description"), "pakwheels": ("title", "description", "price"), "zameen": ("title", "description", "price")}


def complete(stubs: DataFrame, detail: DataFrame, source: str, collect_phone: bool = True) -> DataFrame:
    """Stubs with what their detail pages add; a stub without one stays."""
    j = stubs.join(detail, "url", "left")
    wins = _REPLACES[source]
    both = lambda c, old, new: F.coalesce(new, old) if c in wins else F.coalesce(old, new)
    has = F.col("d_p.amount").isNotNull() & (F.lit("price" in wins) | F.col("price").isNull())
    new = {c: both(c, F.nullif(F.col(c), F.lit("")), F.col(f"d_{c}")) for c in ("title", "description", "source_listing_id", "seller_name", "area")}
    new |= {"ad_date": F.coalesce("ad_date", "d_ad_date"), "price": F.when(has, F.col("d_p.amount")).otherwise(F.col("price")), "price_currency": F.when(has, F.coalesce("d_currency", "d_p.currency")).otherwise(F.col("price_currency")), "price_raw": F.when(has, F.col("d_p.raw")).otherwise(F.col("price_raw"))}
    j = j.withColumns(new)
    j = j.withColumn("phone", phone_policy(F.coalesce("phone", "d_phone"), [F.col("description"), F.col("title")], collect_phone))
    return j.withColumns({"description": F.coalesce("description", F.lit("")), "area": F.coalesce("area", F.lit(""))}).select(*stubs.columns)


# A description shorter than this asks for the ad's own page.
SHORT_TEXT = 80
SHORT = {"olx": 40}


def needs_detail(least: int = SHORT_TEXT) -> Column:
    return F.length(F.coalesce("description", F.lit(""))) < least


def stale_detail(now: datetime, hours: int = 168) -> Column:
    """True unless the stored row was scraped less than ``hours`` ago."""
    return ~F.coalesce(F.col("scraped_at") > F.lit(now) - F.expr(f"INTERVAL {hours} HOURS"), F.lit(False))
