"""Golden vectors of the scalar functions."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import blobs, dates, money, phone, text, urls

NOW = datetime(2026, 9, 19, 12)


def run(spark, fn, values):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in d.select("i", fn(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


def test_clean_text(spark):
    got = run(spark, text.clean_text, ["<p>Luxury <b>house</b> for sale</p>", "Beds &amp; Wardrobes", "A&nbsp;B", "2 < 3 rooms", None, "", "a<br/>b<br>\n <br>c", "x​y z  \t w", "&lt;b&gt;"])
    assert got == ["Luxury house for sale", "Beds & Wardrobes", "A B", "2 < 3 rooms", "", "", "a\nb\n\nc", "xy z w", "<b>"]
    assert run(spark, text.clean_text, ["caf&eacute; &#233;&hearts; &#8217; a"]) == ["café é♥ ’ a"]


def test_entities_are_those_of_html(spark):
    import html
    import random

    rng = random.Random(5)
    bits = ["&", "&amp;", "&amp", "&lt", "&eacute;", "&eacute", "&notit;", "&notin;", "&#", "&#x", "&#233;", "&#xe9", "&#x1F600;", "&#0;", "&#128;", "&#129;", "&#55296;", "&#1114112;", "&#99999999999999999999;", "&#00000000065;", "&#xFFFFFFFFFFFF;", "&#11;", "&#13;", "&#65534;", "&bogus;", "&CounterClockwiseContourIntegral;", "&nbsp", ";", "a", " ", "é", "1", "x"]
    texts = bits + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 7))) for _ in range(600)]
    assert run(spark, text.decode_entities, texts) == [html.unescape(t) for t in texts]


@pytest.mark.parametrize(
    ("raw", "amount", "currency"),
    [("Rs 4,500,000", 4500000, "PKR"), ("PKR 85,00,000", 8500000, "PKR"), ("4.5 Crore", 45000000, "PKR"), ("85 Lakh", 8500000, "PKR"), ("1.2 crore", 12000000, "PKR"), ("USD 30,000", 30000, "USD"), ("$ 5", 5, "USD"), ("Call for price", None, "PKR"), ("", None, "PKR"), (None, None, "PKR"), ("-5", 5, "PKR"), ("0", None, "PKR"), ("1.2.3 k", 123000, "PKR"), ("about 7 sheep, 3 lakh", 7, "PKR")],
)
def test_parse_price(spark, raw, amount, currency):
    (got,) = run(spark, money.parse_price, [raw])
    assert (got.amount, got.currency) == (None if amount is None else Decimal(amount).quantize(Decimal("1.000000")), currency)


def test_parse_ad_date(spark):
    pairs = {
        "3 days ago": date(2026, 9, 16), "an hour ago": date(2026, 9, 19), "Updated 2 weeks ago": date(2026, 9, 5), "Today": date(2026, 9, 19), "Yesterday": date(2026, 9, 18), "just now": date(2026, 9, 19),
        "1777593600000": date(2026, 5, 1), "1777593600": date(2026, 5, 1), "0": None, "2026-03-14T08:30:00Z": date(2026, 3, 14), "2026-03-14": date(2026, 3, 14), "Mar 14": date(2026, 3, 14), "Dec 25": date(2025, 12, 25),
        "Sep 19, 2026": date(2026, 9, 19), "25 December 2020": date(2020, 12, 25), "Financing available": None, "": None, "2 months ago": date(2026, 7, 21), "a year ago": date(2025, 9, 19), "2026-13-40": None,
    }
    assert run(spark, lambda c: dates.parse_ad_date(c, NOW), list(pairs)) == list(pairs.values())
    pairs = {
        "Posted 14/03/2026": date(2026, 3, 14), "no date": None, None: None, "12/09/2026": date(2026, 12, 9), "2026/09/12": date(2026, 9, 12), "12-09-2026": date(2026, 12, 9), "2026-09-01 10:00 AM": date(2026, 9, 1),
        "12.09.2026": date(2026, 12, 9), "25/12/19": date(2019, 12, 25), "12/25/99": date(1999, 12, 25), "Posted on 14 March 2026, 5 pm": date(2026, 3, 14), "14-Mar-2026": date(2026, 3, 14), "Mar-14-2026 10:30": date(2026, 3, 14),
        "March 2026": None, "May": None, "2026 March 3": date(2026, 3, 3), "9/12": date(2026, 9, 12), "12/25": date(2025, 12, 25), "Sat, 12 Sep 2026 08:00:00 GMT": date(2026, 9, 12), "3rd of June": date(2026, 6, 3), "40/40/2026": None, "Feb 30, 2026": None, "2026-13-45": None, "the 1st Sept. 2025": date(2025, 9, 1),
    }
    got = dict(zip(pairs, run(spark, lambda c: dates.parse_ad_date(c, NOW), list(pairs)), strict=True))
    assert got == pairs


def test_phones(spark):
    ok = ["03001234567", "0300-1234567", "+92 300 1234567", "00923001234567", "923001234567"]
    assert set(run(spark, phone.normalize_phone, ok)) == {"+923001234567"}
    assert run(spark, phone.normalize_phone, ["0000000000", "123", "", None, "3111111111"]) == [None] * 5
    got = run(spark, phone.extract_phone, ["Mileage 41500\n2019 import", "call ۰۳۰۰۱۲۳۴۵۶۷ now", "ring 0300 1234567", None, "0111 then 0300 1234567"])
    assert got == [None, "+923001234567", "+923001234567", None, "+923001234567"]
    assert run(spark, phone.mask_phone, ["+923001234567", None]) == ["+92300*******", None]


def test_urls(spark):
    got = run(spark, urls.canonical_url, ["https://www.site.example/item/abc-iid-1?utm_source=fb&fbclid=xyz", "HTTP://A.b/?b=2&a=1&c=&ref=x&refer=y#f", "https://a.b", "a.b/c/"])
    assert got[:3] == ["https://site.example/item/abc-iid-1", "http://a.b/?a=1&b=2&refer=y", "https://a.b/"]
    assert run(spark, lambda c: urls.canonical_url(urls.canonical_url(c)), ["https://www.x.y/z/?q=1"]) == ["https://x.y/z?q=1"]


def test_canonical_urls_of_escaped_parameters(spark):
    """Parameters of random bytes and escapes, against the standard library's reading."""
    import random
    import re
    from urllib.parse import parse_qsl, urlencode

    rng = random.Random(5)
    bits = ["a", "B", "~", "*", "-", "_", ".", "+", " ", "%20", "%2B", "%2b", "%zz", "%", "%C3%A9", "%c3%a9", "é", "%FF", "%E4", "/", ":", "%26", "%3D", "=", "ref", "utm_x", "日", "%41", "'", "(", "%7E", "%2A"]
    word = lambda n: "".join(rng.choice(bits) for _ in range(rng.randrange(n)))
    queries = ["&".join(rng.choice([word(3) + "=" + word(4), word(2), "ref=x", "%72ef=1", "u%74m_a=1", "gclid=%20"]) for _ in range(rng.randrange(1, 5))) for _ in range(600)]

    def plain(q):
        kept = sorted((k, v) for k, v in parse_qsl(q.rstrip()) if not re.match(urls.TRACKING, k, re.I))
        return "https://s.example/p" + ("?" + urlencode(kept) if kept else "")

    once = run(spark, urls.canonical_url, [f"https://www.S.example/p/?{q}" for q in queries])
    assert once == [plain(q) for q in queries]
    assert run(spark, urls.canonical_url, once) == once


def test_names(spark):
    assert run(spark, text.humanize, ["tv-video-audio", "it-networking", "arts-and-crafts"]) == ["TV Video Audio", "IT Networking", "Arts and Crafts"]
    assert run(spark, text.url_slug, ["D.G. Khan", "Khairpur Mir's", "Café é"]) == ["d-g-khan", "khairpur-mir-s", "cafe-e"]
    a, b, c, d, e, f = run(spark, text.match_key, ["Dera Ghazi Khan", "dera-ghazi-khan", "Nowshera (Cantt)", "Nowshera", "Mirpur", "Mirpur Khas"])
    assert a == b and c == d and e != f
    import random
    import unicodedata

    rng = random.Random(6)
    names = ["".join(rng.choice("aZ éŁøßÑộǆﬁÅｆḰ²½ٱ你") for _ in range(8)) for _ in range(200)]
    plain = [unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode().replace("12", "") for n in names]
    assert [x.replace("12", "") for x in run(spark, text.fold, names)] == plain


def test_cells(spark):
    assert run(spark, text.safe_cell, ["=1+1", "+92", "a\x01b", "x" * 30001, None]) == ["'=1+1", "'+92", "ab", "x" * 29997 + "...", None]
    assert text.sheet_name("a/b[c]" + "z" * 40) == ("a-b-c-" + "z" * 40)[:31] and text.sheet_name(" ") == "Sheet"
    assert run(spark, text.preview, ["a  b\n" + "c" * 100, None]) == ["a b " + "c" * 86 + "...", ""]


def test_blobs(spark):
    page = 'x window.state = {"a": "}{\\"", "b": {"c": [1]}}; y'
    assert run(spark, lambda c: blobs.window_json(c, "state"), [page, "window.state = {broken", "none", None]) == ['{"a": "}{\\"", "b": {"c": [1]}}', None, None, None]
    html = '<script type="application/ld+json">[{"@type":"Car","n":1},{"@graph":[{"@type":["X","product"]}]}]</script><script type="application/ld+json">{bad</script>'
    (found,) = run(spark, blobs.jsonld, [html])
    assert len(found) == 3 and '"Car"' in found[0] and '"X"' in found[1]
    assert run(spark, lambda c: blobs.jsonld_of_type(blobs.jsonld(c), "Product"), [html])[0].startswith('{"@type": ["X"')
    assert run(spark, lambda c: blobs.find_first_key(c, "p", "q"), ['{"a":{"q":"", "z":[{"q": 3}]}}', "[]", "{", None]) == ["3", None, None, None]
