"""Prices in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import clean_text, let

# Magnitude words, and phrases that say there is no price.
MAGNITUDES = {
    "thousand": 1_000, "k": 1_000, "lakh": 100_000, "lac": 100_000, "lacs": 100_000, "lakhs": 100_000, "crore": 10_000_000,
    "crores": 10_000_000, "cr": 10_000_000, "arab": 1_000_000_000, "million": 1_000_000, "mn": 1_000_000, "billion": 1_000_000_000,
}
NO_PRICE = ("call for price", "price on call", "contact for price", "ask for price", "negotiable price", "on demand", "poa")


def parse_price(raw: Column) -> Column:
    """struct(amount decimal(38,6), currency, raw); amount is null where the
    text has no positive number.  Signs are ignored; commas never are decimal."""
    return let(clean_text(raw), _parse)


def _parse(text: Column) -> Column:
    low = F.lower(text)
    marked = low.contains(NO_PRICE[0])
    for m in NO_PRICE[1:]:
        marked = marked | low.contains(m)
    number = F.replace(F.regexp_extract(low, r"(\d[\d,.]*)", 1), F.lit(","), F.lit(""))
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    number = F.when(dots > 1, F.replace(number, F.lit("."), F.lit(""))).otherwise(number)
    word = F.regexp_extract(low, r"^[^\d]*\d[\d,.]*\s*([a-z]*)", 1)
    table = F.create_map(*[x for w, n in MAGNITUDES.items() for x in (F.lit(w), F.lit(n).cast("decimal(10,0)"))])
    times = F.coalesce(F.element_at(table, word), F.lit(1).cast("decimal(10,0)"))
    amount = (number.try_cast("decimal(27,6)") * times).cast("decimal(38,6)")
    usd = text.rlike(r"(?i)\bUSD\b|\$")
    currency = F.when((text != "") & ~marked & usd, F.lit("USD")).otherwise(F.lit("PKR"))
    amount = F.when((text != "") & ~marked, let(amount, lambda a: F.when(a > 0, a)))
    return F.struct(amount.alias("amount"), currency.alias("currency"), text.alias("raw"))
