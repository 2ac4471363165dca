"""Phone numbers that pages publish.  Gated contacts are never derived."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let, normalize_digits

_SEP = "[ \\t\\-.()\u00a0]?"
_CANDIDATE = rf"((?<!\d)(?:\+92|0092|0){_SEP}(?:\d{_SEP}){{8,11}}(?!\d))"


def normalize_phone(raw: Column) -> Column:
    """'+92…' or null where the number is implausible."""
    return let(F.regexp_replace(normalize_digits(raw), r"\D", ""), lambda d: let(_national(d), _plausible))


def _national(d: Column) -> Column:
    return F.when(d.startswith("0092"), F.substring(d, 5, 99)).when(d.startswith("92") & (F.length(d) >= 12), F.substring(d, 3, 99)).when(d.startswith("0"), F.ltrim(d, F.lit("0"))).otherwise(d)


def _plausible(n: Column) -> Column:
    size = F.length(n)
    fits = F.when(n.startswith("3"), size == 10).otherwise(size.between(9, 10))
    return F.when(fits & (F.size(F.array_distinct(F.split(n, ""))) > 2), F.concat(F.lit("+92"), n))


def extract_phone(text: Column) -> Column:
    """The first plausible number in a text."""
    found = F.transform(F.regexp_extract_all(normalize_digits(text), F.lit(_CANDIDATE), F.lit(1)), normalize_phone)
    return F.get(F.filter(found, lambda p: p.isNotNull()), 0)


def mask_phone(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.substring(c, 1, 6), F.lit("*******")))


def phone_policy(phone: Column, texts: list[Column], collect: bool = True) -> Column:
    """Nothing where collection is off; a known number stays; else the first in the texts."""
    if not collect:
        return F.lit(None).cast("string")
    return F.coalesce(phone, *[extract_phone(t) for t in texts])


def published_phone(gated: Column, primary: Column, mobile: Column, mobiles: Column, phones: Column, whatsapp: Column) -> Column:
    """The first valid published number; null wherever the page wants a login."""
    none = F.array().cast("array<string>")
    each = F.concat(F.array(primary, mobile), F.coalesce(mobiles, none), F.coalesce(phones, none), F.array(whatsapp))
    first = F.get(F.filter(F.transform(each, normalize_phone), lambda p: p.isNotNull()), 0)
    return F.when(F.coalesce(gated, F.lit(False)), F.lit(None).cast("string")).otherwise(first)
