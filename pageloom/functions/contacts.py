"""E-mail addresses and phone numbers in text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.binding import let
from pageloom.functions.regexes import WS, ci, trim_ws

#: Patterns of addresses, phone candidates and dotted dates. Fixed values.
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE = rf"(\+?[0-9](?:[0-9().\/\-]|{WS}){{4,}}[0-9])"
DOTTED_DATE = r"\b[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}\b"
MOST = 20


def normalize_phone(raw: Column) -> Column:
    """Digits with a leading plus kept; empty for dates and for fewer than 7 or more than 15 digits."""
    s = trim_ws(F.translate(F.coalesce(raw, F.lit("")), " ‑", " -"))
    digits = F.regexp_replace(s, "[^0-9]", "")
    good = ~s.rlike(ci(DOTTED_DATE)) & F.length(digits).between(7, 15)
    return F.when(good, F.concat(F.when(s.startswith("+"), "+").otherwise(""), digits)).otherwise("")


def extract_emails(t: Column) -> Column:
    """Distinct addresses in order, 20 at most."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(EMAIL), 0)), 1, MOST)


def extract_phones(t: Column) -> Column:
    """Distinct numbers in order, 20 at most."""
    found = F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(PHONE), 1), normalize_phone)
    return F.slice(F.array_distinct(F.filter(found, lambda x: x != "")), 1, MOST)


def merge_contacts(*parts: Column) -> Column:
    """Union in order, trimmed, without empties, 20 at most."""
    whole = F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]))
    return F.slice(F.array_distinct(F.filter(F.transform(whole, trim_ws), lambda x: x != "")), 1, MOST)
