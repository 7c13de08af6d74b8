"""Stable JSON and fingerprints of schemas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rewrites that make cosmetic differences disappear: (pattern, replacement). Fixed values.
TEMPLATE = (
    (r"#[A-Za-z0-9_]+", "#ID"),
    (r":nth-of-type\([0-9]+\)", ":nth-of-type(N)"),
    (r"(?<![A-Za-z0-9_])(field|input)_[0-9]+(?![A-Za-z0-9_])", "$1_N"),
    (r'"selector_candidates":\[[^\]]*\]', '"selector_candidates":["GENERIC"]'),
    (r'"price_text":"[^"]*"', '"price_text":"PRICE"'),
)


def stable_json(c: Column) -> Column:
    """JSON text with sorted keys at every level, array order kept; null if it is no JSON."""
    return F.to_json(F.try_parse_json(c))


def fingerprint(kind: Column, schema: Column) -> Column:
    """SHA-256 of the stable JSON of {kind, schema}."""
    return F.sha2(F.concat(F.lit('{"kind":"'), kind, F.lit('","schema":'), stable_json(schema), F.lit("}")), 256)


def template_fingerprint(kind: Column, schema: Column) -> Column:
    """SHA-256 of the kind and the stable JSON after the template rewrites."""
    text = stable_json(schema)
    for pattern, new in TEMPLATE:
        text = F.regexp_replace(text, pattern, new)
    return F.sha2(F.concat(kind, F.lit("|"), text), 256)
