"""Pattern pieces that keep the meaning of browser regular expressions on the JVM.

A word boundary is ASCII, white space includes the Unicode spaces, case folding covers all scripts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of ECMAScript. Fixed value.
WS = r"[\t\n\x0B\f\r    -     　﻿]"
NOT_WS = WS.replace("[", "[^", 1)
#: The same class for RE2, used in oracle SQL. Fixed value.
RE2_WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
RE2_NOT_WS = RE2_WS.replace("[", "[^", 1)
#: ASCII word boundary.
B = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ci(pattern: str) -> str:
    """Case-insensitive in every script; ``\\b`` becomes the ASCII boundary."""
    return "(?iu)" + pattern.replace(r"\b", B)


def matches(c: Column, pattern: str) -> Column:
    """Does the pattern occur, ignoring case; false for null."""
    return F.coalesce(c.rlike(ci(pattern)), F.lit(False))


def trim_ws(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def norm_ws(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, f"(?![!-~]){WS}+", " "))  # most characters are told from white space by one range
