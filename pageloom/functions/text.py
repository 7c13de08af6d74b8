"""Text columns: cleaning, counting, line dedup, placeholder pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.binding import let
from pageloom.functions.regexes import WS, norm_ws, trim_ws

__all__ = ["clean", "cut_at_marker", "dedupe_lines", "is_challenge_page", "norm_ws", "strip_footer_dedup", "total_steps", "word_count"]

#: Phrases of pages shown in place of the real one. Fixed values.
CHALLENGES = ("just a moment", "checking your browser", "performing security", "please wait", "enable javascript and cookies", "ray id")
LONG_LINE = 40


def clean(t: Column) -> Column:
    """No carriage returns, single spaces, at most one blank line in a row, trimmed."""
    t = F.regexp_replace(F.replace(t, F.lit("\r"), F.lit("")), "[ \t]+", " ")
    return trim_ws(F.regexp_replace(t, "\n{3,}", "\n\n"))


def word_count(t: Column) -> Column:
    """Tokens between white space."""
    return F.size(F.filter(F.split(F.coalesce(t, F.lit("")), f"{WS}+"), lambda x: x != ""))


def cut_at_marker(t: Column, marker: str = "TOP_CONTROLS") -> Column:
    """The text before the marker; the whole text if the marker is absent or comes first."""
    at = F.instr(t, marker)
    return F.when(at > 1, F.substring(t, F.lit(1), at - 1)).otherwise(t)


def strip_footer_dedup(t: Column, marker: str = "TOP_CONTROLS") -> Column:
    """Cut at the marker unless it comes first; of equal lines of 40 or more characters keep the first.

    Equal lines stand together once they are sorted, so no line is looked up among the others.
    """
    lines = F.split(cut_at_marker(t, marker), "\n")
    keyed = F.sort_array(F.transform(lines, lambda x, i: F.struct(trim_ws(x).alias("key"), i.alias("at"))))

    def body(rows: Column) -> Column:
        new = lambda x, i: (F.length(x["key"]) < LONG_LINE) | F.coalesce(F.get(rows, i - 1)["key"] != x["key"], F.lit(True))
        kept = F.sort_array(F.transform(F.filter(rows, new), lambda x: x["at"]))
        return let(lines, lambda every: F.transform(kept, lambda i: F.get(every, i)))

    return F.array_join(let(keyed, body), "\n")


def dedupe_lines(t: Column) -> Column:
    """Equal lines once, in order of first appearance, then ``clean``."""
    return clean(F.array_join(F.array_distinct(F.filter(F.split(t, "\n+"), lambda x: x != "")), "\n"))


def is_challenge_page(title: Column, body: Column) -> Column:
    """Does the title, or the first 600 characters of the body, hold a placeholder phrase?"""
    # cut first: lower case never makes a text shorter, so the first 600 characters of it come from the first 600
    head = F.substring(F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 600)), 1, 600)
    both = F.concat_ws("\n", F.lower(F.coalesce(title, F.lit(""))), head)
    return both.rlike("|".join(CHALLENGES))


def total_steps(t: Column) -> Column:
    """m of "step n of m" in the first 500 characters."""
    found = F.regexp_extract(F.substring(t, 1, 500), rf"(?iu)(?:стъпка|step){WS}*[0-9]+{WS}*(?:от|of|/){WS}*([0-9]+)", 1)
    return F.when(found != "", found).try_cast("int")
