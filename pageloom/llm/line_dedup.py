"""Line dedup by site-relative frequency.

Per host, the share of its pages that contain a line decides: a line on more
than ``ratio`` of the host's pages (and on at least ``min_pages`` of them) is
boilerplate and goes from every page of that host. Only DataFrame functions.

Defined cases: a null text stays null and has no lines; an empty text stays
empty; blank lines are never boilerplate; lines are compared without
surrounding spaces; rows with a null host form one host; repeated rows count
as pages of their own; columns named ``n_lines`` or ``n_removed`` are replaced, others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import write_shared

RATIO = 0.03
MIN_PAGES = 5
#: Up to so many line hashes (of 8 bytes) are broadcast.
MAX_BROADCAST_LINES = 500_000


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def boilerplate_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Boilerplate per host: (host, line_hash, n_pages, host_pages).

    A line travels as its 64-bit hash. Counting is pre-aggregated on
    (host, hash), so a host with a third of all pages is spread by its lines; a
    host holds at most (mean distinct lines per page / ratio) boilerplate lines.
    """
    pages = docs.select(F.col(host).alias("host"), F.col(text).alias("text"))
    hashes = F.transform(F.filter(F.array_distinct(F.transform(_lines("text"), lambda x: F.trim(x))), lambda x: x != ""), lambda x: F.xxhash64(x))
    counted = (
        pages.select("host", F.explode(hashes).alias("line_hash"))
        .groupBy("host", "line_hash")
        .agg(F.count(F.lit(1)).alias("n_pages"))
        .filter(F.col("n_pages") >= min_pages)
    )
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages")).withColumnRenamed("host", "of_host")
    return (
        counted.join(totals, F.col("host").eqNullSafe(F.col("of_host")))
        .filter(F.col("n_pages") > F.lit(ratio) * F.col("host_pages"))
        .select("host", "line_hash", "n_pages", "host_pages")
    )


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with the boilerplate lines cut from ``text``, plus n_lines and n_removed."""
    listed = boilerplate_lines(docs, host, text, ratio, min_pages).groupBy(F.col("host").alias("_bp_host")).agg(F.collect_set("line_hash").alias("_bp_lines"))
    listed = write_shared(listed, "boilerplate")
    size = listed.agg(F.sum(F.size("_bp_lines")), F.count(F.lit(1))).first()
    # a small list is sent to the pages; a large one meets them in a join whose hot hosts Spark splits
    side = F.broadcast(listed) if (size[0] or 0) + size[1] <= MAX_BROADCAST_LINES else listed
    joined = docs.join(side, docs[host].eqNullSafe(listed["_bp_host"]), "left")
    lines = _lines(text)
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("_bp_lines"), F.xxhash64(F.trim(x))))
    kept = F.when(F.col("_bp_lines").isNull(), lines).otherwise(kept)
    return (
        joined.withColumn("_bp_kept", kept)
        .withColumn("n_lines", F.coalesce(F.size(F.when(F.col(text).isNotNull(), lines)), F.lit(0)))
        .withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.col("n_lines")))
        .withColumn("n_removed", F.when(F.col(text).isNull(), 0).otherwise(F.col("n_lines") - F.size("_bp_kept")))
        .withColumn(text, F.array_join("_bp_kept", "\n"))
        .drop("_bp_host", "_bp_lines", "_bp_kept")
    )
