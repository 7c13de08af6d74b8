"""Crawl frontier: which pages of each site are reached, in which order, and what to fetch next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import urls

MAX_DEPTH, MAX_PAGES = 5, 40


def _bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Written as a table bucketed by ``keys`` and read back: later joins on them find it dealt out already.

    Its files lie in the shared checkpoint folder where one is named, else in the warehouse; both outlive executors.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortBy(*keys)
    folder = spark.conf.get("spark.checkpoint.dir", None)
    (writer.option("path", f"{folder.rstrip('/')}/{table}") if folder else writer).saveAsTable(table)
    return spark.table(table)


def settle_links(links: DataFrame) -> DataFrame:
    """(site, src_key, dst_key, dst_url, ord, of_home): each followed link once, bucketed by (site, src_key).

    The one shuffle of the links of a crawl: the first link of each (source, target) is found where the buckets are made.
    """
    of_home = F.col("source") != "all" if "source" in links.columns else F.lit(True)
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    good = links.filter(~urls.is_skippable_url(F.col("dst_url"))).select("site", "src_key", "dst_key", "dst_url", "ord", of_home.alias("of_home"))
    first = good.repartition(parts, "site", "src_key").groupBy("site", "src_key", "dst_key").agg(F.min_by("dst_url", "ord").alias("dst_url"), F.min("ord").alias("ord"), F.max("of_home").alias("of_home"))
    return _bucketed(first, "frontier_links", "site", "src_key")


def next_round(last: DataFrame, links: DataFrame, rounds: list[DataFrame], depth: int) -> DataFrame:
    """The pages first reached from those of the last round: (site, url_key, url, depth, priority, via, ord).

    ``last`` and ``links`` are bucketed alike, so their join moves nothing; the reached pages are aggregated and
    shuffled by (site, url_key), as the tables of all earlier rounds are bucketed, which the anti joins use.
    """
    step = last.select("site", F.col("url_key").alias("src_key"), "via").join(links.filter("of_home") if depth == 1 else links, ["site", "src_key"])
    reached = step.groupBy("site", F.col("dst_key").alias("url_key")).agg(F.min(F.struct("via", "ord", "dst_url", "src_key")).alias("f"))
    for seen in rounds:
        reached = reached.join(seen.select("site", "url_key"), ["site", "url_key"], "left_anti")
    priority = urls.is_priority_url(F.col("f.dst_url")) if depth == 1 else F.lit(False)
    return reached.select("site", "url_key", F.col("f.dst_url").alias("url"), F.lit(depth).alias("depth"), priority.alias("priority"), F.col("f.src_key").alias("via"), F.col("f.ord").cast("long").alias("ord"))


def crawl_frontier(home: DataFrame, links: DataFrame, max_depth: int = MAX_DEPTH, most: int | None = None) -> DataFrame:
    """(site, url, url_key, depth, priority, seq) of every page reached from the homes.

    ``home`` has site and url; ``links`` has site, src_key, dst_url, dst_key, ord and, optionally, source: then links of
    the home page come from its navigation and mined links only, not from those whose source is ``all``. Links of a home page that match the
    priority rule come first. With ``most``, only so many first pages of each site are kept, and ranked. Links that the skip rule names are not
    followed. At most ``max_depth`` rounds, each a table bucketed by (site, url_key); links are shuffled once for all rounds.
    """
    good = settle_links(links)
    homes = home.select("site", urls.url_key(F.col("url")).alias("url_key"), "url").groupBy("site", "url_key").agg(F.min("url").alias("url"))
    homes = homes.select("site", "url_key", "url", F.lit(0).alias("depth"), F.lit(True).alias("priority"), F.lit("").alias("via"), F.lit(0).cast("long").alias("ord"))
    rounds = [_bucketed(homes, "frontier", "site", "url_key")]
    for depth in range(1, max_depth + 1):
        rounds.append(_bucketed(next_round(rounds[-1], good, rounds, depth), "frontier", "site", "url_key"))
        if rounds[-1].isEmpty():
            break
    seen = rounds[0]
    for part in rounds[1:]:
        seen = seen.unionByName(part)
    order = Window.partitionBy("site").orderBy(F.desc("priority"), "depth", "via", "ord", "url_key")
    ranked = seen.withColumn("seq", F.row_number().over(order))
    ranked = ranked.filter(F.col("seq") <= most) if most is not None else ranked  # known to the ranking: each task keeps so many of a site
    return ranked.select("site", "url", "url_key", "depth", "priority", "seq")


def visited_pages(frontier: DataFrame, kept_pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """The first ``max_pages`` kept pages of each site in frontier order: (site, page_id, url_key, seq).

    ``kept_pages`` has page_id, site, url and optionally final_url: both mark the page as visited.
    """
    final = F.coalesce("final_url", "url") if "final_url" in kept_pages.columns else F.col("url")
    keys = kept_pages.select("page_id", "site", F.explode(F.array_distinct(F.array(urls.url_key(F.col("url")), urls.url_key(final)))).alias("url_key"))
    joined = frontier.join(keys, ["site", "url_key"]).groupBy("site", "page_id").agg(F.min(F.struct("seq", "url_key")).alias("f")).select("site", "page_id", "f.url_key", "f.seq")
    w = Window.partitionBy("site").orderBy("seq", "page_id")
    return joined.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_pages).drop("rank")


def next_urls(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """Frontier rows that have no page yet: the fetch list."""
    have = pages.select(urls.normalize_domain(F.col("url")).alias("site"), urls.url_key(F.col("url")).alias("url_key")).distinct()
    return frontier.join(have, ["site", "url_key"], "left_anti").select("site", "url", "url_key", "depth", "priority", "seq")
