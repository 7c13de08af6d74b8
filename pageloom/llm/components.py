"""Connected components of a link table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import write_shared


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node passes its smallest neighbour (or itself) to its larger neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("m").alias("u"), "v")
    return moved.filter(F.col("u") != F.col("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node passes its smallest neighbour to itself and its smaller neighbours."""
    down = edges.select(F.least("u", "v").alias("small"), F.greatest("u", "v").alias("big"))
    least = down.groupBy("big").agg(F.min("small").alias("m"))
    moved = down.join(least, "big").select(F.col("m").alias("u"), F.col("small").alias("v"))
    own = least.select(F.col("m").alias("u"), F.col("big").alias("v"))
    return moved.unionAll(own).filter(F.col("u") != F.col("v")).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of its component for every node with a link.

    ``edges`` has columns u and v. Each round is written to the shared folder, which
    cuts the lineage; nothing but a count and a checksum comes to the driver. Hot
    nodes are pre-aggregated (min) and joined, never gathered.
    """
    edges = write_shared(edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct(), "links")
    seen = _digest(edges)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        edges = write_shared(_small_star(_large_star(edges)), "links")
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    roots = edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return nodes.unionAll(roots)
