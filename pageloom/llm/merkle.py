"""A manifest of a dataset as hash trees: a tree of the rows of each group, and one over the roots of these.

Aligned blocks of 256 nodes climb eight levels at once. A block keeps each level as one string of 64 hex
digits a node; the parents are hashes of its substrings of fixed width, and what stands on either side of
a node in its run of two are its siblings. The roots of blocks are the nodes of the next step, until one is left.
No step holds more than a block in one row, and nothing but the size of the largest group comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import write_shared

#: Levels that a block climbs at once, nodes of a block, and hex digits of a digest.
LEVELS = 8
BLOCK = 1 << LEVELS
WIDTH = 64


def leaf_digest(fields: Sequence[Column]) -> Column:
    """sha256 of the fields one after another: ``-`` for a null, else the UTF-8 byte count, ``:`` and the value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def fold(digest: Column, path: Column) -> Column:
    """The root that a digest leads to along its path, an array of (left, right) siblings from the bottom."""
    return F.aggregate(path, digest, lambda at, by: F.sha2(F.concat(by["left"], at, by["right"]), 256))


def proof(path: Column) -> Column:
    """The siblings of a path in one string."""
    return F.array_join(F.transform(path, lambda by: F.concat(by["left"], by["right"])), "")


def _height(total: Column) -> Column:
    return F.when(total > 1, F.length(F.bin(total - 1))).otherwise(0)


def _ranked(leaves: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """Every leaf with its place in its tree and the tree's size, and the largest size.

    Places come from a range partitioning and the counts of its parts, so a tree with most of the rows is
    dealt over many tasks. Equal leaves are told apart by their row of the written table.
    """
    named = write_shared(leaves.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    keys = ["_tree", *order, "_digest", "_row"]
    ranged = write_shared(named.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_at", 33).alias("_part")
    counted = ranged.groupBy("_tree", part).agg(F.min("_at").alias("_least"), F.count(F.lit(1)).alias("_n"))
    parts, tree = Window.partitionBy("_tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_tree")
    counted = write_shared(counted.select("_tree", "_part", "_least", F.coalesce(F.sum("_n").over(parts), F.lit(0)).alias("_before"), F.sum("_n").over(tree).alias("_total")), "counts")
    placed = ranged.withColumn("_part", part).join(counted, ["_tree", "_part"])
    most = counted.agg(F.max("_total")).first()[0] or 0
    return placed.withColumn("_place", F.col("_at") - F.col("_least") + F.col("_before")).drop("_part", "_at", "_least", "_before", "_row"), most


def _parents(level: Column) -> Column:
    """The next level of a block's string, one hash for each run of two nodes."""
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / (2 * WIDTH)).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda k: F.sha2(F.substring(level, k * 2 * WIDTH + 1, F.lit(2 * WIDTH)), 256)), "").cast("binary")


def _blocks(nodes: DataFrame, carried: Sequence[str]) -> DataFrame:
    """(_tree, _block, _total, _members, _levels): the members of each aligned block and its levels up to its root.

    A level is the bytes of its hex string, as substrings of bytes need no search for the start.
    """
    member = F.struct((F.col("_place") % BLOCK).cast("int").alias("place"), F.col("_digest").alias("digest"), *carried)
    held = nodes.groupBy("_tree", F.shiftright("_place", LEVELS).alias("_block")).agg(F.sort_array(F.collect_list(member)).alias("_members"), F.first("_total").alias("_total"))
    base = F.array(F.array_join(F.transform("_members", lambda m: m["digest"]), "").cast("binary"))
    steps = F.least(F.lit(LEVELS), _height(F.col("_total")))
    climbed = F.aggregate(F.sequence(F.lit(1), steps), base, lambda levels, _: F.concat(levels, F.array(_parents(F.element_at(levels, -1)))))
    return held.withColumn("_levels", F.when(steps > 0, climbed).otherwise(base))


def _climb(leaves: DataFrame, order: Sequence[str], carried: Sequence[str]) -> list[DataFrame]:
    """Written blocks of every step, from the leaves to one block a tree."""
    nodes, most = _ranked(leaves, order)
    steps = [write_shared(_blocks(nodes, carried), "blocks")]
    while most > BLOCK:
        most = -(-most // BLOCK)
        steps.append(write_shared(_blocks(_roots(steps[-1]), []), "blocks"))
    return steps


def _roots(blocks: DataFrame) -> DataFrame:
    """The roots of blocks as nodes of the next step."""
    total = F.ceil(F.col("_total") / BLOCK).cast("long").alias("_total")
    return blocks.select("_tree", F.col("_block").alias("_place"), F.element_at("_levels", -1).cast("string").alias("_digest"), total)


def _descend(blocks: DataFrame, above: DataFrame, kept: Sequence[str]) -> DataFrame:
    """Members of blocks with the whole path from them up; ``above`` has the path of each block's root."""
    joined = blocks.join(above, ["_tree", "_block"])

    def siblings(place: Column) -> Column:
        def at(level: Column, k: Column) -> Column:
            here = F.call_function("shiftright", place, k)
            left = F.substring(level, WIDTH * (here - here % 2) + 1, WIDTH * (here % 2))
            right = F.substring(level, WIDTH * (here + 1) + 1, WIDTH * (1 - here % 2))
            return F.struct(left.cast("string").alias("left"), right.cast("string").alias("right"))

        below = F.slice("_levels", 1, F.size("_levels") - 1)
        return F.concat(F.transform(below, at), F.col("_path"))

    found = F.transform("_members", lambda m: F.struct(m.alias("m"), siblings(m["place"]).alias("path")))
    return joined.select("_tree", "_block", *kept, F.explode(found).alias("_at"))


def _paths(steps: list[DataFrame], above: DataFrame, kept: Sequence[str]) -> DataFrame:
    """Every leaf's member, ``_tree`` and path; ``above`` has path and kept columns of each tree's root."""
    above = above.withColumn("_block", F.lit(0).cast("long"))
    for blocks in reversed(steps[1:]):
        found = _descend(blocks, above, kept)
        place = F.col("_block") * BLOCK + F.col("_at.m.place")
        above = found.select("_tree", place.alias("_block"), *kept, F.col("_at.path").alias("_path"))
    return _descend(steps[0], above, kept)


def proofs(leaves: DataFrame, group: str, order: str, digest: str = "leaf") -> DataFrame:
    """Every row with ``subroot``, ``root`` and ``path``: what lies beside it on the way to the root of all.

    ``leaves`` has a digest of each row, the group whose tree it stands in, the column it is ordered by
    and columns to keep (those named subroot, root or path are replaced). A null group is a group of its
    own and the first of all; groups follow bytewise. Null order values come first; rows of equal ones are
    ordered by digest, so their order does not show in any root; repeated rows are leaves of their own.
    The last run of a level may be one node, which is hashed alone. A group of one row has its digest as
    subroot, one group alone has its subroot as root, and an empty table gives no rows.
    """
    kept = [c for c in leaves.columns if c not in ("subroot", "root", "path")]
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    own = leaves.select(tree.alias("_tree"), F.col(digest).alias("_digest"), F.col(order).alias("_order"), F.struct(*kept).alias("row"))
    steps = _climb(own, ["_order"], ["row"])
    subroots = _roots(steps[-1]).select(F.lit("").alias("_tree"), F.col("_tree").alias("of"), "_digest")
    top = _climb(subroots, ["of"], ["of"])
    roots = _roots(top[-1]).select("_tree", F.col("_digest").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("_path"))
    found = _paths(top, roots, ["root"])
    above = write_shared(found.select(F.col("_at.m.of").alias("_tree"), F.col("_at.m.digest").alias("subroot"), "root", F.col("_at.path").alias("_path")), "subroots")
    rows = _paths(steps, above, ["subroot", "root"])
    return rows.select("_at.m.row.*", "subroot", "root", F.col("_at.path").alias("path"))


def audit(leaves: DataFrame, group: str, order: str, digest: str = "leaf", claimed: str = "claimed") -> DataFrame:
    """``proofs`` with ``proof``, and whether the digest in ``claimed`` (the row's own where null) leads to the root.

    Adds ``proof``, ``folded_root`` and ``verified``; keeps ``path``.
    """
    proven = proofs(leaves, group, order, digest)
    folded = fold(F.coalesce(F.col(claimed), F.col(digest)), F.col("path"))
    return proven.withColumns({"proof": proof(F.col("path")), "folded_root": folded}).withColumn("verified", F.col("folded_root") == F.col("root"))
