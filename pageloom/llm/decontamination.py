"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks.

A window has as many words as a benchmark item. Windows whose SimHash differs from
the item's in at most ``RADIUS`` of 64 bits share at least one of ``RADIUS + 1``
blocks with it, so an equi-join on (words, block, value) finds all of them; the exact
weighted Jaccard similarity of five-word shingles then decides.

Which windows are hashed: a window as similar as ``SIMILARITY`` lacks less than a
ninth of the item's shingle weight, so it holds one of any few of its shingles that
together weigh more than that. These probes are looked up at every word of every
text, and every item-sized window around a hit that holds the probe whole is hashed, so none that can be
similar enough is left out; where a window equals the item word by word, it alone is, as none is more similar.
Shorter items are looked up by their own number of words. SimHash is an estimate: a
similar window farther than the radius is missed (four changed words in forty
give about nine bits, so this is rare).

Only DataFrame and SQL functions. Words are lower-case runs of letters and digits.
Defined cases: null and empty texts and items have no windows; an item of fewer than
five words is one shingle; repeated rows and repeated items each get their own
results; a null item_id is a value like any other; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import row_key, write_shared

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
BITS = 64
#: Up to so many probes are put into the plan as a literal set; more are joined.
MAX_LITERAL_PROBES = 20_000
#: Up to so many keys of 16 bytes are broadcast.
MAX_BROADCAST_KEYS = 500_000


def words(text: str) -> Column:
    """Lower-case runs of letters and digits of a text, in order."""
    return F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "")


def _shingle_hashes(array_sql: str) -> str:
    """SQL of the hashes of all five-word shingles (of the whole array if it is shorter)."""
    inner = ", ".join(f"try_element_at(ws, i + {k})" for k in range(1, SHINGLE + 1))
    return f"""
        element_at(transform(array({array_sql}), ws ->
            transform(sequence(0, greatest(size(ws) - {SHINGLE}, 0)), i -> xxhash64({inner}))), 1)
    """


def simhash(array_sql: str) -> str:
    """SQL of the 64-bit SimHash of an array of words."""
    return f"""
        aggregate(
            transform({array_sql}, w -> xxhash64(w)),
            array_repeat(0, {BITS}),
            (acc, h) -> transform(acc, (a, b) -> a + CAST(2 * (shiftright(h, b) & 1L) - 1L AS INT)),
            acc -> aggregate(sequence(0, {BITS - 1}), 0L, (f, b) -> f | IF(element_at(acc, b + 1) > 0, shiftleft(1L, b), 0L))
        )
    """


def _blocks(fingerprint: str) -> Column:
    """(block, value) of the ``RADIUS + 1`` blocks of a fingerprint."""
    size = BITS // (RADIUS + 1)
    return F.expr(f"transform(sequence(0, {RADIUS}), b -> struct(b AS block, shiftright({fingerprint}, b * {size}) & {(1 << size) - 1}L AS value))")


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, item_words, n_words, shingles, weights, item_fp): items with words; ``item`` numbers distinct (id, text) rows."""
    items = (
        benchmark.select("item_id", "text").distinct().withColumn("item_words", words("text")).filter(F.size("item_words") > 0)
        .withColumn("item", row_key("item_id", "text")).withColumn("n_words", F.size("item_words"))
        .withColumn("shingles", F.expr(_shingle_hashes("item_words"))).drop("text")
    )
    return items.withColumn("item_fp", F.expr(simhash("item_words")))


def shingle_weights(items: DataFrame, n_items: int) -> tuple[DataFrame, Column]:
    """Weight of every benchmark shingle, 1 + ln(items / items with it), and of any other shingle."""
    each = items.select("item", F.explode(F.array_distinct("shingles")).alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("held"))
    return each.select("shingle", (1 + F.log(F.lit(float(n_items)) / F.col("held"))).alias("w")), 1 + F.log(F.lit(float(max(n_items, 1))))


def probe_shingles(items: DataFrame, weights: DataFrame) -> DataFrame:
    """(probe, item, place, words of the item): the first places of a spread-out order whose weights pass the allowance of each item.

    A shingle that an item holds k times counts k times. A window with similarity s to the item shares at least
    s of its weight; the chosen distinct shingles with all their repeats weigh more than (1 - s) of it, so one of
    them is in every such window.
    """
    from pyspark.sql import Window

    placed = items.select("item", F.posexplode("shingles").alias("place", "probe")).groupBy("item", "probe").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("times"))
    placed = placed.join(weights, F.col("probe") == F.col("shingle")).withColumn("w", F.col("w") * F.col("times")).drop("shingle", "times")
    spread = Window.partitionBy("item").orderBy(F.expr(f"place % {SHINGLE}"), "place")
    whole = F.sum("w").over(Window.partitionBy("item"))
    before = F.coalesce(F.sum("w").over(spread.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return placed.withColumn("before", before).withColumn("whole", whole).filter(F.col("before") <= F.lit(1 - SIMILARITY + 1e-9) * F.col("whole")).join(items.select("item", F.col("n_words").alias("words")), "item").select("probe", "item", "place", "words")


def _hits(docs: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, doc_words, at, probe): every place of a probe in a text, with the words of the texts that have one."""
    distinct = probes.select("probe").distinct()
    few = [r[0] for r in distinct.limit(MAX_LITERAL_PROBES + 1).collect()]
    if not few:
        few = [None]
    places = _places(sorted(r[0] for r in probes.filter(F.col("words") < SHINGLE).select("words").distinct().collect()))
    if len(few) <= MAX_LITERAL_PROBES:
        listed = ", ".join(f"{p}L" if p != -(1 << 63) else "(-9223372036854775807L - 1L)" for p in few if p is not None) or "NULL"
        found = " , ".join(f"filter({p}, x -> x.probe IN ({listed}))" for p in places)
        inside = f"element_at(transform(array(doc_words), ws -> concat({found})), 1)"
        return docs.withColumn("hits", F.expr(inside)).filter(F.size("hits") > 0).select("key", "doc_words", F.explode("hits").alias("x")).select("key", "doc_words", "x.at", "x.probe")
    hashed = docs.select("key", F.explode(F.expr(f"element_at(transform(array(doc_words), ws -> concat({', '.join(places)})), 1)")).alias("x")).select("key", "x.at", "x.probe")
    found = hashed.join(distinct, "probe").groupBy("key").agg(F.collect_set(F.struct("at", "probe")).alias("hits"))
    return docs.join(found, "key").select("key", "doc_words", F.explode("hits").alias("x")).select("key", "doc_words", "x.at", "x.probe")


def _places(short: list[int]) -> list[str]:
    """SQL of arrays of (at, probe) over the words ws: all five-word shingles, and those of each shorter item length."""

    def hashed(n: int) -> str:
        return f"xxhash64({', '.join(f'try_element_at(ws, i + {k})' for k in range(1, n + 1))})"

    out = [f"transform(sequence(0, greatest(size(ws) - {SHINGLE}, 0)), i -> struct(i AS at, {hashed(SHINGLE)} AS probe))"]
    return out + [f"transform(filter(sequence(0, greatest(size(ws) - {n}, 0)), i -> i + {n} <= size(ws)), i -> struct(i AS at, {hashed(n)} AS probe))" for n in short]


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity): the most similar window of each document and item."""
    from pyspark.sql import Window

    items = write_shared(benchmark_items(benchmark), "items")
    weights, w_other = shingle_weights(items, items.count())
    weights = write_shared(weights, "item-shingles")
    probes = write_shared(probe_shingles(items, weights), "probes")
    texts = docs.select("doc_id", "text").withColumn("key", row_key("doc_id", "text"))
    read = texts.select("key", "doc_id", words("text").alias("doc_words")).filter(F.size("doc_words") > 0)
    # a short list of probes is sent to the hits; a long one meets them in a shuffle
    known = probes.withColumnRenamed("words", "n_words")
    known = F.broadcast(known) if probes.limit(MAX_LITERAL_PROBES + 1).count() <= MAX_LITERAL_PROBES else known
    own = items.select("item", "item_words")
    own = F.broadcast(own) if (items.agg(F.sum("n_words")).first()[0] or 0) <= 50 * MAX_LITERAL_PROBES else own
    # around each hit the words that a window with the whole probe can have; ``base`` is the place of the first
    region = F.expr("slice(doc_words, base + 1, least(size(doc_words), at + n_words) - base)")
    around = (
        _hits(read.withColumn("key", F.struct("key", "doc_id")), probes).join(known, "probe").filter(F.col("n_words") <= F.size("doc_words"))
        .withColumn("last", F.size("doc_words") - F.col("n_words"))
        .withColumn("base", F.least(F.greatest(F.col("at") + F.least("n_words", F.lit(SHINGLE)) - F.col("n_words"), F.lit(0)), F.col("last")))
        .select("key", "item", "n_words", "at", "place", "base", F.least("at", "last").alias("last"), region.alias("region"))
    )
    around = around.join(own, "item").withColumn("start_word", F.col("at") - F.col("place"))
    whole = F.expr("IF(start_word >= base AND start_word <= last, slice(region, start_word - base + 1, n_words) = item_words, false)")
    around = write_shared(around.withColumn("whole", whole).drop("item_words"), "windows")
    exact = around.filter("whole").groupBy("key", "item").agg(F.min("start_word").alias("start_word"), F.min_by(F.expr("slice(region, start_word - base + 1, n_words)"), "start_word").alias("window"), F.min("n_words").alias("n_words"))
    exact = write_shared(exact, "whole-items")
    other = around.filter(~F.col("whole")).join(exact.select("key", "item"), ["key", "item"], "left_anti")
    other = other.select("key", "n_words", "base", "region", F.explode(F.sequence("base", "last")).alias("start_word"))
    other = other.select("key", "n_words", "start_word", F.expr("slice(region, start_word - base + 1, n_words)").alias("window"))
    starts = exact.select("key", "n_words", "start_word", "window").unionAll(other).dropDuplicates(["key", "n_words", "start_word"])
    windows = starts.withColumn("window_fp", F.expr(simhash("window")))
    indexed = items.select("item", "item_id", "n_words", "item_fp", "shingles", F.explode(_blocks("item_fp")).alias("b")).select("item", "item_id", "n_words", "item_fp", "shingles", "b.block", "b.value")
    near = (
        windows.withColumn("b", F.explode(_blocks("window_fp"))).select("key", "n_words", "start_word", "window", "window_fp", "b.block", "b.value")
        .join(indexed, ["n_words", "block", "value"])
        .withColumn("hamming", F.bit_count(F.col("window_fp").bitwiseXOR(F.col("item_fp"))))
        .filter(F.col("hamming") <= RADIUS)
        .dropDuplicates(["key", "start_word", "item"])
        .withColumn("theirs", F.expr(_shingle_hashes("window")))
    )
    # weighted Jaccard: shingles of either side, with the smaller and the larger count of each
    sides = near.select("key", "start_word", "item", "item_id", "n_words", "hamming", F.explode(F.expr("""
        transform(array_distinct(concat(shingles, theirs)), s -> struct(s AS shingle,
            size(filter(shingles, x -> x = s)) AS mine, size(filter(theirs, x -> x = s)) AS yours))""")).alias("s"))
    sides = sides.select("key", "start_word", "item", "item_id", "n_words", "hamming", "s.*").join(weights, "shingle", "left")
    w = F.coalesce(F.col("w"), w_other)
    judged = (
        sides.groupBy("key", "start_word", "item", "item_id", "n_words", "hamming")
        .agg((F.sum(F.least("mine", "yours") * w) / F.sum(F.greatest("mine", "yours") * w)).alias("similarity"))
        .filter(F.col("similarity") >= SIMILARITY - 1e-9)
    )
    best = Window.partitionBy("key", "item").orderBy(F.desc("similarity"), "start_word")
    judged = judged.withColumn("rank", F.row_number().over(best)).filter("rank = 1")
    found = judged.select(F.col("key.key").alias("key"), F.col("key.doc_id").alias("doc_id"), "item_id", "start_word", "n_words", "hamming", "similarity")
    return found


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``contaminations`` without the row key: repeated rows of a document are reported once."""
    return contaminations(docs, benchmark).drop("key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    bad = write_shared(contaminations(docs, benchmark).select(F.col("key").alias("_dc_bad")).distinct(), "contaminated")
    # few keys are sent to the documents; more meet them in a shuffle
    bad = F.broadcast(bad) if bad.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS else bad
    keyed = docs.withColumn("_dc_key", row_key("doc_id", "text"))
    return keyed.join(bad, F.col("_dc_key") == F.col("_dc_bad"), "left_anti").drop("_dc_key")
