"""Near-duplicate classes by improved consistent weighted sampling (ICWS).

A text is its weighted five-word shingles: the count times the mean IDF of the five words.
A word's IDF is 1 + ln(1 / f) / ln 50 with f its share of texts, not under 1/50: it
runs from 1 to 2, and only the words in at least a fiftieth of the texts need be
known (no more than 50 times the mean number of words of a text). Each of
``BANDS * ROWS`` samples is drawn with probability equal to weighted Jaccard; texts that share a
band of ``ROWS`` samples are candidates, and their exact weighted Jaccard
similarity of ``SIMILARITY`` or more links them. Classes are the connected components.

Every candidate pair whose link could join two components is settled, though not every one is compared. Exact
copies collapse first: one text of each is a node. In a band's bucket every node is compared with the
bucket's medoid, the node nearest to the mean of their sketches, and with its lightest one, which leaves the
bucket's main component and texts apart from it. Two bounds of what two texts share then decide which of the pairs that are still
in different components are compared: the sum of the smaller weights of their sketches (a sketch is a text's weight
in each of ``GROUPS`` groups of shingles) and, in crowded buckets, the weight of the shingles that either shares with any
text at all there. Both are exact, so no link is lost. The number
of pairs compared follows the texts; looking at the bounds costs the texts apart times the bucket.

Defined cases: null and empty texts and texts of blanks have no shingles; equal ones form a class by
their text; null ids are ids like any other; repeated rows share the class; an empty table
gives an empty result; other columns are ignored by the classes and kept by ``drop_near_copies``; a text is
held whole in one task, with about fifteen 8-byte arrays over its words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import row_key, text_bytes, write_shared
from pageloom.llm.components import connected_components
from pageloom.llm.shingles import WORDS, mix, shingles, word_hashes

BANDS, ROWS = 8, 3
SAMPLES = BANDS * ROWS
SIMILARITY = 0.8
RARE = 50
#: Groups of shingles of a sketch, and of the coarse one that medoids are found by.
GROUPS, COARSE = 128, 16
#: In buckets with so many pairs apart the shingles that a text shares with no other are counted; it changes no result.
CROWDED = 20_000
BLOCK_BYTES = 2 << 20
_U64 = np.uint64


def _blocks(column, most: int = BLOCK_BYTES):
    data, offsets = text_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, min(first + 2000, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def common_words(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray, np.ndarray]:
    """(texts, hashes, IDF) of the words in at least 1/``RARE`` of all texts, by hash."""

    def count(batches):
        import pyarrow as pa

        held: list[np.ndarray] = []

        def emit():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for at in range(0, len(keys), 50_000):
                yield pa.record_batch([pa.array(keys[at : at + 50_000].view(np.int64)), pa.array(n[at : at + 50_000])], names=["word", "n"])

        size, rows = 0, 0
        for batch in batches:
            for first, last, data, offsets in _blocks(batch.column(0)):
                rows += last - first
                words, ends = word_hashes(data, offsets)
                if len(words):
                    # distinct words of each text: 11 bits of the text's place, 53 of the word
                    place = np.repeat(np.arange(last - first, dtype=np.uint64), np.diff(ends))
                    keys = np.sort((words & _U64((1 << 53) - 1)) | (place << _U64(53)))
                    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] & _U64((1 << 53) - 1)
                    held.append(keys)
                    size += len(keys)
                if size > 3_000_000:
                    yield from emit()
                    size = 0
        if held:
            yield from emit()
        yield pa.record_batch([pa.array([-1]), pa.array([rows])], names=["word", "n"])  # hashes are not negative

    total = write_shared(docs.select(text).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    n_texts = sum(r["n"] for r in total.filter("word = -1").collect())
    # at most RARE * (mean distinct words of a text) rows: a bound that does not grow with the table
    common = total.filter((F.col("word") >= 0) & (F.col("n") * RARE >= n_texts)).orderBy("word").collect()
    hashes = np.array([r["word"] for r in common], np.int64).view(_U64)
    share = np.array([r["n"] for r in common], float) / max(n_texts, 1)
    return n_texts, hashes, (1 + np.log(1 / np.minimum(share, 1.0)) / np.log(RARE)).astype(np.float64)


def weighted_shingles(data, offsets, hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight), each pair of text and shingle once, ordered by text and shingle."""
    words, ends = word_hashes(data, offsets)
    text, first, keys = shingles(words, ends)
    if not len(keys):
        return text, keys, np.zeros(0)
    low = words & _U64((1 << 53) - 1)
    weight = np.full(len(words), 2.0)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, low), len(hashes) - 1)
        weight = np.where(hashes[at] == low, idf[at], 2.0)
    sums = np.concatenate(([0.0], np.cumsum(np.rint(weight * (1 << 20)))))  # whole numbers: equal shingles get equal weights
    upto = np.minimum(first + WORDS, ends[text + 1])
    mean = (sums[upto] - sums[first]) / (upto - first) / (1 << 20)
    combined = (text.astype(_U64) << _U64(50)) | (keys >> _U64(14))
    order = np.argsort(combined)
    combined = combined[order]
    starts = np.flatnonzero(np.concatenate(([True], combined[1:] != combined[:-1])))
    counts = np.diff(np.append(starts, len(combined)))
    picked = order[starts]
    return text[picked], keys[picked], counts * mean[picked]


_LOW = _U64((1 << 21) - 1)


def signatures(n_texts: int, text: np.ndarray, keys: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """ICWS samples, one row a text: 64-bit codes of (shingle, quantised weight); 0 for texts without shingles."""
    out = np.zeros((n_texts, SAMPLES), _U64)
    if not len(keys):
        return out
    starts = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    counts = np.diff(np.append(starts, len(text)))
    owner = text[starts]
    for first in range(0, len(starts), 200):  # a few hundred kB at a time
        last = min(first + 200, len(starts))
        a, b = starts[first], starts[last - 1] + counts[last - 1]
        k, log_w = keys[a:b], np.log(weight[a:b]).astype(np.float32)
        at, size = starts[first:last] - a, counts[first:last]
        for s in range(SAMPLES):
            x = mix(k + _U64((s + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)))
            y = (x ^ (x >> _U64(33))) * _U64(0xFF51AFD7ED558CCD)
            y ^= y >> _U64(29)
            unit = lambda v: (v & _LOW).astype(np.float32) * np.float32(2**-21) + np.float32(2**-22)
            r = -np.log(unit(x) * unit(x >> _U64(21)))
            c = -np.log(unit(x >> _U64(42)) * unit(y))
            beta = unit(y >> _U64(21))
            t = np.floor(log_w / r + beta)
            cost = np.log(c) - r * (t - beta + np.float32(1))
            least = np.minimum.reduceat(cost, at)
            hit = np.flatnonzero(cost == np.repeat(least, size))
            hit = hit[np.searchsorted(hit, at)]  # the first of each text
            out[owner[first:last], s] = mix(k[hit] ^ (t[hit].astype(np.int64).view(_U64) * _U64(0xD6E8FEB86659FD93)))
    return out


def bands_of(samples: np.ndarray) -> np.ndarray:
    """One 64-bit value a band."""
    out = np.zeros((len(samples), BANDS), _U64)
    for k in range(ROWS):
        out = mix(out * _U64(31) + samples[:, k::ROWS][:, :BANDS])
    return out


def sign(docs: DataFrame, model: tuple[int, np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, key, bands): bands are null for texts without shingles."""
    _, hashes, idf = model

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for first, last, data, offsets in _blocks(batch.column(2)):
                samples = signatures(last - first, *weighted_shingles(data, offsets, hashes, idf))
                bands = bands_of(samples).view(np.int64)
                some = samples.any(axis=1)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(first, last - first),
                        batch.column(1).slice(first, last - first),
                        pa.array([b if s else None for b, s in zip(bands.tolist(), some, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "key", "bands"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", row_key("text").alias("key"), "text")
    return rows.mapInArrow(work, f"doc_id {kind}, key binary, bands array<long>")


def verify(pairs: DataFrame, texts: DataFrame, model: tuple[int, np.ndarray, np.ndarray]) -> DataFrame:
    """(u, v, similarity) of the pairs (u, v) of keys, by exact weighted Jaccard of their texts (key, text)."""
    _, hashes, idf = model
    joined = (
        pairs.join(texts.select(F.col("key").alias("u"), F.col("text").alias("text_u")), "u")
        .join(texts.select(F.col("key").alias("v"), F.col("text").alias("text_v")), "v")
        .select("u", "v", "text_u", "text_v")
    )

    def work(batches):
        import pyarrow as pa

        kept: dict[bytes, tuple] = {}

        def vector(key, value):
            if key not in kept:
                if len(kept) > 256:
                    kept.clear()
                data, offsets = text_bytes(pa.array([value], pa.string()))
                kept[key] = weighted_shingles(data, offsets, hashes, idf)[1:]
            return kept[key]

        for batch in batches:
            us, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for k in range(len(us)):
                (ka, wa), (kb, wb) = vector(us[k], batch.column(2)[k].as_py()), vector(vs[k], batch.column(3)[k].as_py())
                _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                shared = np.minimum(wa[ia], wb[ib]).sum()
                out.append(float(shared / max(wa.sum() + wb.sum() - shared, 1e-300)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["u", "v", "similarity"])

    return joined.mapInArrow(work, "u binary, v binary, similarity double")


def sketches(n_texts: int, text: np.ndarray, keys: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weight of each text in each group of shingles, one row a text."""
    at = text * GROUPS + (keys & _U64(GROUPS - 1)).astype(np.int64)
    return np.bincount(at, weight, n_texts * GROUPS).reshape(n_texts, GROUPS).astype(np.float32)


def sketch(texts: DataFrame, model: tuple[int, np.ndarray, np.ndarray]) -> DataFrame:
    """(key, text, weight, coarse, fine) of (key, text): total weight and the sums of groups of shingles."""
    _, hashes, idf = model

    def work(batches):
        import pyarrow as pa

        floats = lambda rows: pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows, np.float32).ravel()))
        for batch in batches:
            for first, last, data, offsets in _blocks(batch.column(1)):
                fine = sketches(last - first, *weighted_shingles(data, offsets, hashes, idf))
                coarse = fine.reshape(-1, GROUPS // COARSE, COARSE).sum(axis=1)
                whole = [batch.column(k).slice(first, last - first) for k in (0, 1)]
                yield pa.record_batch([*whole, pa.array(fine.sum(axis=1, dtype=np.float64)), floats(coarse), floats(fine)], names=["key", "text", "weight", "coarse", "fine"])

    return texts.select("key", "text").mapInArrow(work, "key binary, text string, weight double, coarse array<float>, fine array<float>")


def pivots(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(band, value, pivot): of each bucket the member nearest to the mean of the members' coarse sketches, and the lightest."""
    placed = write_shared(members.join(texts.select("key", "weight", "coarse"), "key"), "bucket-sketches")
    means = placed.groupBy("band", "value").agg(F.array(*[F.avg(F.get("coarse", F.lit(k))) for k in range(COARSE)]).alias("mean"))
    far = sum((F.abs(F.get("coarse", F.lit(k)) - F.get("mean", F.lit(k))) for k in range(COARSE)), F.lit(0.0))
    # both are written, so that a hot bucket's rows can be split in the joins
    apart = placed.join(write_shared(means, "bucket-means"), ["band", "value"]).select("band", "value", F.struct(far.alias("far"), "key").alias("at"), F.struct("weight", "key").alias("light"))
    best = apart.groupBy("band", "value").agg(F.min("at").alias("at"), F.min("light").alias("light"))
    return write_shared(best.select("band", "value", F.array_distinct(F.array("at.key", "light.key")).alias("pivots")), "pivots")


def near_links(docs: DataFrame, signed: DataFrame, model: tuple[int, np.ndarray, np.ndarray]) -> DataFrame:
    """(u, v): verified links between different texts, u < v; their components are those of all links between candidates."""
    nodes = signed.filter(F.col("bands").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("bands").alias("bands"))
    banded = nodes.select("key", "bands", F.posexplode("bands").alias("band", "value"))
    sizes = banded.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "value")
    members = write_shared(banded.join(sizes, ["band", "value"]), "buckets")
    needed = members.select("key").distinct()
    needed = nodes.select("key", "doc_id").join(needed, "key", "left_semi").select(F.col("key").alias("n_key"), F.col("doc_id").alias("n_doc"))
    texts = docs.select("doc_id", "text").withColumn("key", row_key("text"))
    texts = texts.join(needed.hint("shuffle_hash"), (F.col("key") == F.col("n_key")) & F.col("doc_id").eqNullSafe(F.col("n_doc")), "left_semi").select("key", "text")
    texts = write_shared(sketch(texts.dropDuplicates(["key"]), model), "texts")
    held = members.select("band", "value", "key")
    pairs = held.join(pivots(held, texts), ["band", "value"]).select("key", F.explode("pivots").alias("pivot")).filter(F.col("key") != F.col("pivot"))
    pairs = write_shared(pairs.select(F.least("key", "pivot").alias("u"), F.greatest("key", "pivot").alias("v")).distinct(), "pairs")
    links = write_shared(verify(pairs, texts, model).filter(F.col("similarity") >= SIMILARITY - 1e-9).select("u", "v"), "links")

    # what is still apart in a bucket: all but its largest component against the rest
    component = connected_components(links)
    placed = members.join(component.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    by = placed.groupBy("band", "value", "component").agg(F.count(F.lit(1)).alias("held"))
    largest = by.groupBy("band", "value").agg(F.max(F.struct("held", "component")).alias("m"), F.count(F.lit(1)).alias("parts"), F.sum("held").alias("all")).filter("parts > 1")
    largest = largest.select("band", "value", F.col("m.component").alias("main"), ((F.col("all") - F.col("m.held")) * F.col("all") >= CROWDED).alias("crowded"))
    split = placed.join(write_shared(largest, "split-buckets"), ["band", "value"])
    split = write_shared(split.select("band", "value", "key", "bands", "component", "main", "crowded"), "split-members")
    known = texts.select("key", "weight", "coarse", "fine").join(shared_weight(split.filter("crowded").select("key").distinct(), texts, model), "key", "left")
    split = write_shared(split.join(known, "key"), "split-members")
    columns = ("key", "bands", "component", "main", "weight", "shared", "coarse", "fine")
    side = lambda df, name: df.select("band", "value", *[F.col(c).alias(f"{name}_{c}") for c in columns])
    # a text that shares too little with all others of its crowded buckets has no link there
    split = split.filter(~F.col("crowded") | (F.col("shared") >= (SIMILARITY - 1e-5) * F.col("weight")))
    few, every = side(split.filter(F.col("component") != F.col("main")), "x"), side(split, "y")
    least = (F.col("x_weight") + F.col("y_weight")) * (SIMILARITY / (1 + SIMILARITY) - 1e-5)  # of what the texts share at the threshold
    # known of both: then either one's partners are all among the texts it was counted with
    rest = F.coalesce(F.least("x_shared", "y_shared") >= least, F.lit(True)) | F.col("x_shared").isNull() | F.col("y_shared").isNull()
    coarse = sum((F.least(F.get("x_coarse", F.lit(k)), F.get("y_coarse", F.lit(k))).cast("double") for k in range(COARSE)), F.lit(0.0))
    fine = F.expr("aggregate(zip_with(x_fine, y_fine, (a, b) -> CAST(least(a, b) AS DOUBLE)), 0D, (s, e) -> s + e)")
    earlier = F.expr("exists(sequence(0, band), i -> i < band AND x_bands[i] = y_bands[i])")  # a pair is met in its first common band
    once = (F.col("y_component") == F.col("y_main")) | (F.col("x_key") < F.col("y_key"))
    apart = few.join(every, ["band", "value"]).filter((F.col("x_component") != F.col("y_component")) & once & (F.least("x_weight", "y_weight") >= least) & rest & (coarse >= least) & (fine >= least) & ~earlier)
    apart = apart.select(F.least("x_key", "y_key").alias("u"), F.greatest("x_key", "y_key").alias("v")).distinct()
    more = verify(write_shared(apart, "pairs"), texts, model).filter(F.col("similarity") >= SIMILARITY - 1e-9).select("u", "v")
    return component.select(F.col("component").alias("u"), F.col("node").alias("v")).unionAll(more)


def shared_weight(keys: DataFrame, texts: DataFrame, model: tuple[int, np.ndarray, np.ndarray]) -> DataFrame:
    """(key, shared): the weight of a text's shingles that at least one other of these texts has."""
    _, hashes, idf = model

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for first, last, data, offsets in _blocks(batch.column(1)):
                text, shingle, weight = weighted_shingles(data, offsets, hashes, idf)
                yield pa.record_batch([batch.column(0).take(pa.array(text + first)), pa.array(shingle.view(np.int64)), pa.array(weight, pa.float64())], names=["key", "shingle", "weight"])

    rows = texts.select("key", "text", "weight").join(keys, "key", "left_semi")
    alone = (
        rows.select("key", "text").mapInArrow(work, "key binary, shingle long, weight double")
        .groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"), F.min("weight").alias("weight")).filter("n = 1")
    )
    own = alone.groupBy("key").agg(F.sum("weight").alias("own"))
    return rows.select("key", "weight").join(own, "key", "left").select("key", (F.col("weight") - F.coalesce("own", F.lit(0.0))).alias("shared"))


def near_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, key, class_id, class_key, class_size): the class of every row.

    class_id is its smallest doc_id, class_key the smallest key of its texts: where ids are null or
    repeated, several classes may have one class_id, but a class_key is of one class.
    """
    docs = docs.select("doc_id", "text")
    model = common_words(docs)
    signed = write_shared(sign(docs, model), "signatures")
    component = connected_components(near_links(docs, signed, model))
    placed = signed.select("doc_id", "key").join(component.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    sizes = placed.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return placed.join(sizes, "component").select("doc_id", "key", "class_id", F.lower(F.hex("component")).alias("class_key"), "class_size")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest id (of equal ids, the smallest text)."""
    classes = write_shared(near_classes(docs), "near-classes")
    copies = classes.groupBy("class_key", "doc_id", "key").agg(F.count(F.lit(1)).alias("copies"))
    keep = copies.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "copies")).alias("m"))
    keep = keep.select(F.col("m.doc_id").alias("_nd_id"), F.col("m.key").alias("_nd_key"), F.col("m.copies").alias("_nd_copies"))
    names = docs.columns
    kept = docs.withColumn("_nd_own", row_key("text")).join(keep, F.col("doc_id").eqNullSafe(F.col("_nd_id")) & (F.col("_nd_own") == F.col("_nd_key")))
    once = kept.filter("_nd_copies = 1").select(*names)
    return once.unionAll(kept.filter("_nd_copies > 1").dropDuplicates(["doc_id", "_nd_own"]).select(*names))
