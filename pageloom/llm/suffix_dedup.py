"""Removal of repeated byte strings by longest previous factors in suffix order.

A string of ``LENGTH`` bytes that starts at two places, in one text or in two, is
repeated. ``keep="none"`` removes every byte that a repeated string covers;
``keep="first"`` removes the later copies only: those whose longest previous factor
(LPF), the longest string from that place that also starts earlier, has at least that length.

All places that can start equal strings are brought together first: each string has an
anchor, its 32-byte part of least hash, so runs of strings with one anchor (segments)
are dealt by its hash. Equal segments collapse to one with a count. Where an anchor has
several different segments, the suffixes of their bytes are sorted to the depth of ``LENGTH``
in numpy, block by block; the previous and the next smaller place of each suffix in that order are its best
earlier matches, and the longer common prefix with the two, compared byte by byte up to ``LENGTH``, is its LPF. The segments
of an anchor with more than ``HOT`` different ones are cut into blocks of ``BLOCK`` strings, dealt by the bytes that all
strings of a block share. Equal blocks collapse likewise, blocks alone with those bytes have no repeat, and the others are
sorted as above. Only where more than ``HOT`` different blocks share those bytes, as around the ends of a passage that very
many texts hold, are whole strings aggregated to a count and first place before they are dealt, so no group is unbounded.
Hashes only bring candidates together, except that equal segments, equal blocks and those strings are told by 128 bits.

Defined cases: a null text is an empty one; texts under ``LENGTH`` bytes have no strings; rows with
equal (doc_id, text) are copies of each other; null ids are allowed; places are
ordered by (doc_id, start); other columns are ignored; a text is held whole in one task, with about ten 8-byte
arrays over its bytes.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import row_key, text_bytes, write_shared
from pageloom.llm.shingles import mix

LENGTH = 200
GRAM = 32
WINDOW = LENGTH - GRAM + 1
_U64 = np.uint64
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U64(0xA0761D6478BD642F))
_OTHER_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U64(0xE7037ED1A0B428DB))
_BASE = 0x9E3779B97F4A7C15
_OTHER_BASE = 0xC2B2AE3D27D4EB4F
BLOCK_BYTES = 1 << 20
HOT = 2000
BLOCK = 16
_SORT_BYTES = 1 << 20


def _rolling(values: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hashes of all strings of ``length``, by doubling and joining the powers of two of it."""
    n = len(values)
    power, size = values, 1
    out, done = None, 0
    while size <= length:
        if length & size:
            if out is None:
                out, done = power, size
            else:
                m = n - done - size + 1
                out = out[:m] * _U64(pow(_BASE, size, 1 << 64)) + power[done : done + m]
                done += size
        power = power[:-size] * _U64(pow(_BASE, size, 1 << 64)) + power[size:] if 2 * size <= length else power
        size *= 2
    return out


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, anchor, digest, start, n) of the runs of 200-byte strings that share their anchor.

    The anchor of a string is its 32-byte part of least hash, the leftmost if several are equal:
    a choice that depends on the 200 bytes alone, so equal strings have equal anchors
    at equal places. ``digest`` hashes all bytes that a run covers.
    """
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < LENGTH:
        return empty, np.zeros(0, np.int64), np.zeros(0, np.int64), empty, empty
    grams = mix(_rolling(_VALUES[data], GRAM))
    low = np.arange(len(grams), dtype=np.uint64)
    ranked = (grams & _U64(0xFFFFFFFF00000000)) | low
    # least over windows of WINDOW grams: by powers of two, then two overlapping ones
    size, least = 1, ranked
    while 2 * size <= WINDOW:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    m = n - LENGTH + 1
    least = np.minimum(least[:m], least[WINDOW - size : WINDOW - size + m])
    at = (least & _U64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:m]
    inside = np.arange(m) + LENGTH <= offsets[1:][text]
    new = np.ones(m, bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    firsts = np.flatnonzero(new & inside)
    # a run ends before the next one, or where its text has no further string
    bounds = np.append(np.flatnonzero(new), m)
    ends = bounds[np.searchsorted(bounds, firsts, "right")]
    ends = np.minimum(ends, offsets[1:][text[firsts]] - LENGTH + 1)
    counts = ends - firsts
    up, down = _powers(n)
    sums = np.concatenate((np.zeros(1, _U64), np.cumsum(_OTHER_VALUES[data] * up)))
    digest = mix((sums[ends + LENGTH - 1] - sums[firsts]) * down[firsts] + counts.astype(_U64))
    return text[firsts], grams[at[firsts]].view(np.int64), digest.view(np.int64), firsts - offsets[text[firsts]], counts


_TABLES: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base of the digests and of its inverse modulo 2**64."""
    if len(_TABLES.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", _OTHER_BASE), ("down", pow(_OTHER_BASE, -1, 1 << 64))):
            out = np.ones(size, _U64)
            filled = 1
            while filled < size:
                out[filled : 2 * filled] = out[:filled] * _U64(pow(base, filled, 1 << 64))
                filled *= 2
            _TABLES[name] = out
    return _TABLES["up"][:n], _TABLES["down"][:n]


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of values: equal values share one."""
    order = np.argsort(keys)
    ranked = keys[order]
    steps = np.zeros(len(keys), _U64)
    steps[1:] = ranked[1:] != ranked[:-1]
    out = np.empty(len(keys), _U64)
    out[order] = np.cumsum(steps)
    return out


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros after the end, for LENGTH places beyond it too."""
    padded = np.concatenate((data, np.zeros(LENGTH + 8, np.uint8))).astype(_U64)
    eight = padded[:-1] << _U64(8) | padded[1:]
    for width in (2, 4):
        eight = eight[:-width] << _U64(8 * width) | eight[width:]
    return eight[: len(data) + LENGTH]


def suffix_ranks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes at ``starts`` by their first LENGTH bytes; at most 2**21 bytes, all of them present after each start."""
    # prefixes of 8, 24, 72 and 200 bytes: three ranks of 21 bits make the next key
    rank = _dense(_eights(data))
    for size in (8, 24):
        m = len(rank) - 2 * size
        rank = _dense(rank[:m] << _U64(42) | rank[size : size + m] << _U64(21) | rank[2 * size : 2 * size + m])
    return _dense(rank[starts] << _U64(42) | rank[starts + 72] << _U64(21) | rank[starts + LENGTH - 72])


def smaller_before(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each one, -1 if there is none.

    A pointer that meets a larger value takes over that one's pointer: all between them are larger too, so the
    distances double and few rounds are needed.
    """
    at = np.arange(len(values)) - 1
    open_ = np.flatnonzero(at >= 0)
    while len(open_):
        open_ = open_[values[at[open_]] >= values[open_]]
        at[open_] = at[at[open_]]
        open_ = open_[at[open_] >= 0]
    return at


def common_prefixes(eights: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Equal leading bytes of the suffixes at ``one`` and at ``other``, LENGTH at most."""
    out = np.full(len(one), LENGTH, np.int64)
    live = np.arange(len(one))
    for at in range(0, LENGTH, 8):
        differ = eights[one[live] + at] ^ eights[other[live] + at]
        ended = differ != 0
        left = differ[ended]
        out[live[ended]] = at + sum(((left >> _U64(8 * k)) == 0).astype(np.int64) for k in range(1, 8))
        live = live[~ended]
        if not len(live):
            break
    return np.minimum(out, LENGTH)


def previous_factors(data: np.ndarray, starts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(LPF, longest match with a later place) of each suffix, LENGTH at most.

    In suffix order the longest match with an earlier place is with the nearest suffix before or after
    whose place is smaller; with the order of places turned round, the same gives the longest later match.
    """
    eights = _eights(data)
    order = np.lexsort((places, suffix_ranks(data, starts)))
    sorted_starts = starts[order]
    out = []
    for held in (places[order], -places[order]):
        before = smaller_before(held)
        after = len(held) - 1 - smaller_before(held[::-1])[::-1]
        longest = np.zeros(len(held), np.int64)
        for beside in (before, after):
            some = np.flatnonzero((beside >= 0) & (beside < len(held)))
            longest[some] = np.maximum(longest[some], common_prefixes(eights, sorted_starts[some], sorted_starts[beside[some]]))
        back = np.empty(len(held), np.int64)
        back[order] = longest
        out.append(back)
    return out[0], out[1]


def _runs(flags: np.ndarray) -> list[int]:
    """Flat [from, to, from, to ...] of the true runs."""
    if not flags.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges.tolist()


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text): the id itself where it is a unique integer, else a 128-bit key of the row."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    plain = docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int")
    if plain and not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col("doc_id").isNull()).limit(1).collect():
        return docs.withColumn("key", F.col("doc_id").cast("long"))
    return docs.withColumn("key", row_key("doc_id", "text"))


def find_segments(keyed: DataFrame) -> DataFrame:
    """(key, doc_id, anchor, digest, start, n) of all texts."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            first, rows = 0, len(offsets) - 1
            while first < rows:
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1)
                text, anchor, digest, start, n = segments(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                at = pa.array(text + first)
                yield pa.record_batch(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(anchor), pa.array(digest), pa.array(start, pa.int32()), pa.array(n, pa.int32())],
                    names=["key", "doc_id", "anchor", "digest", "start", "n"],
                )
                first = last

    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema.fields}
    return keyed.select("key", "doc_id", "text").mapInArrow(work, f"key {kinds['key']}, doc_id {kinds['doc_id']}, anchor long, digest long, start int, n int")


def blocks(whole: bytes, anchor: int, n: int):
    """(grp, base, n, same, bytes) of the blocks of at most BLOCK strings of a segment's bytes.

    Blocks are cut at places counted from the anchor, so equal strings lie in blocks of one name. All strings that
    a block of that name can have hold the bytes that ``grp`` hashes: equal strings are in blocks of equal ``grp``.
    Blocks with equal bytes, told by ``same``, have equal strings.
    """
    at = int(np.argmax(mix(_rolling(_VALUES[np.frombuffer(whole, np.uint8)], GRAM)).view(np.int64) == anchor))
    first = 0
    while first < n:
        name = (at - first) // BLOCK
        high = at - name * BLOCK  # the last place that can be in the block; the first one is BLOCK - 1 before it
        count = min(n, high + 1) - first
        held = hashlib.blake2b(whole[high : high - BLOCK + 1 + LENGTH], digest_size=8, salt=name.to_bytes(1))
        own = whole[first : first + count + LENGTH - 1]
        yield int.from_bytes(held.digest(), signed=True), first, count, hashlib.blake2b(own, digest_size=16).digest(), own
        first += count


def _pieces(keyed: DataFrame, unlike: DataFrame, hot: bool = False) -> DataFrame:
    """Bytes of the segments that must be sorted, of hot ones in blocks: (grp, anchor, digest, base, n, doc_id, start, same, bytes)."""
    wanted = unlike.groupBy("key").agg(F.collect_list(F.struct("anchor", "digest", "start", "n")).alias("parts")).withColumnRenamed("key", "p_key")
    joined = keyed.join(wanted.hint("shuffle_hash"), F.col("key") == F.col("p_key")).select("doc_id", "text", "parts")
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for k in range(batch.num_rows):
                data = batch.column(1)[k].as_py().encode("utf-8")
                doc_id = batch.column(0)[k].as_py()
                for part in batch.column(2)[k].as_py():
                    whole = data[part["start"] : part["start"] + part["n"] + LENGTH - 1]
                    cut = blocks(whole, part["anchor"], part["n"]) if hot else [(part["anchor"], 0, part["n"], None, whole)]
                    for grp, base, n, same, own in cut:
                        out.append((grp, part["anchor"], part["digest"], base, n, doc_id, part["start"], same, own))
                        size += len(own)
                    if size > 8 << 20:
                        yield _batch(out, batch.column(0).type)
                        out, size = [], 0
            if out:
                yield _batch(out, batch.column(0).type)

    def _batch(out, id_type):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), id_type, pa.int32(), pa.binary(), pa.binary()]
        names = ["grp", "anchor", "digest", "base", "n", "doc_id", "start", "same", "bytes"]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return joined.mapInArrow(work, f"grp long, anchor long, digest long, base int, n int, doc_id {kind}, start int, same binary, bytes binary")


def _repeats(rows: DataFrame, firsts: DataFrame, on: list[str]) -> DataFrame:
    """Verdicts of rows that ``firsts`` has one row for: all places are repeated, and all but the first row's have an earlier match."""
    is_first = (F.col("anchor") == F.col("f_anchor")) & (F.col("digest") == F.col("f_digest")) & (F.col("base") == F.col("f_base"))
    run = F.array(F.col("base"), F.col("base") + F.col("n"))
    joined = rows.select(*on, "anchor", "digest", "base", "n").join(firsts, on)
    return joined.select("anchor", "digest", run.alias("again"), F.when(is_first, F.array().cast("array<int>")).otherwise(run).alias("earlier"))


def _hot_pieces(pieces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(verdicts of equal blocks, pieces to sort, pieces to settle by whole strings, if any) of the blocks of hot segments.

    Equal blocks collapse to the first one with a count; the firsts of a group are sorted, or settled by
    whole strings where they are more than HOT. A block alone in its group has no repeated string.
    """
    pieces = write_shared(pieces, "hot-blocks")
    place = F.struct("doc_id", (F.col("start") + F.col("base")).alias("place"), "anchor", "digest", "base", "n", "start", "bytes")
    kinds = pieces.groupBy("grp", "same").agg(F.count(F.lit(1)).alias("held"), F.min(place).alias("f")).select("grp", "same", "held", "f.*")
    kinds = write_shared(kinds, "block-kinds")  # so that a hot block's or group's rows can be split
    firsts = kinds.filter("held > 1").select("grp", "same", *(F.col(c).alias(f"f_{c}") for c in ("anchor", "digest", "base")))
    unlike = write_shared(kinds.groupBy("grp").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "unlike-blocks")
    few = kinds.join(unlike.filter(F.col("kinds") <= HOT), "grp").select(*pieces.columns)
    rest = unlike.filter(F.col("kinds") > HOT)
    many = kinds.join(rest, "grp").select(*pieces.columns) if rest.limit(1).collect() else None
    return _repeats(pieces, firsts, ["grp", "same"]), few, many


def _string_verdicts(pieces: DataFrame) -> DataFrame:
    """As ``_sorted_verdicts``, of whole strings by 128-bit hashes: one row a distinct string is joined back."""
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.column(3).to_numpy()
            at = np.repeat(np.arange(len(n)), n)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own = batch.column(6).to_pylist()
            strings = [hashlib.blake2b(own[k][j : j + LENGTH], digest_size=16).digest() for k, j in zip(at.tolist(), inner.tolist(), strict=True)]
            base = pa.array(batch.column(2).to_numpy()[at] + inner, pa.int32())
            rest = [batch.column(k).take(pa.array(at)) for k in (0, 1, 4, 5)]
            yield pa.record_batch([*rest, base, pa.array(np.ones(len(at)), pa.int32()), pa.array(strings, pa.binary())], names=["anchor", "digest", "doc_id", "start", "base", "n", "string"])

    split = pieces.select("anchor", "digest", "base", "n", "doc_id", "start", "bytes").mapInArrow(work, f"anchor long, digest long, doc_id {kind}, start int, base int, n int, string binary")
    split = write_shared(split, "hot-strings")
    place = F.struct("doc_id", (F.col("start") + F.col("base")).alias("place"), F.col("anchor").alias("f_anchor"), F.col("digest").alias("f_digest"), F.col("base").alias("f_base"))
    firsts = split.groupBy("string").agg(F.count(F.lit(1)).alias("held"), F.min(place).alias("f")).filter("held > 1")
    firsts = write_shared(firsts.select("string", "f.f_anchor", "f.f_digest", "f.f_base"), "repeated-strings")  # so that a hot string's rows can be split
    return _repeats(split, firsts, ["string"])


def _sorted_verdicts(pieces: DataFrame) -> DataFrame:
    """(anchor, digest, again, earlier): flat runs of the places of a segment that are repeated, and that have an earlier match."""
    dealt = pieces.drop("same").repartition("grp").sortWithinPartitions("grp", "doc_id", "start", "base")

    def judge(held: list):
        """Blocks of whole groups; rows of a group are in (doc_id, start) order, so their rank is their place."""
        import pyarrow as pa

        texts = [np.frombuffer(r[-1], np.uint8) for r in held]
        lengths = np.array([len(t) for t in texts])
        data = np.concatenate(texts)
        n = np.array([r[4] for r in held])
        offsets = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        lpf, later = previous_factors(data, np.repeat(offsets, n) + inner, np.repeat(np.arange(len(held)), n) * 1024 + inner)
        earlier = lpf >= LENGTH
        again = earlier | (later >= LENGTH)
        ends = np.cumsum(n)
        a = [[x + r[3] for x in _runs(again[e - k : e])] for r, k, e in zip(held, n, ends, strict=True)]
        b = [[x + r[3] for x in _runs(earlier[e - k : e])] for r, k, e in zip(held, n, ends, strict=True)]
        return pa.record_batch([pa.array([r[1] for r in held], pa.int64()), pa.array([r[2] for r in held], pa.int64()), pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.int32()))], names=["anchor", "digest", "again", "earlier"])

    def work(batches):
        held: list[tuple] = []
        group: list[tuple] = []
        size = grouped = 0
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if group and row[0] != group[0][0]:
                    if held and size + grouped > _SORT_BYTES:
                        yield judge(held)
                        held, size = [], 0
                    held += group
                    size += grouped
                    group, grouped = [], 0
                group.append(row)
                grouped += len(row[-1])
        held += group
        if held:
            yield judge(held)

    return dealt.mapInArrow(work, "anchor long, digest long, again array<int>, earlier array<int>")


def repeated_spans(keyed: DataFrame, keep: str = "none") -> DataFrame:
    """(key, spans): flat byte intervals to remove from each text that has some; they may overlap."""
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    found = find_segments(keyed)
    # written, so that the join below has two dealt-out sides and a hot anchor's rows can be split
    shared = write_shared(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select("anchor"), "anchors")
    rows = write_shared(found.join(shared, "anchor"), "segments")
    distinct = write_shared(
        rows.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("held"), F.min(F.struct("doc_id", "start", "key", "n")).alias("f"))
        .select("anchor", "digest", "held", "f.*"),
        "distinct-segments",
    )
    unlike = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    marked = distinct.join(unlike, "anchor").withColumn("hot", F.col("kinds") > HOT)
    pieces = _pieces(keyed, marked.filter(~F.col("hot")))
    settled = []
    if unlike.filter(F.col("kinds") > HOT).limit(1).collect():
        equal, few, many = _hot_pieces(_pieces(keyed, marked.filter("hot"), hot=True))
        pieces = pieces.unionByName(few)
        settled = [write_shared(equal, "verdicts")]
        if many is not None:
            settled.append(write_shared(_string_verdicts(many), "verdicts"))
    verdicts = reduce(DataFrame.unionAll, settled, write_shared(_sorted_verdicts(pieces), "verdicts"))
    verdicts = verdicts.groupBy("anchor", "digest").agg(F.flatten(F.collect_list("again")).alias("again"), F.flatten(F.collect_list("earlier")).alias("earlier"))
    whole = F.when(F.col("held") > 1, F.array(F.lit(0), F.col("n")))
    judged = distinct.join(verdicts, ["anchor", "digest"], "left").select(
        "anchor", "digest", F.col("key").alias("first_key"), F.col("start").alias("first_start"),
        F.coalesce(whole, F.col("again")).alias("again"), F.coalesce(F.col("earlier"), F.array().cast("array<int>")).alias("earlier"), F.array(F.lit(0), F.col("n")).alias("whole"),
    ).filter(F.col("again").isNotNull() & (F.size("again") > 0))
    judged = write_shared(judged, "judged-segments")  # as above: a segment with very many copies is split
    joined = rows.select("key", "anchor", "digest", "start").join(judged, ["anchor", "digest"])
    is_first = (F.col("key") == F.col("first_key")) & (F.col("start") == F.col("first_start"))
    runs = F.col("again") if keep == "none" else F.when(is_first, F.col("earlier")).otherwise(F.col("whole"))
    placed = joined.select("key", F.transform(runs, lambda x, i: x + F.col("start") + F.when(i % 2 == 1, LENGTH - 1).otherwise(0)).alias("span")).filter(F.size("span") > 0)
    return placed.groupBy("key").agg(F.flatten(F.collect_list("span")).alias("spans"))


def merged(spans: list[int] | np.ndarray) -> np.ndarray:
    """Disjoint, not touching intervals, in order, from flat ones."""
    flat = np.asarray(spans, np.int64).reshape(-1, 2)
    flat = flat[np.argsort(flat[:, 0], kind="stable")]
    if not len(flat):
        return flat
    reach = np.maximum.accumulate(flat[:, 1])
    new = np.concatenate(([True], flat[1:, 0] > reach[:-1]))
    first = np.flatnonzero(new)
    return np.stack((flat[first, 0], reach[np.append(first[1:], len(flat)) - 1]), axis=1)


def remove_repeats(docs: DataFrame, keep: str = "none", with_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every document."""
    keyed = _keyed(docs)
    spans = repeated_spans(keyed, keep).withColumnRenamed("key", "s_key")
    joined = keyed.join(spans.hint("shuffle_hash"), F.col("key") == F.col("s_key"), "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            lists = batch.column(2)
            out = []
            for k in range(batch.num_rows):
                own = data[offsets[k] : offsets[k + 1]]
                gone = merged(lists[k].values.to_numpy()) if lists[k].is_valid else np.zeros((0, 2), np.int64)
                if len(gone):
                    edges = np.concatenate(([0], gone.ravel(), [len(own)]))
                    left = b"".join(own[a:b].tobytes() for a, b in edges.reshape(-1, 2))
                else:
                    left = own.tobytes()
                out.append((len(own), len(own) - len(left), len(gone), hashlib.sha256(left).hexdigest(), *([left] if with_bytes else [])))
            if out:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)]
                yield pa.record_batch([batch.column(0), *columns], names=["doc_id", *names[: len(columns)]])

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")
    return joined.mapInArrow(work, schema)
