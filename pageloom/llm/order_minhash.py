"""Document fingerprints by Order MinHash.

A text's k-mers of ``K`` code points are numbered by occurrence. Each of ``SLOTS``
hash functions selects the ``TUPLE`` smallest numbered k-mers; these keep the order
they have in the text, and the hash of that tuple is the slot's 16-bit value.
Texts at a small edit distance share most slots; the same k-mers in another order
do not. Likeness is the share of equal slots.

``fingerprint_neighbours`` pairs every document with the next one by ascending
doc_id: one range shuffle brings neighbours together, and only the edges of
the partitions are joined afterwards.

Defined cases: a null text is an empty one; a text of fewer than ``K`` code
points is one k-mer, an empty one has only zero slots; rows with equal ids are
ordered by their text, null ids come first; a single document is its own next one;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import write_shared

K, SLOTS, TUPLE = 12, 24, 2
#: Survivors wanted per slot before the smallest are looked for; fewer than TUPLE leads to a full pass.
_SPARE = 14
_U64, _U32 = np.uint64, np.uint32
_BASE = 0x9E3779B97F4A7C15
_MULTIPLIERS = np.array([((s * 2 + 1) * 0x9E3779B1 ^ (s * 0x85EBCA6B)) & 0xFFFFFFFF | 1 for s in range(1, SLOTS + 1)], _U32)


def _power(e: int) -> np.uint64:
    return _U64(pow(_BASE, e, 1 << 64))


def code_points(text: str) -> np.ndarray:
    """Code points of a text; lone surrogates pass."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def kmer_hashes(points: np.ndarray) -> np.ndarray:
    """32-bit hashes of the k-mers, in text order."""
    n = len(points)
    if not n:
        return np.zeros(0, _U32)
    one = (points.astype(_U64) + _U64(1)) * _U64(0xD6E8FEB86659FD93)
    one ^= one >> _U64(32)
    if n < K:
        full = np.array([(int(one.sum(dtype=_U64)) * 31 + sum(int(v) * (i + 1) for i, v in enumerate(one))) & ((1 << 64) - 1)], _U64)
    else:
        two = one[:-1] * _power(1) + one[1:]
        four = two[:-2] * _power(2) + two[2:]
        eight = four[:-4] * _power(4) + four[4:]
        full = eight[: n - K + 1] * _power(4) + four[8 : 8 + n - K + 1]
    full ^= full >> _U64(29)
    full *= _U64(0xBF58476D1CE4E5B9)
    return (full >> _U64(32)).astype(_U32)


def numbered(kmers: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, how many equal ones came before it)."""
    n = len(kmers)
    if n < 2:
        return kmers
    # Only k-mers that share a cell of a sparse table can be equal; those are sorted.
    bits = (16 * n).bit_length()
    cells = (kmers >> _U32(32 - bits)).astype(np.intp) if bits < 32 else kmers.astype(np.intp)
    last, here = np.empty(1 << min(bits, 32), np.int32), np.arange(n, dtype=np.int32)
    last[cells] = here
    beaten = np.flatnonzero(last[cells] != here)
    if not len(beaten):
        return kmers
    shared = np.zeros(len(last), bool)
    shared[cells[beaten]] = True
    places = np.flatnonzero(shared[cells])
    order = np.argsort(kmers[places], kind="stable")
    places = places[order]
    values = kmers[places]
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    number = (np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))).astype(_U32)
    again = number > 0
    if not again.any():
        return kmers
    mixed = values[again] ^ (number[again] * _U32(0x85EBCA6B))
    mixed = (mixed ^ (mixed >> _U32(15))) * _U32(0x2C1B3C6D)
    out = kmers.copy()
    out[places[again]] = mixed ^ (mixed >> _U32(13))
    return out


def _below(hashes: np.ndarray, first: int, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, place, value) of the hashes from ``first`` on whose slot value is under ``limit``; in blocks."""
    slots, places, values = [], [], []
    step = 1 << 13
    for at in range(first, len(hashes), step):
        part = (hashes[None, at : at + step] * _MULTIPLIERS[:, None]).ravel()
        found = np.flatnonzero(part < _U32(int(limit * 0xFFFFFFFF))) if limit < 1.0 else np.arange(len(part))
        width = min(step, len(hashes) - at)
        slot = found // width
        slots.append(slot)
        places.append(found - slot * width + at)
        values.append(part[found])
    if not slots:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, _U32)
    return np.concatenate(slots), np.concatenate(places), np.concatenate(values)


def _select(hashes: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray | None:
    """The slots from the smallest values, or None if a slot has too few to choose from."""
    slot, place, value = found
    take = min(TUPLE, len(hashes))
    if np.bincount(slot, minlength=SLOTS).min() < take:
        return None
    order = np.lexsort((place, (slot.astype(_U64) << _U64(32)) | value))
    slot, place = slot[order], place[order]
    first = np.searchsorted(slot, np.arange(SLOTS))
    chosen = np.sort(place[first[:, None] + np.arange(take)], axis=1)  # text order
    out = np.full(SLOTS, 0x345678, _U64)
    for k in range(take):
        out = (out * _U64(0x100000001B3)) ^ (hashes[chosen[:, k]].astype(_U64) + _U64(k))
        out = (out ^ (out >> _U64(31))) * _U64(0x94D049BB133111EB)
    return ((out >> _U64(40)) & _U64(0xFFFF)).astype(np.uint16)


class Sketch:
    """Slots of a text, with what an edited form of it can reuse."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""
        self.hashes = numbered(kmer_hashes(code_points(self.text)))
        n = len(self.hashes)
        self.limit = min(1.0, _SPARE / max(n, 1))
        self.found = _below(self.hashes, 0, self.limit)
        self.slots = self._slots(self.hashes, self.found)

    @staticmethod
    def _slots(hashes: np.ndarray, found) -> np.ndarray:
        if not len(hashes):
            return np.zeros(SLOTS, np.uint16)
        slots = _select(hashes, found)
        return slots if slots is not None else _select(hashes, _below(hashes, 0, 1.0))

    def of_edited(self, changed: str, same: int) -> np.ndarray:
        """Slots of a text with the same first ``same`` code points; numbering runs from the left, so k-mers within them keep their values."""
        hashes = numbered(kmer_hashes(code_points(changed)))
        kept = max(0, same - K + 1) if len(changed) >= K else 0
        slot, place, value = self.found
        old = place < kept
        new = _below(hashes, kept, self.limit)
        return self._slots(hashes, tuple(np.concatenate((a[old], b)) for a, b in zip((slot, place, value), new, strict=True)))


def signature(text: str | None) -> np.ndarray:
    """The 16-bit slots of a text."""
    return Sketch(text).slots


def fingerprint(slots: np.ndarray) -> str:
    """Slots as lowercase hex."""
    return slots.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by as many code points of the next."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def _row(doc_id, own: Sketch, following: Sketch) -> tuple:
    changed = edited(own.text, following.text)
    changed_slots = own.of_edited(changed, len(own.text) - len(own.text) // 4)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return (doc_id, len(own.text), digest, fingerprint(own.slots), fingerprint(changed_slots), likeness(own.slots, changed_slots), likeness(own.slots, following.slots))


_RESULT = "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the column fingerprint; one pass, no shuffle."""
    docs = docs.drop("fingerprint")
    names, at = docs.columns, docs.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            values = [fingerprint(signature(t.as_py())) for t in batch.column(at)]
            yield pa.record_batch([*batch.columns, pa.array(values, pa.string())], names=[*names, "fingerprint"])

    return docs.mapInArrow(work, f"{schema}, fingerprint string")


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, its edited form and its next document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    result = _RESULT.format(id=id_type)

    def inside(batches):
        """Complete rows of a partition but for its last document; its first and last document as edges."""
        import pyarrow as pa
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None
        kinds = [pa.int64() if id_type == "bigint" else None]

        def batch_of(out):
            columns = list(zip(*out, strict=True))
            types = [kinds[0], pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.string()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*_NAMES, "edge", "part", "text"])

        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sketch = Sketch(text)
                if held is None:
                    out.append((doc_id, None, None, None, None, None, None, "first", part, text))
                else:
                    out.append((*_row(*held, sketch), None, part, None))
                held = (doc_id, sketch)
            if out:
                yield batch_of(out)
        if held is not None:
            yield batch_of([(held[0], None, None, None, None, None, None, "last", part, held[1].text)])

    done = write_shared(dealt.mapInArrow(inside, f"{result}, edge string, part int, text string"), "order-minhash")
    edges = done.filter(F.col("edge").isNotNull())
    firsts = edges.filter("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    # which non-empty partition follows which: one small row a partition, no texts
    parts = firsts.agg(F.sort_array(F.collect_list("next_part")).alias("parts"))
    follows = parts.select(F.explode(F.arrays_zip(F.col("parts").alias("part"), F.concat(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), F.slice("parts", 1, 1)).alias("next_part"))).alias("x")).select(F.col("x.part").alias("part"), F.col("x.next_part").alias("next_part"))
    pending = edges.filter("edge = 'last'").select("doc_id", "text", "part").join(follows, "part").join(firsts, "next_part").select("doc_id", "text", "next_text")

    def across(batches):
        import pandas as pd

        for pdf in batches:
            out = [_row(d, Sketch(a), Sketch(b)) for d, a, b in zip(pdf["doc_id"], pdf["text"], pdf["next_text"], strict=True)]
            yield pd.DataFrame(out, columns=list(_NAMES))

    return done.filter(F.col("edge").isNull()).select(*_NAMES).unionAll(pending.mapInPandas(across, result))
