"""Quality classifier by nearest-neighbour voting over latent-semantic vectors.

A text becomes the rates of its words (lower case, in ``N_WORDS`` hash cells), of its character-class 3-grams and of its
repeated 8-byte strings, weighted by IDF and projected by a truncated SVD. The labelled
vectors (a bounded sample: at most ``PER_CLASS`` rows of either label, taken by
the hash of their id) are broadcast; every document's cosine to each of them is computed exactly, a block of
documents at a time, and the ``NEIGHBOURS`` nearest vote, each by its
similarity and by how many labelled rows of its class one sampled row stands for. Of labelled rows at the same
cosine as the last neighbour, those earlier in id order vote.

Inputs of a score are the text alone. Defined cases: null and empty texts have
a zero vector and get the share of label 1 among the labelled rows; without
labelled rows of both labels every score is that share (0.5 if there are none).
Columns of ``docs`` named as the results are replaced, others stay; ids may be of any type; a text is held whole
in one task, with about ten 8-byte arrays over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import crc_of_id, labelled_ids, text_bytes
from pageloom.llm.shingles import word_hashes

PER_CLASS = 1500
DIMENSIONS = 48
NEIGHBOURS = 25
GRAM = 3
BLOCK_BYTES = 1 << 20
#: Character classes: other letters and bytes, then the ones that set texts apart.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "|", "!?", "#$%&*", "<>{}[]()=/\\", "'\"-_@+~^`")
N_CLASSES = len(CLASSES) + 1
N_GRAMS = N_CLASSES**GRAM
N_EXTRA = 8
N_WORDS = 512
N_FEATURES = N_GRAMS + N_EXTRA + N_WORDS


def _class_of_byte() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.int64)
    for k, members in enumerate(CLASSES):
        for ch in members.encode():
            table[ch] = k
    return table


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Feature rows of the texts laid out in ``data``: class n-gram rates, repeat rates of 8-byte strings, word rates."""
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES), np.float32)
    if not len(data):
        return out
    classes = _class_of_byte()[data]
    codes = classes.copy()
    for k in range(1, GRAM):
        codes[:-k] = codes[:-k] * N_CLASSES + classes[k:]
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(n), lengths)
    left = np.repeat(offsets[1:], lengths) - np.arange(len(data))  # bytes to the end of the own text
    whole = left >= GRAM
    counts = np.bincount(row[whole] * N_GRAMS + codes[whole], minlength=n * N_GRAMS).reshape(n, N_GRAMS)
    scale = 1000.0 / np.maximum(lengths, 1)
    out[:, :N_GRAMS] = np.log1p(counts * scale[:, None])
    # The part of a text's 8-byte strings, those with 1 of 8 hash values, that occurred before in it.
    wide = data.astype(np.uint64)
    for step, mult in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
        wide[:-step] = wide[:-step] * np.uint64(mult) + wide[step:]
    wide ^= wide >> np.uint64(29)
    wide *= np.uint64(0xBF58476D1CE4E5B9)
    chosen = np.flatnonzero((wide >> np.uint64(61) == 0) & (left >= 8))
    if len(chosen):
        own = row[chosen]
        key = (wide[chosen] & np.uint64((1 << 40) - 1)) | (own.astype(np.uint64) << np.uint64(40))
        total = np.bincount(own, minlength=n)
        distinct = np.bincount((np.unique(key) >> np.uint64(40)).astype(np.int64), minlength=n)
        repeated = 1.0 - distinct / np.maximum(total, 1)
        bins = np.minimum((repeated * N_EXTRA).astype(int), N_EXTRA - 1)
        out[np.arange(n), N_GRAMS + bins] = np.where(total > 0, 3.0, 0.0)
    words, ends = word_hashes(np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8), offsets)
    n_words = np.diff(ends)
    cells = (words >> np.uint64(40)).astype(np.int64) % N_WORDS + np.repeat(np.arange(n), n_words) * N_WORDS
    rates = np.bincount(cells, minlength=n * N_WORDS).reshape(n, N_WORDS) * (200.0 / np.maximum(n_words, 1))[:, None]
    out[:, N_GRAMS + N_EXTRA :] = np.log1p(rates)
    return out


def _blocks(column, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``most`` bytes: (first, last, bytes, offsets)."""
    data, offsets = text_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, min(first + 256, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class NeighbourModel:
    """Projection, labelled vectors and the vote."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, class_sizes: tuple[int, int]) -> None:
        labels = np.asarray(labels)
        sizes = np.array(class_sizes, float)
        self.prior = float(sizes[1] / sizes.sum()) if sizes.sum() else 0.5
        self.usable = len(set(labels.tolist())) == 2
        if not self.usable:
            return
        present = (rows > 0).sum(axis=0)
        self.idf = np.log((1.0 + len(rows)) / (1.0 + present)).astype(np.float32) + 0.3
        self.idf *= present > 0
        weighted = self._unit(rows * self.idf)
        # Truncated SVD by subspace iteration: no matrix larger than the rows themselves is made.
        k = min(DIMENSIONS, *weighted.shape)
        wide = min(k + 12, *weighted.shape)
        basis = np.linalg.qr(weighted @ np.random.default_rng(7).normal(size=(weighted.shape[1], wide)).astype(np.float32))[0]
        for _ in range(8):
            basis = np.linalg.qr(weighted @ (weighted.T @ basis))[0]
        self.axes = np.ascontiguousarray(np.linalg.svd(basis.T @ weighted, full_matrices=False)[2][:k].T, dtype=np.float32)
        self.vectors = self._unit(weighted @ self.axes)
        sampled = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
        self.stands_for = np.where(labels == 1, sizes[1] / sampled[1], sizes[0] / sampled[0]).astype(np.float32)
        self.labels = labels.astype(np.float32)

    @staticmethod
    def _unit(rows: np.ndarray) -> np.ndarray:
        return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Vote of the nearest labelled vectors for each feature row."""
        out = np.full(len(rows), self.prior)
        filled = np.flatnonzero(rows.any(axis=1))
        if not self.usable or not len(filled):
            return out
        near = self._unit((rows[filled] * self.idf) @ self.axes) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        last = np.partition(near, near.shape[1] - k, axis=1)[:, -k, None]
        # all above the k-th cosine, and of those equal to it the first ones
        tied = near == last
        chosen = (near > last) | (tied & (np.cumsum(tied, axis=1) <= k - (near > last).sum(axis=1, keepdims=True)))
        nearest = np.nonzero(chosen)[1].reshape(len(near), k)
        weight = np.maximum(np.take_along_axis(near, nearest, axis=1), 0.0) ** 8 * self.stands_for[nearest]
        total = weight.sum(axis=1)
        vote = (weight * self.labels[nearest]).sum(axis=1)
        out[filled] = np.where(total > 0, vote / np.maximum(total, 1e-30), self.prior)
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> NeighbourModel:
    """Fit on at most ``per_class`` rows of either label outside the held-out fold."""
    held_out = crc_of_id() % 3 == 1
    chosen = labelled_ids(labels, "quality", held_out, per_class)
    # at most 2 * per_class ids: a bounded broadcast side
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def extract(batches):
        import pyarrow as pa

        for batch in batches:
            for first, last, data, offsets in _blocks(batch.column(2)):
                rows = features(data, offsets)
                yield pa.record_batch(
                    [batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array([r.tobytes() for r in rows], pa.binary())],
                    names=["doc_id", "label", "row"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = texts.mapInArrow(extract, f"doc_id {kind}, label int, row binary").collect()
    got = list({r["doc_id"]: r for r in sorted(got, key=lambda r: (r["doc_id"], bytes(r["row"])))}.values())
    counts = dict(
        labels.filter(~held_out & F.col("doc_id").isNotNull()).groupBy(F.col("quality").cast("int").alias("q")).count().collect()
    )
    rows = np.empty((len(got), N_FEATURES), np.float32)
    for k, r in enumerate(got):
        rows[k] = np.frombuffer(r["row"], np.float32)
    labelled = np.array([r["label"] for r in got], int)
    del got
    return NeighbourModel(rows, labelled, (counts.get(0, 0), counts.get(1, 0)))


def score_documents(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` with held_out, score and predicted; one pass, no shuffle of texts."""
    docs = docs.drop("held_out", "score", "predicted")
    model = fit(docs, labels, per_class)  # travels with the task's function, which Spark broadcasts
    names = docs.columns
    at = names.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            scores = [np.zeros(0)]
            for _, _, data, offsets in _blocks(batch.column(at)):
                scores.append(model.score(features(data, offsets)))
            yield pa.record_batch([*batch.columns, pa.array(np.concatenate(scores), pa.float64())], names=[*names, "score"])

    scored = docs.mapInArrow(score, f"{schema}, score double")
    return scored.withColumns({"held_out": crc_of_id() % 3 == 1, "predicted": (F.col("score") >= 0.5).cast("int")})
