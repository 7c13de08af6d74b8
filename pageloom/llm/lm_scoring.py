"""Masked pseudo-likelihood of documents from a bidirectional window network.

Every token is predicted from the two tokens on either side of it, itself hidden:
one table a side position, summed and rectified, then a softmax over ``CLASSES``
frequency classes and one over the members of the token's class. A document's
score is the sum of the logarithms of these conditional probabilities.

Tokens are whitespace-separated words: the ``VOCABULARY`` most frequent of the whole corpus,
all others by one of ``BUCKETS`` hash buckets. Below a bucket every word keeps a probability
of its own, its share of the bucket's occurrences in the full word-count table, and ln p(word | bucket)
is part of the score: counts of the ``LISTED`` most frequent words at most go to the tasks,
those of all other words are joined in Spark, so the result does not depend on ``LISTED``. Training starts from the unigram
distribution of the whole corpus and takes every position of every document once: each partition runs its own gradient steps in numpy,
and the weights are averaged by positions seen, in two levels of Spark groups.

Defined cases: null and empty texts have no tokens, a sum of 0 and a null mean;
repeated rows get equal scores; columns named as the results are replaced, others
stay; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import text_bytes, write_shared
from pageloom.llm.shingles import word_hashes

VOCABULARY, BUCKETS = 3840, 256
#: So many word counts are sent to the tasks; the others are joined.
LISTED = 400_000
_FIXED = 1 << 32
CLASSES = 64
N_TOKENS = VOCABULARY + BUCKETS
MEMBERS = N_TOKENS // CLASSES
PAD = N_TOKENS
SIDES = (-2, -1, 1, 2)
HIDDEN = 24
BATCH = 4096
#: Rows of one product when scoring: few enough that no kernel treats one of them unlike the others (a test compares bits). CLASSES and MEMBERS are equal, so one buffer serves both.
TILE = 8
#: Adagrad: length of a step, and the squares it starts from; small, so that rare words' weights move as well.
RATE = 0.07
SQUARES = 1e-8
PIECES = 256
FAN_IN = 32
BLOCK_BYTES = 4 << 20
CHUNK = 1 << 12
_MASK = np.uint64((1 << 53) - 1)


def _blocks(column, most: int = BLOCK_BYTES):
    data, offsets = text_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): occurrences of every word hash over the whole corpus, pre-aggregated by block."""

    def count(batches):
        import pyarrow as pa

        held: list[np.ndarray] = []

        def emit():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for at in range(0, len(keys), 50_000):
                yield pa.record_batch([pa.array(keys[at : at + 50_000].view(np.int64)), pa.array(n[at : at + 50_000])], names=["word", "n"])

        for batch in batches:
            for _, _, data, offsets in _blocks(batch.column(0)):
                words = word_hashes(data, offsets)[0] & _MASK
                if len(words):
                    held.append(words)
                if sum(map(len, held)) > 4_000_000:
                    yield from emit()
        if held:
            yield from emit()

    return docs.select(text).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Word hashes to token numbers; numbers are ranks by frequency, so a class is a run of them.

    ``counts`` are of all that is told apart without a join: the listed words, and what else is in each bucket.
    ``least`` is the count from which words are listed, ``table`` the written counts of all words.
    """

    def __init__(self, words: list[int], counts: list[int], others: np.ndarray, listed: np.ndarray, listed_counts: np.ndarray, least: int, table: DataFrame | None) -> None:
        totals = np.zeros(N_TOKENS)
        totals[: len(counts)] = counts
        totals[VOCABULARY:] = others
        rank = np.empty(N_TOKENS, np.int64)
        rank[np.argsort(-totals, kind="stable")] = np.arange(N_TOKENS)
        order = np.argsort(np.array(words, np.int64))
        self.keys = np.array(words, np.int64)[order].view(np.uint64)
        self.ranks = rank[: len(words)][order]
        self.bucket_ranks = rank[VOCABULARY:]
        self.token_counts = np.sort(totals)[::-1].copy()
        self.bucket_logs = np.log(np.maximum(others, 1))
        order = np.argsort(listed)
        self.listed = listed[order].view(np.uint64)
        self.listed_logs = np.log(listed_counts[order])
        left = others - np.bincount(_bucket(self.listed), listed_counts[order], BUCKETS)
        self.counts = np.concatenate((np.array(counts, float), listed_counts, left))
        self.least, self.table = least, table

    def __getstate__(self):
        return {**self.__dict__, "table": None}

    def within(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ln p(word | token) of each word, is unlisted): of an unlisted word, less ln of its count."""
        low = words & _MASK
        out = np.zeros(len(low))
        unlisted = np.zeros(len(low), bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, low), len(self.keys) - 1)
            rest = np.flatnonzero(self.keys[at] != low)
        else:
            rest = np.arange(len(low))
        low = low[rest]
        out[rest] = -self.bucket_logs[_bucket(low)]
        if len(self.listed):
            at = np.minimum(np.searchsorted(self.listed, low), len(self.listed) - 1)
            known = self.listed[at] == low
            out[rest[known]] += self.listed_logs[at[known]]
            rest = rest[~known]
        unlisted[rest] = True
        return out, unlisted

    def tokens(self, words: np.ndarray) -> np.ndarray:
        low = words & _MASK
        bucket = self.bucket_ranks[_bucket(low)]
        if not len(self.keys):
            return bucket
        at = np.minimum(np.searchsorted(self.keys, low), len(self.keys) - 1)
        return np.where(self.keys[at] == low, self.ranks[at], bucket)


def _bucket(low: np.ndarray) -> np.ndarray:
    return ((low >> np.uint64(11)) % np.uint64(BUCKETS)).astype(np.intp)


def fit_vocabulary(docs: DataFrame, text: str = "text") -> Vocabulary:
    """The most frequent words (bounded lists), the counts of the buckets of all others, and the table of all counts."""
    counts = write_shared(word_counts(docs, text), "word-counts")
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY)
    words = [(r["word"], r["n"]) for r in top.collect()]
    rest = counts.join(F.broadcast(top.select("word")), "word", "left_anti")  # VOCABULARY rows at most
    sums = rest.groupBy(F.expr(f"shiftright(word, 11) % {BUCKETS}").alias("b")).agg(F.sum("n").alias("n")).collect()
    others = np.zeros(BUCKETS)
    for r in sums:
        others[r["b"]] = r["n"]
    # the count from which no more than LISTED words are left
    least, held = 1 << 20, 0
    for r in counts.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect():
        held += r["words"]
        if held > LISTED:
            least = r["n"] + 1
            break
        least = r["n"]
    listed = rest.filter(F.col("n") >= least).toArrow()
    number = lambda name: listed.column(name).to_numpy().astype(np.int64)
    return Vocabulary([w for w, _ in words], [n for _, n in words], others, number("word"), number("n"), least, counts)


class WindowNetwork:
    """Parameters as one flat vector with named views."""

    SHAPES = {"sides": (len(SIDES), N_TOKENS + 1, HIDDEN), "bias": (HIDDEN,), "to_class": (HIDDEN, CLASSES), "class_bias": (CLASSES,), "to_member": (CLASSES, HIDDEN, MEMBERS), "member_bias": (CLASSES, MEMBERS)}

    def __init__(self, flat: np.ndarray) -> None:
        self.flat, self.held, at = flat, None, 0
        for name, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, flat[at : at + size].reshape(shape))
            at += size

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(s)) for s in cls.SHAPES.values())

    @classmethod
    def unigram(cls, counts: np.ndarray, seed: int = 5) -> WindowNetwork:
        """Small random weights around the corpus frequencies."""
        rng = np.random.default_rng(seed)
        net = cls(rng.normal(0, 0.05, cls.size()).astype(np.float32))
        smooth = (counts + 0.5).reshape(CLASSES, MEMBERS)
        net.class_bias[:] = np.log(smooth.sum(axis=1) / smooth.sum())
        net.member_bias[:] = np.log(smooth / smooth.sum(axis=1, keepdims=True))
        net.bias[:] = 0.1
        return net

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.sides[0][context[0]]
        for k in range(1, len(SIDES)):
            h += self.sides[k][context[k]]
        h += self.bias
        return np.maximum(h, 0, out=h)

    def log_probabilities(self, tokens: np.ndarray, context: np.ndarray) -> np.ndarray:
        """ln p(token | both sides) of each position; context has one row a side position.

        Products are of ``TILE`` rows each, so that a position's value has the same bits whatever stands beside it in the call.
        """
        order, ends = _by_class(tokens // MEMBERS)
        tokens, context = tokens[order], context[:, order]
        cls, member = tokens // MEMBERS, tokens % MEMBERS
        tiles = np.concatenate(([0], np.cumsum(-(-np.diff(ends) // TILE))))
        place = np.arange(len(tokens)) + (tiles[:-1] * TILE - ends[:-1])[cls]
        h = np.zeros((tiles[-1], TILE, HIDDEN), np.float32)
        h.reshape(-1, HIDDEN)[place] = self.hidden(context)
        z = (h @ self.to_class + self.class_bias).reshape(-1, CLASSES)
        logs = z[place, cls] - _log_sum(z)[place]
        z = z.reshape(-1, TILE, MEMBERS)
        for c in range(CLASSES):
            own = slice(tiles[c], tiles[c + 1])
            if tiles[c] < tiles[c + 1]:
                np.matmul(h[own], self.to_member[c], out=z[own])
                z[own] += self.member_bias[c]
        z = z.reshape(-1, MEMBERS)
        logs += z[place, member] - _log_sum(z)[place]
        out = np.empty(len(tokens))
        out[order] = logs
        return out

    def member_logits(self, h: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Logits over the members of the own class, for rows in class order."""
        z = np.empty((len(h), MEMBERS), np.float32)
        for c in range(CLASSES):
            own = slice(ends[c], ends[c + 1])
            if ends[c] < ends[c + 1]:
                np.matmul(h[own], self.to_member[c], out=z[own])
                z[own] += self.member_bias[c]
        return z

    def step(self, tokens: np.ndarray, context: np.ndarray, squares: np.ndarray) -> None:
        """One Adagrad step on a batch."""
        if self.held is None:  # kept from step to step: fresh pages cost more than the sums
            self.held = WindowNetwork(np.zeros_like(self.flat)), np.empty_like(self.flat)
        slope, spare = self.held
        first, n = self.sides.size, len(tokens)
        slope.flat[first:] = 0
        order, ends = _by_class(tokens // MEMBERS)  # a batch is a sum, so its order is free
        tokens, context = tokens[order], context[:, order]
        cls, member, rows = tokens // MEMBERS, tokens % MEMBERS, np.arange(n)
        h = self.hidden(context)
        p = _shares(h @ self.to_class + self.class_bias)
        p[rows, cls] -= 1
        p *= np.float32(1 / n)
        slope.to_class[:], slope.class_bias[:] = h.T @ p, p.sum(axis=0)
        back = p @ self.to_class.T
        p = _shares(self.member_logits(h, ends))
        p[rows, member] -= 1
        p *= np.float32(1 / n)
        for c in range(CLASSES):
            own = slice(ends[c], ends[c + 1])
            if ends[c] < ends[c + 1]:
                slope.to_member[c], slope.member_bias[c] = h[own].T @ p[own], p[own].sum(axis=0)
                back[own] += p[own] @ self.to_member[c].T
        back *= h > 0
        slope.bias[:] = back.sum(axis=0)
        unit = np.arange(HIDDEN)
        # of the tables beside a position only the rows of tokens in this batch have a slope; the others would not move
        touched = []
        for k in range(len(SIDES)):
            rows = np.flatnonzero(np.bincount(context[k], minlength=N_TOKENS + 1))
            place = np.empty(N_TOKENS + 1, np.int64)
            place[rows] = np.arange(len(rows)) * HIDDEN
            at = (place[context[k]][:, None] + unit).ravel()
            slope.sides[k, rows] = np.bincount(at, back.ravel(), len(rows) * HIDDEN).reshape(-1, HIDDEN)
            touched.append(rows)
        squares_of_sides = squares[:first].reshape(self.sides.shape)
        for k, rows in enumerate(touched):
            g = slope.sides[k, rows]
            total = squares_of_sides[k, rows] + g * g
            squares_of_sides[k, rows] = total
            self.sides[k, rows] -= np.float32(RATE) * (g / (np.sqrt(total) + np.float32(1e-6)))
        g, spare = slope.flat[first:], spare[first:]
        squares[first:] += np.multiply(g, g, out=spare)
        np.sqrt(squares[first:], out=spare)
        spare += np.float32(1e-6)
        np.divide(g, spare, out=spare)
        spare *= np.float32(RATE)
        self.flat[first:] -= spare


def _by_class(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in class order, and where each class begins and ends there."""
    order = np.argsort(cls.astype(np.uint8), kind="stable")
    return order, np.searchsorted(cls[order], np.arange(CLASSES + 1))


def _shares(z: np.ndarray) -> np.ndarray:
    """Softmax of every row, in place; rows are shifted by their maximum only where exp could leave the range of a float."""
    if len(z) and (z.max() > 40 or z.min() < -40):
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def _log_sum(z: np.ndarray) -> np.ndarray:
    top = z.max(axis=1)
    z -= top[:, None]
    np.exp(z, out=z)
    return top + np.log(z.sum(axis=1))


def contexts(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Token numbers beside each position, PAD beyond the own text."""
    of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    out = np.full((len(SIDES), len(tokens)), PAD, np.int64)
    for k, d in enumerate(SIDES):
        if len(tokens) <= abs(d):
            continue
        here, there = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
        out[k, here] = np.where(of[here] == of[there], tokens[there], PAD)
    return out


def train(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> WindowNetwork:
    """Local steps in every partition, then the weighted mean of the partitions' weights."""
    start = WindowNetwork.unigram(vocabulary.token_counts).flat

    def local(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        net, squares, seen = WindowNetwork(start.copy()), np.full(len(start), SQUARES, np.float32), 0
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def learn(least: int) -> int:
            tokens = np.concatenate([w[0] for w in waiting])
            context = np.concatenate([w[1] for w in waiting], axis=1)
            waiting.clear()
            done = 0
            while len(tokens) - done >= least:
                net.step(tokens[done : done + BATCH], context[:, done : done + BATCH], squares)
                done = min(done + BATCH, len(tokens))
                if done == len(tokens):
                    break
            if done < len(tokens):
                waiting.append((tokens[done:], context[:, done:]))
            return done

        for batch in batches:
            for _, _, data, offsets in _blocks(batch.column(0)):
                words, ends = word_hashes(data, offsets)
                tokens = vocabulary.tokens(words)
                if len(tokens):
                    waiting.append((tokens, contexts(tokens, ends)))
                if sum(len(w[0]) for w in waiting) >= BATCH:
                    seen += learn(BATCH)
        if waiting:
            seen += learn(1)
        if seen:
            part = TaskContext.get().partitionId()
            pieces = np.array_split(net.flat, PIECES)
            yield pa.record_batch(
                [pa.array(range(PIECES), pa.int32()), pa.array([part] * PIECES, pa.int32()), pa.array([float(seen)] * PIECES), pa.array([p.tobytes() for p in pieces], pa.binary())],
                names=["piece", "part", "seen", "weights"],
            )

    def mean(pdf):
        import pandas as pd

        seen = pdf["seen"].to_numpy()
        rows = np.array([np.frombuffer(w, np.float32) for w in pdf["weights"]], np.float64)
        merged = ((rows * seen[:, None]).sum(axis=0) / seen.sum()).astype(np.float32)
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "part": [int(pdf["part"].iloc[0]) // FAN_IN], "seen": [seen.sum()], "weights": [merged.tobytes()]})

    schema = "piece int, part int, seen double, weights binary"
    trained = write_shared(docs.select(text).mapInArrow(local, schema), "weights")
    levels = trained.agg(F.max("part")).first()[0]
    while levels is not None and levels > 0:  # FAN_IN partitions a group, level by level
        trained = trained.groupBy("piece", F.floor(F.col("part") / FAN_IN).alias("g")).applyInPandas(lambda pdf: mean(pdf), schema)
        levels //= FAN_IN
    got = {r["piece"]: r["weights"] for r in trained.collect()}
    if not got:
        return WindowNetwork(start)
    return WindowNetwork(np.concatenate([np.frombuffer(got[k], np.float32) for k in range(PIECES)]).copy())


def score_blocks(column, vocabulary: Vocabulary, net: WindowNetwork) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, summed ln p, unlisted words) of each text of an Arrow column, and those words; ln of their counts is not in the sums."""
    counts, sums, missing, rest = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first, last, data, offsets in _blocks(column):
        words, ends = word_hashes(data, offsets)
        tokens = vocabulary.tokens(words)
        context = contexts(tokens, ends)
        logs, unlisted = vocabulary.within(words)
        for at in range(0, len(tokens), CHUNK):
            logs[at : at + CHUNK] += net.log_probabilities(tokens[at : at + CHUNK], context[:, at : at + CHUNK])
        total = np.zeros(last - first)
        some = np.flatnonzero(np.diff(ends))
        if len(some):
            total[some] = np.add.reduceat(logs, ends[some])
        counts.append(np.diff(ends))
        sums.append(total)
        missing.append(np.diff(np.concatenate(([0], np.cumsum(unlisted)))[ends]))
        rest.append((words[unlisted] & _MASK).view(np.int64))
    return np.concatenate(counts), np.concatenate(sums), np.concatenate(missing), np.concatenate(rest)


def score_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with n_tokens, log_likelihood (the sum) and mean_log_likelihood."""
    docs = docs.drop("n_tokens", "log_likelihood", "mean_log_likelihood")
    vocabulary = fit_vocabulary(docs)
    flat = train(docs, vocabulary).flat
    names, at = docs.columns, docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    joins = vocabulary.least > 2  # else all unlisted words occur once, and ln 1 = 0

    def work(batches):
        import pyarrow as pa

        net = WindowNetwork(flat)
        for batch in batches:
            n, total, missing, rest = score_blocks(batch.column(at), vocabulary, net)
            out = [*batch.columns, pa.array(n, pa.int64()), pa.array(total, pa.float64())]
            if joins:
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(missing))), pa.int32()), pa.array(rest, pa.int64())))
            yield pa.record_batch(out, names=[*names, "n_tokens", "log_likelihood", "_lm_unlisted"][: len(out)])

    scored = docs.mapInArrow(work, f"{schema}, n_tokens long, log_likelihood double" + (", _lm_unlisted array<long>" if joins else ""))
    if joins:
        scored = write_shared(scored.withColumn("_lm_row", F.monotonically_increasing_id()), "scored")
        logs = vocabulary.table.filter((F.col("n") > 1) & (F.col("n") < vocabulary.least)).select("word", F.round(F.log("n") * _FIXED).cast("long").alias("fixed"))
        # whole numbers: equal texts get equal sums in any order
        more = scored.select("_lm_row", F.explode("_lm_unlisted").alias("word")).join(logs, "word").groupBy("_lm_row").agg((F.sum("fixed") / _FIXED).alias("_lm_more"))
        scored = scored.join(more, "_lm_row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("_lm_more", F.lit(0.0))).select(*names, "n_tokens", "log_likelihood")
    return scored.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
