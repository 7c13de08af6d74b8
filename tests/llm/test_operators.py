"""Corpus operators against brute force, and on nulls, empties, ties, repeats and empty tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pageloom.llm import (
    components, decontamination, line_dedup, lm_scoring, mixing, near_dedup, order_minhash, quality, shingles, suffix_dedup, surrogates, toxicity,
)
from pageloom.llm.common import text_bytes
from pageloom.sources.tables import read_table

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def hard_rows():
    """Nulls anywhere, empty and blank texts, repeated rows, ties, a long text, other columns."""
    long = " ".join(f"w{k % 977} z{k % 31}" for k in range(20_000))
    rows = [(1, "a b c d e f", "en", "s", 11, "x"), (1, "a b c d e f", "en", "s", 11, "x"), (2, None, None, None, None, None), (3, "", "en", "s", 0, None), (4, "  \n ", "de", None, 4, "y"), (None, "a b c d e f", "en", "s", 11, None), (5, long, "en", "t", len(long), ""), (6, "é 日本 🙂", "ja", "t", 6, "z")]
    return rows


def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).withColumns({"score": F.lit("clash"), "n_tokens": F.lit("clash"), "key": F.lit("clash"), "value": F.lit(1)})


def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(1, 7)] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")


def documents(spark, sf=SMALL):
    return spark.read.parquet(f"{sf}/documents.parquet")


# -- shared pieces


def test_text_bytes_of_slices_and_nulls():
    data, offsets = text_bytes(pa.array(["xx", "ab", None, "é"]).slice(1))
    assert bytes(data) == "abé".encode() and offsets.tolist() == [0, 2, 2, 4]


def test_word_hashes_depend_on_words_alone():
    texts = ["one two  three", "", "two\nthree four", " one"]
    hashes, ends = shingles.word_hashes(*text_bytes(pa.array(texts)))
    words = [w for t in texts for w in t.split()]
    assert np.diff(ends).tolist() == [3, 0, 3, 1] and len(hashes) == len(words)
    known = {}
    for w, h in zip(words, hashes.tolist(), strict=True):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200 + k, 201 + k) for k in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# -- 1


def test_lm_gradient_is_the_slope_of_the_likelihood():
    rng = np.random.default_rng(1)
    tokens, context = rng.integers(0, lm_scoring.N_TOKENS, 64), rng.integers(0, lm_scoring.N_TOKENS + 1, (4, 64))
    net = lm_scoring.WindowNetwork.unigram(np.ones(lm_scoring.N_TOKENS))
    before = net.log_probabilities(tokens, context).sum()
    squares = np.full(len(net.flat), 1e-4, np.float32)
    for _ in range(5):
        net.step(tokens, context, squares)
    assert net.log_probabilities(tokens, context).sum() > before


def test_lm_gradient_against_finite_differences():
    rng = np.random.default_rng(2)
    tokens, context = rng.integers(0, lm_scoring.N_TOKENS, 40), rng.integers(0, lm_scoring.N_TOKENS + 1, (len(lm_scoring.SIDES), 40))
    net = lm_scoring.WindowNetwork.unigram(np.ones(lm_scoring.N_TOKENS))
    start = net.flat.copy()
    net.step(tokens, context, np.full(len(start), 1e-4, np.float32))
    slope = net.held[0].flat.copy()

    def loss(at, by):
        moved = start.copy()
        moved[at] += by
        return -lm_scoring.WindowNetwork(moved.astype(float)).log_probabilities(tokens, context).astype(float).mean()

    ends = np.cumsum([int(np.prod(shape)) for shape in net.SHAPES.values()])
    for first, last in zip(np.concatenate(([0], ends[:-1])), ends):  # the steepest of every part
        for at in first + np.argsort(-np.abs(slope[first:last]))[:3]:
            numeric = (loss(at, 2e-3) - loss(at, -2e-3)) / 4e-3
            assert abs(numeric - slope[at]) < 0.05 * abs(slope[at]) + 2e-4


def test_lm_document_sums_against_a_plain_loop(spark):
    docs = documents(spark).filter("length(text) < 1500").limit(12).select("doc_id", "text").cache()
    vocabulary = lm_scoring.fit_vocabulary(docs)
    net = lm_scoring.train(docs, vocabulary)
    counts = collections.Counter(w for r in docs.collect() for w in r.text.split())
    number = {w: int(vocabulary.tokens(shingles.word_hashes(*text_bytes(pa.array([w])))[0])[0]) for w in counts}
    bucket = collections.Counter()
    for w, n in counts.items():
        bucket[number[w]] += n

    def log_p(words, k):
        around = [number[words[k + d]] if 0 <= k + d < len(words) else lm_scoring.PAD for d in lm_scoring.SIDES]
        h = np.maximum(sum(net.sides[j][a].astype(float) for j, a in enumerate(around)) + net.bias, 0)
        cls, member = divmod(number[words[k]], lm_scoring.MEMBERS)
        z, y = h @ net.to_class + net.class_bias, h @ net.to_member[cls] + net.member_bias[cls]
        within = np.log(counts[words[k]] / bucket[number[words[k]]])  # the own share of a bucket; one of a word that has its own number
        return z[cls] - np.log(np.exp(z).sum()) + y[member] - np.log(np.exp(y).sum()) + within

    for r in docs.collect():
        total = lm_scoring.score_blocks(pa.array([r.text]), vocabulary, net)[1][0]
        words = r.text.split()
        assert abs(total - sum(log_p(words, k) for k in range(len(words)))) < 1e-3 * max(len(words), 1)


def test_lm_probabilities_sum_to_one():
    net = lm_scoring.WindowNetwork.unigram(np.arange(lm_scoring.N_TOKENS) + 1.0)
    context = np.array([[3], [lm_scoring.PAD], [7], [9]])
    every = net.log_probabilities(np.arange(lm_scoring.N_TOKENS), np.repeat(context, lm_scoring.N_TOKENS, axis=1))
    assert abs(np.exp(every.astype(float)).sum() - 1) < 1e-3


def test_lm_values_do_not_depend_on_what_is_scored_beside_them():
    rng = np.random.default_rng(3)
    net = lm_scoring.WindowNetwork(rng.normal(0, 1, lm_scoring.WindowNetwork.size()).astype(np.float32))
    tokens, context = rng.integers(0, lm_scoring.N_TOKENS, 3000), rng.integers(0, lm_scoring.N_TOKENS + 1, (len(lm_scoring.SIDES), 3000))
    whole = net.log_probabilities(tokens, context)
    for first, last in ((0, 1), (1, 3), (17, 90), (5, 2900)):
        assert (net.log_probabilities(tokens[first:last], context[:, first:last]) == whole[first:last]).all()
    for _ in range(20):
        some = rng.integers(0, 3000, rng.integers(1, 4000))
        assert (net.log_probabilities(tokens[some], context[:, some]) == whole[some]).all()


def test_lm_scores(spark):
    docs = documents(spark)
    rows = lm_scoring.score_documents(docs.select("doc_id", "text")).collect()
    assert len(rows) == 200 and all(r.n_tokens == len(r.text.split()) for r in rows)
    vocabulary = lm_scoring.fit_vocabulary(docs)
    p = vocabulary.counts[vocabulary.counts > 0] / vocabulary.counts.sum()
    unigram = (p * np.log(p)).sum()
    mean = sum(r.log_likelihood for r in rows) / sum(r.n_tokens for r in rows)
    assert mean > unigram  # one round over a very small table


def test_lm_gains_on_the_frequencies(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents").select("text")
    vocabulary = lm_scoring.fit_vocabulary(docs)
    words, ends = shingles.word_hashes(*text_bytes(docs.toArrow().column(0).combine_chunks()))
    tokens = vocabulary.tokens(words)
    context = lm_scoring.contexts(tokens, ends)
    net = lm_scoring.train(docs.coalesce(1), vocabulary)
    own = np.log(vocabulary.token_counts[tokens] / len(tokens))
    assert net.log_probabilities(tokens, context).mean() > own.mean() + 0.1


def test_lm_hard_rows(spark):
    got = lm_scoring.score_documents(hard(spark)).collect()
    assert len(got) == 8 and [r.log_likelihood for r in got if r.doc_id in (2, 3, 4)] == [0, 0, 0] and all(r.mean_log_likelihood is None for r in got if r.doc_id == 2)
    assert len({r.log_likelihood for r in got if r.doc_id == 1}) == 1
    assert lm_scoring.score_documents(hard(spark).limit(0)).count() == 0


def test_lm_trains_on_every_position(spark):
    docs = documents(spark)
    vocabulary = lm_scoring.fit_vocabulary(docs)
    seen = []
    real = lm_scoring.write_shared

    def watched(df, name):
        out = real(df, name)
        if name == "weights":
            seen.append(out.filter("piece = 0").agg(F.sum("seen")).first()[0])
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lm_scoring, "write_shared", watched)
        net = lm_scoring.train(docs, vocabulary)
    texts = [r.text for r in docs.select("text").collect()]
    assert seen == [sum(len(t.split()) for t in texts)]
    start = lm_scoring.WindowNetwork.unigram(vocabulary.token_counts)
    words, ends = shingles.word_hashes(*text_bytes(pa.array(texts)))
    tokens = vocabulary.tokens(words)
    context = lm_scoring.contexts(tokens, ends)
    p = vocabulary.token_counts[tokens] / len(tokens)
    assert net.log_probabilities(tokens, context).mean() > max(np.log(p).mean(), start.log_probabilities(tokens, context).mean())


def test_lm_words_keep_probabilities_of_their_own(spark, monkeypatch):
    docs = documents(spark).filter("doc_id % 4 = 0").select("doc_id", "text").withColumn("text", F.concat("text", F.lit(" zqx zqx zqy")))
    docs = docs.limit(1).withColumn("text", F.concat("text", F.lit(" zqz"))).unionAll(docs).cache()
    every = lm_scoring.score_documents(docs).collect()
    monkeypatch.setattr(lm_scoring, "VOCABULARY", 3840)
    monkeypatch.setattr(lm_scoring, "LISTED", 100)
    vocabulary = lm_scoring.fit_vocabulary(docs)
    assert vocabulary.least > 2 and len(vocabulary.listed) == 0
    counts = collections.Counter(w for r in docs.collect() for w in r.text.split())
    words, n = zip(*counts.items(), strict=True)
    hashes = shingles.word_hashes(*text_bytes(pa.array([" ".join(words)])))[0]
    logs, unlisted = vocabulary.within(hashes)
    n = np.array(n, float)
    own = np.where(unlisted, np.exp(logs) * n, 0)
    assert abs(own.sum() - (vocabulary.token_counts > 0).sum() + (~unlisted).sum()) < 1e-6  # they sum to one in every bucket
    joined = {(r.doc_id, r.text): r for r in lm_scoring.score_documents(docs).collect()}
    assert len(every) == docs.count()
    for r in every:
        assert abs(joined[r.doc_id, r.text].log_likelihood - r.log_likelihood) < 1e-3 * r.n_tokens


# -- 2


def brute_repeats(rows, keep):
    counts, first = collections.Counter(), {}
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [(i, (t or "").encode()) for i, t in rows]
    for n, (_, b) in enumerate(texts):
        for k in range(len(b) - 199):
            counts[b[k : k + 200]] += 1
            first.setdefault(b[k : k + 200], (n, k))
    out = []
    for n, (i, b) in enumerate(texts):
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 199):
            s = b[k : k + 200]
            if counts[s] > 1 and (keep == "none" or first[s] != (n, k)):
                gone[k] += 1
                gone[k + 200] -= 1
        cut = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~cut].tobytes()
        out.append((i, len(b), int(cut.sum()), int((np.diff(np.concatenate(([0], cut.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("hot", [2000, 1])
def test_repeats_against_brute_force(spark, keep, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    docs = documents(spark).filter("n_chars < 3000").select("doc_id", "text")
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs, keep=keep, with_bytes=False).collect()), key=str)
    assert got == brute_repeats([tuple(r) for r in docs.collect()], keep)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_a_hot_passage_is_aggregated_before_it_is_dealt(spark, keep, monkeypatch):
    rng = np.random.default_rng(4)
    word = lambda n: "".join(chr(97 + k) for k in rng.integers(0, 26, n))
    passage = word(260)
    rows = [(k if k else None, word(230) + passage + word(230)) for k in range(12)]
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    real, sorted_rows = suffix_dedup._sorted_verdicts, []
    monkeypatch.setattr(suffix_dedup, "_sorted_verdicts", lambda pieces: (sorted_rows.append(pieces.count()), real(pieces))[1])
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep=keep, with_bytes=False).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows, keep) and sorted_rows == [0]


def around_passages(n):
    """Texts around one passage, with shared ends of a few bytes, copies, a second place in the text, cut passages and periodic texts."""
    rng = np.random.default_rng(14)
    word = lambda n: "".join(chr(97 + k) for k in rng.integers(0, 26, n))
    passage, tails = word(290), [word(9) for _ in range(3)]
    rows = [(k if k else None, word(220) + tails[k % 3] + passage[k % 5 * 7 :] + tails[k % 2] + word(220)) for k in range(n)]
    rows += [(n + k, rows[k][1]) for k in range(3)]
    periods = ["ab" * 300 + word(50), word(50) + "ab" * 250 + "a", "x" * 450 + "y", "z" + "x" * 300, word(30) + "abc" * 150]
    return [*rows, *enumerate([passage + "-" + passage + word(30), passage, *periods], n + 3)]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("hot", [1, 4, 16])
def test_blocks_of_a_hot_passage_against_brute_force(spark, keep, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = around_passages(24)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep=keep, with_bytes=False).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows, keep)


def test_rows_of_a_hot_passage_grow_with_its_texts_and_few_are_single_strings(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 4)
    real, counted = suffix_dedup.write_shared, collections.Counter()

    def write(df, name):
        out = real(df, name)
        counted[name] += out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "write_shared", write)
    seen = []
    for n in (30, 60):
        counted.clear()
        suffix_dedup.remove_repeats(spark.createDataFrame(around_passages(n), "doc_id long, text string"), with_bytes=False).collect()
        seen.append((counted["hot-strings"], counted["verdicts"]))
    (strings, verdicts), (more_strings, more_verdicts) = seen
    assert 0 < more_strings < 2.5 * strings and more_verdicts < 2.5 * verdicts
    assert strings < 100 * 30 and verdicts < 60 * 30  # each text has about 480 strings that touch the passage


def test_repeats_within_a_text_and_hard_rows(spark):
    unit = "".join(chr(97 + k) for k in np.random.default_rng(9).integers(0, 26, 250))
    rows = [(1, "é" + unit + "-" + unit), (2, "ab" * 300), (3, "x" * 199), (4, None), (5, "y" * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs, with_bytes=False).collect()), key=str) == brute_repeats(rows, "none")
    plain = [(r[0], r[1]) for r in hard_rows()]
    assert sorted((tuple(r) for r in suffix_dedup.remove_repeats(hard(spark), with_bytes=False).collect()), key=str) == brute_repeats(plain, "none")
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    kept = {r.doc_id: r.kept for r in suffix_dedup.remove_repeats(docs, keep="first").collect()}
    assert bytes(kept[1]).decode() == "é" + unit + "-"


def test_suffix_ranks_and_previous_factors():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 900).astype(np.uint8)
    data[500:800] = data[100:400]
    data[820:900] = 97
    starts = np.arange(700)
    ranks = suffix_dedup.suffix_ranks(data, starts)
    strings = [data[k : k + 200].tobytes() for k in starts]
    order = sorted(set(strings))
    assert ranks.tolist() == [order.index(s) for s in strings]
    places = rng.permutation(700)
    lpf, later = suffix_dedup.previous_factors(data, starts, places)

    def common(a, b):
        return next((k for k, (x, y) in enumerate(zip(strings[a], strings[b], strict=True)) if x != y), 200)

    for k in range(0, 700, 7):
        assert lpf[k] == max((common(k, j) for j in range(700) if places[j] < places[k]), default=0)
        assert later[k] == max((common(k, j) for j in range(700) if places[j] > places[k]), default=0)


def test_smaller_values_before():
    rng = np.random.default_rng(6)
    for values in (rng.permutation(500), np.arange(300)[::-1], np.arange(300), np.zeros(0, int), rng.integers(0, 9, 200)):
        want = [next((j for j in range(k - 1, -1, -1) if values[j] < values[k]), -1) for k in range(len(values))]
        assert suffix_dedup.smaller_before(values).tolist() == want


# -- 3


def test_weighted_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in rng.integers(0, 400, 300)]
    texts = [" ".join(base)] + [" ".join(base[:k] + ["new"] + base[k + 1 :]) for k in (30, 60, 90)]
    data, offsets = text_bytes(pa.array(texts))
    text, keys, weight = near_dedup.weighted_shingles(data, offsets, np.zeros(0, np.uint64), np.zeros(0))
    assert set(weight.tolist()) <= {2.0, 4.0}
    samples = near_dedup.signatures(4, text, keys, weight)
    assert (samples[0] == samples[1]).mean() > 0.7 and (near_dedup.bands_of(samples)[0] == near_dedup.bands_of(samples)[1]).any()


def brute_classes(rows, model):
    """Smallest id of the component of every text, from the exact similarities of all pairs that share a shingle."""
    data, offsets = text_bytes(pa.array([t for _, t in rows]))
    text, keys, weight = near_dedup.weighted_shingles(data, offsets, model[1], model[2])
    total = np.bincount(text, weight, len(rows))
    shared = np.zeros((len(rows), len(rows)))
    order = np.argsort(keys, kind="stable")
    text, keys, weight = text[order], keys[order], weight[order]
    bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a > 1:
            shared[np.ix_(text[a:b], text[a:b])] += np.minimum.outer(weight[a:b], weight[a:b])
    linked = np.argwhere(np.triu(shared / np.maximum(total[:, None] + total[None, :] - shared, 1e-12) >= 0.8, 1))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in linked.tolist():
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    smallest = {}
    for t, (i, _) in enumerate(rows):
        smallest[find(t)] = min(smallest.get(find(t), i), i)
    return {i: smallest[find(t)] for t, (i, _) in enumerate(rows)}


def test_near_classes_against_brute_force(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()} == brute_classes(rows, near_dedup.common_words(docs))


def crowd():
    """Copies of one text with few and many edits, and texts around one long passage: most are just under the threshold."""
    rng = np.random.default_rng(12)
    word = lambda: f"w{rng.integers(0, 10**9)}"
    base, passage = [word() for _ in range(150)], [word() for _ in range(120)]
    texts = []
    for _ in range(220):
        words = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 7)):
            words[at] = word()
        texts.append(words)
    for _ in range(120):
        texts.append([word() for _ in range(rng.integers(0, 30))] + passage + [word() for _ in range(rng.integers(0, 30))])
    return [(k, " ".join(w)) for k, w in enumerate(texts)]


@pytest.mark.parametrize("crowded", [1, 10**9])
def test_near_classes_of_a_crowd(spark, monkeypatch, crowded):
    monkeypatch.setattr(near_dedup, "CROWDED", crowded)
    verified = []
    real = near_dedup.verify
    monkeypatch.setattr(near_dedup, "verify", lambda pairs, *rest: (verified.append(pairs.count()), real(pairs, *rest))[1])
    rows = crowd()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows, near_dedup.common_words(docs))
    assert 40 < len(set(want.values())) < 300
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    # a text whose only links are close to the threshold shares a band with none of them in a few of a thousand cases
    assert sum(got[i] != want[i] for i in want) <= 1
    assert sum(verified) < 20 * len(rows)  # far fewer than the 31,000 pairs of the two groups


def test_recall_of_the_bands():
    rng = np.random.default_rng(8)
    found = {}
    for edits in (2, 3):
        texts = []
        for _ in range(400):
            words = [f"v{k}" for k in rng.integers(0, 10**9, 28 * edits)]
            other = list(words)
            for k in range(edits):
                other[14 + 28 * k - rng.integers(0, 3)] = "changed"
            texts += [" ".join(words), " ".join(other)]
        text, keys, weight = near_dedup.weighted_shingles(*text_bytes(pa.array(texts)), np.zeros(0, np.uint64), np.zeros(0))
        held = [dict(zip(keys[text == t].tolist(), weight[text == t].tolist(), strict=True)) for t in (0, 1)]
        shared = sum(min(held[0][k], held[1][k]) for k in held[0].keys() & held[1].keys())
        similarity = shared / (sum(held[0].values()) + sum(held[1].values()) - shared)
        bands = near_dedup.bands_of(near_dedup.signatures(len(texts), text, keys, weight))
        found[round(similarity, 2)] = (bands[::2] == bands[1::2]).any(axis=1).mean()
    assert all(0.65 < s < 0.9 for s in found) and min(found.values()) >= 0.9, found


def test_near_hard_rows(spark):
    got = near_dedup.near_classes(hard(spark)).collect()
    assert len(got) == 8
    sizes = {r.doc_id: r.class_size for r in got}
    assert sizes[1] == 3 and sizes[None] == 3 and sizes[2] == sizes[3] == sizes[4] == 1
    kept = near_dedup.drop_near_copies(hard(spark)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 3, 4, 5, 6] and {r.doc_id: r.extra for r in kept}[1] == "x"
    assert near_dedup.drop_near_copies(hard(spark).limit(0)).count() == 0


def test_near_classes_of_null_and_repeated_ids(spark):
    texts = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcde"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[0]), (None, None), (7, texts[2]), (7, texts[3]), (7, texts[2]), (9, texts[4]), (None, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(None, texts[0]), (None, texts[1]), (None, None), (7, texts[2]), (7, texts[3]), (9, texts[4])], key=str)
    assert sorted((tuple(r) for r in near_dedup.drop_near_copies(docs).collect()), key=str) == want
    got = near_dedup.near_classes(docs).collect()
    assert len(got) == 9 and len({r.class_key for r in got}) == 6 and len({(r.class_key, r.class_id, r.class_size) for r in got}) == 6


# -- 4


def words_of(t):
    out, word = [], ""
    for ch in (t or "").lower() + " ":
        if ch.isalnum():
            word += ch
        elif word:
            out.append(word)
            word = ""
    return out


def test_leaks_against_brute_force(spark):
    item = " ".join(f"word{k}" for k in range(60))
    changed = item.replace("word30 ", "other ")
    broken = " ".join(w if k % 6 else "zz" for k, w in enumerate(item.split()))
    texts = [(1, f"start {item} end"), (2, f"a b {changed.upper()}!"), (3, broken), (4, None), (5, ""), (6, item.replace(" ", "; ")), (1, f"start {item} end"), (7, "one two three"), (8, "nothing here")]
    bench = spark.createDataFrame([(10, item), (11, "One, two three"), (12, None), (13, ""), (10, item)], "item_id long, text string")
    got = decontamination.leaks(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()
    found = {(r.doc_id, r.item_id): r for r in got}
    assert set(found) == {(1, 10), (2, 10), (6, 10), (7, 11)}
    n = len(words_of(item)) - 4
    assert abs(found[2, 10].similarity - (n - 5) / (n + 5)) < 1e-9 and found[1, 10].start_word == 1 and found[1, 10].hamming == 0
    left = decontamination.drop_contaminated(spark.createDataFrame(texts, "doc_id long, text string"), bench)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 8]


@pytest.mark.parametrize("most", [20_000, 0])
def test_leaks_cut_by_an_end_of_the_text_and_of_short_items(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "MAX_LITERAL_PROBES", most)
    item = [f"word{k}" for k in range(16)]
    longer = [f"term{k}" for k in range(59)]
    rows = [(1, ["x", "y", "z", *item[:15]]), (2, [*item[1:], "x", "y"]), (3, ["q"] * 7 + longer[:56]), (4, longer[3:] + ["r"] * 9), (5, "we saw one Two three of them".split()), (6, "one two of three more words here".split()), (7, "words before one two three".split()), (8, item[:15])]
    bench = [(10, item), (11, longer), (12, ["one", "two", "three"])]
    got = {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in decontamination.leaks(*(spark.createDataFrame([(i, " ".join(w)) for i, w in x], f"{n} long, text string") for x, n in ((rows, "doc_id"), (bench, "item_id")))).collect()}
    weight = lambda s, held: 1 + np.log(3 / held[s]) if s in held else 1 + np.log(3)
    parts = lambda w: collections.Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1)))
    held = collections.Counter(s for _, w in bench for s in parts(w))
    want = {}
    for i, text in rows:
        text = [w.lower() for w in text]
        for j, words in bench:
            mine, best = parts(words), (0.0, 0)
            for at in range(len(text) - len(words) + 1):
                yours = parts(text[at : at + len(words)])
                sums = [sum(f(mine[s], yours[s]) * weight(s, held) for s in mine | yours) for f in (min, max)]
                best = max(best, (sums[0] / sums[1], -at))
            if best[0] >= 0.8:
                want[i, j] = (-best[1], best[0])
    assert set(want) >= {(1, 10), (2, 10), (3, 11), (4, 11), (5, 12), (7, 12)}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_leaks_against_every_window(spark):
    """All windows of all texts, by their exact similarity: at least nine tenths of the pairs, and each at its best window."""
    rng = np.random.default_rng(21)
    bench = [(k, [f"b{k}x{j}" for j in range(n)]) for k, n in enumerate((12, 16, 20, 31, 40, 59, 80))]
    rows = []
    for k in range(140):
        item = list(bench[k % 7][1])
        for _ in range(rng.integers(0, 1 + len(item) // 10)):  # words changed, put in and left out
            at, kind = rng.integers(0, len(item)), rng.integers(0, 3)
            item[at : at + (kind != 1)] = [] if kind == 2 else [f"new{rng.integers(10**6)}"]
        rows.append((k, [f"f{j}" for j in rng.integers(0, 900, rng.integers(0, 40))] + item + [f"f{j}" for j in rng.integers(0, 900, rng.integers(0, 40))]))
    frame = lambda x, n: spark.createDataFrame([(i, " ".join(w)) for i, w in x], f"{n} long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(frame(rows, "doc_id"), frame(bench, "item_id")).collect()}
    parts = lambda w: collections.Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1)))
    want = {}
    for i, text in rows:
        for j, words in bench:
            mine = parts(words)
            for at in range(len(text) - len(words) + 1):
                yours = parts(text[at : at + len(words)])
                s = sum((mine & yours).values()) / sum((mine | yours).values())  # here every shingle weighs the same
                if s >= 0.8 and s > want.get((i, j), (0, 0))[0] + 1e-12:
                    want[i, j] = (s, at)
    assert len(want) > 40 and set(got) <= set(want) and len(got) >= 0.9 * len(want)
    best = [k for k in got if abs(got[k].similarity - want[k][0]) < 1e-9 and got[k].start_word == want[k][1]]
    assert len(best) >= 0.97 * len(got)


def test_leaks_of_items_with_repeated_shingles(spark):
    """Repeats count as often as they stand: items and texts of few words, by all windows, at their exact similarity."""
    rng = np.random.default_rng(5)
    laugh = ["ha"] * 100
    bench = [(0, [f"w{k}" for k in range(11)] + laugh), (1, [f"v{k % 7}" for k in range(40)]), (2, ["x", "y"] * 15 + [f"u{k}" for k in range(25)])]
    rows = [(0, [f"o{k}" for k in range(11)] + laugh)]
    for k in range(1, 90):
        item = list(bench[k % 3][1])
        for _ in range(rng.integers(0, 1 + len(item) // 12)):
            item[rng.integers(0, len(item))] = f"n{rng.integers(10**6)}"
        rows.append((k, [f"f{j}" for j in rng.integers(0, 900, 8)] + item + [f"f{j}" for j in rng.integers(0, 900, 8)]))
    parts = lambda w: collections.Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1)))
    held = collections.Counter(s for _, w in bench for s in parts(w))
    held = {s: sum(s in parts(w) for _, w in bench) for s in held}
    weight = lambda s: 1 + np.log(len(bench) / held.get(s, 1))
    want = set()
    for i, text in rows:
        for j, words in bench:
            mine = parts(words)
            for at in range(len(text) - len(words) + 1):
                yours = parts(text[at : at + len(words)])
                sums = [sum(f(mine[s], yours[s]) * weight(s) for s in mine | yours) for f in (min, max)]
                if sums[0] >= 0.8 * sums[1]:
                    want.add((i, j))
    frame = lambda x, n: spark.createDataFrame([(i, " ".join(w)) for i, w in x], f"{n} long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(frame(rows, "doc_id"), frame(bench, "item_id")).collect()}
    assert (0, 0) in want and (0, 0) in got and len(want) > 15
    assert got <= want and len(got) >= 0.9 * len(want)


def test_leaks_by_join_equal_leaks_by_literal(spark, monkeypatch):
    docs, bench = documents(spark), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    a = sorted(map(tuple, decontamination.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "MAX_LITERAL_PROBES", 3)
    assert a == sorted(map(tuple, decontamination.leaks(docs, bench).collect())) and a
    exact = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if b.text in d.text}
    assert exact <= {(x[0], x[1]) for x in a}
    assert decontamination.leaks(hard(spark), bench).count() == 0 and decontamination.leaks(docs.limit(0), bench).count() == 0
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0


# -- 5


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_surrogates(spark):
    text = "Mrs. Anna Smith met Mr Ivan Petrov and Dr. Smith. Call +1 (743) 555-3824 or +1 743 555 3824; a.B@c.org at 10.1.2.3 4532015112830366 078-05-1120 Token = \"24be64439e3e49cf46b2d7c90f3602a3\" GB82 WEST 1234 5698 7654 32"
    rows = [(1, text), (2, "Call +1 (743) 555-3824, a.B@c.org"), (3, None), (4, ""), (5, "nothing 12 here"), (2, "Call +1 (743) 555-3824, a.B@c.org"), (6, "Tel +1743 555 3824 of Ms. Clara Smith, A.b@C.org")]
    got = surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in got}
    assert by[1].n_entities == 11 and by[2].n_entities == 2 and by[3].text is None and by[4].text == "" and by[5].text == "nothing 12 here" and by[6].n_entities == 3
    for old in ("Anna", "Ivan", "Smith", "743", "a.B@c.org", "4532015112830366", "078-05-1120", "24be64439e", "1234 5698"):
        assert old not in by[1].text
    number = by[2].text.split("Call ")[1].split(",")[0]
    digits = lambda t: "".join(c for c in t if c.isdigit())
    assert number in by[1].text and number[:4] == "+1 (" and len(number) == 17
    assert digits(number) in digits(by[1].text.split("or ")[1]) and digits(number) == digits(by[6].text.split(" of ")[0])
    first, second = by[1].text.split("Mrs. ")[1].split()[:2]
    assert first in surrogates.NAMES["latin", "f"] and by[1].text.split("Mr ")[1].split()[0] in surrogates.NAMES["latin", "m"]
    assert f"Dr. {second}." in by[1].text and by[6].text.split("Ms. ")[1].split()[1] == second + "," and by[6].text.split("Ms. ")[1].split()[0] != first
    assert by[2].text.split(", ")[1] == by[6].text.split(", ")[1]
    card = by[1].text.split("10.1.2.3 ")[-1] if "10.1.2.3 " in by[1].text else next(w for w in by[1].text.split() if len(w) == 16 and w.isdigit())
    assert card[:2] == "45" and luhn(card)
    iban = by[1].text.split('" ')[1].replace(" ", "")
    assert iban[:2] == "GB" and iban[4:8].isalpha() and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def replaced(spark, *texts):
    df = surrogates.replace_entities(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"))
    return {r.doc_id: r.text for r in df.collect()}


def test_secrets_of_signs_and_of_few_strings(spark):
    blank = "password: ____________ and bob@real.org here"
    few = [f"token={'_' * 12}{k} then jim{k}@real.org" for k in range(10)]  # every image of these layouts is real
    got = replaced(spark, blank, *few)
    assert re.fullmatch(r"password: _{12} and \w+@h[0-9a-f]+\.example\.org here", got[0])
    secrets = []
    for k in range(10):
        found = re.fullmatch(r"token=(X[0-9a-f]{24}) then \w+@h[0-9a-f]+\.example\.org", got[k + 1])
        assert found, got[k + 1]
        secrets.append(found[1])
    assert len(set(secrets)) == 10


def test_an_entity_without_surrogate_keeps_its_place(spark, monkeypatch):
    known = surrogates.assign

    def one_less(*args):
        return known(*args).filter("entity <> '10.1.2.3'")

    monkeypatch.setattr(surrogates, "assign", one_less)
    got = replaced(spark, "a@b.org 10.1.2.3 c@d.org")[0].split()
    assert got[0].endswith(".example.org") and got[2].endswith(".example.org") and re.fullmatch("X[0-9a-f]{24}", got[1]) and got[0] != got[2]


def test_full_names_are_replaced_wherever_the_text_repeats_them(spark):
    got = replaced(spark, "Dr. Anna Smith met him. Later Anna Smith left; Anna Smithers and Joanna Smith stayed", "Anna Smith again")
    new = re.match(r"Dr\. (\p{Lu}\p{L}+(?:-\p{L}+)* \p{Lu}\p{L}+) met him\. Later (.+) left; Anna Smithers and Joanna Smith stayed".replace(r"\p{Lu}", "[A-Z]").replace(r"\p{L}", "[A-Za-z]"), got[0])
    assert new and new[1] == new[2] != "Anna Smith" and got[1] == "Anna Smith again"


def test_surrogates_stay_distinct(spark):
    rows = [("ip", f"10.0.{a}.{b}", "n") for a in range(30) for b in range(30)] + [("name", f"A{k % 40} B{k}", "f") for k in range(300)]
    rows += [("ssn", f"{k:03d}-00-{j:04d}", "n") for k in range(20) for j in range(20)] + [("phone", f"+49 30 {k:03d} {k * 7 % 1000:03d}", "n") for k in range(400)] + [("card", f"41111111{k:08d}", "n") for k in range(300)]
    rows += [("email", f"{a}{b}@d{k}.org", "n") for a in "abcde" for b in "xyz" for k in range(8)] + [("phone", f"12 3{k:02d} {j:03d}", "n") for k in range(100) for j in range(0, 1000, 10)]
    found = spark.createDataFrame(rows, "kind string, entity string, gender string")
    table = surrogates.assign(found).collect()
    assert len(table) == len(set(rows)) == len({(r.kind, r.surrogate) for r in table})
    assert not {(r.kind, r.surrogate) for r in table} & {(r.kind, r.entity) for r in table}
    names = {r.entity: r.surrogate.split() for r in table if r.kind == "name"}
    assert len({(n.split()[0], s[0]) for n, s in names.items()}) == 40 and not any("X-" in r.surrogate for r in table)
    again = {(r.kind, r.entity): r.surrogate for r in surrogates.assign(found, key="other").collect()}
    assert sum(again[r.kind, r.entity] == r.surrogate for r in table) < 0.02 * len(table)
    assert surrogates.replace_entities(hard(spark)).count() == 8 and surrogates.replace_entities(hard(spark).limit(0)).count() == 0


def test_permutations_have_no_two_equal_images(spark):
    strings = [f"{k:04d}" for k in range(10_000)] + [f"{a}{k}{b}" for a in "abcdefgh" for k in range(10) for b in "XYZ"]
    df = spark.createDataFrame([(x,) for x in strings], "s string").withColumn("t", surrogates.permuted(F.col("s"), F.lit("k"), "key"))
    rows = df.collect()
    assert len({r.t for r in rows}) == len(strings)
    kind = lambda x: ["d" if c.isdigit() else "l" if c.islower() else "u" for c in x]
    assert all(kind(r.s) == kind(r.t) for r in rows) and sum(r.s == r.t for r in rows) < 20


def test_nothing_of_the_small_corpus_survives(spark):
    docs = documents(spark)
    before = {r.entity for r in surrogates.detect(docs).filter("kind IN ('email', 'card', 'secret')").collect()}
    after = " ".join(r.text for r in surrogates.replace_entities(docs).collect())
    assert before and not [e for e in before if e in after]


# -- 6


def test_raking_meets_the_margins():
    rng = np.random.default_rng(0)
    present = rng.integers(1, 100, (4, 3, 2)).astype(float)
    targets = [np.array([0.3, 0.3, 0.2, 0.2]), np.array([0.5, 0.25, 0.25]), np.array([0.6, 0.4])]
    got = mixing.rake(present, targets, 0.3 * present.sum())
    for axis, t in enumerate(targets):
        others = tuple(k for k in range(3) if k != axis)
        assert np.allclose(got.sum(axis=others) / got.sum(), t, atol=1e-4)
    assert (got <= present + 1e-9).all()


def test_mixture(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = mixing.mixture(docs).collect()
    assert len(rows) == 1000 and all(0 <= r.probability <= 1 for r in rows)
    for r in rows:
        draw = int(hashlib.md5(f"17:{r.doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52)
        assert r.selected == (draw < r.probability) and r.n_tokens == len(r.text.split())
    expected = sum(r.n_tokens * r.probability for r in rows)
    assert abs(expected / sum(r.n_tokens for r in rows) - mixing.BUDGET) < 0.05
    got = mixing.mixture(hard(spark)).collect()
    assert len(got) == 8 and len({r.selected for r in got if r.doc_id == 1}) == 1
    assert mixing.mixture(hard(spark).limit(0)).count() == 0
    clash = docs.withColumns({"weight": F.lit("x"), "probability": F.lit(7), "topic": F.lit("own"), "selected": F.lit(1), "n_tokens": F.lit(None)})
    assert {(r.doc_id, r.probability) for r in mixing.mixture(clash).collect()} == {(r.doc_id, r.probability) for r in rows}
    assert {r.topic for r in mixing.mixture(clash, topics="topic").collect()} == {"own"}
    few = mixing.mixture(docs, max_categories=2)
    assert few.count() == 1000 and few.select("probability").distinct().count() > 1


def test_targets_that_cannot_be_met_are_told(spark):
    rows = [(k, "a b c d e f g", "en" if k % 10 else "de", "big" if k % 20 else "small") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    fair = {r.category: r for r in mixing.residuals(mixing.mixture(docs, budget=0.3, strict=True), budget=0.3).collect()}
    assert fair and all(abs(r.gap) < 1e-3 * r.asked for r in fair.values())
    targets = {"source": {"small": 0.9, "big": 0.05, "none": 0.05}}
    gaps = {r.category: r.gap for r in mixing.residuals(mixing.mixture(docs, targets=targets), targets=targets).collect() if r.margin == "source"}
    assert abs(gaps["none"] + 0.05 * mixing.BUDGET * 2800) < 1e-6 and gaps["small"] < -0.8 * mixing.BUDGET * 2800
    with pytest.raises(ValueError, match="cannot be met"):
        mixing.mixture(docs, targets=targets, strict=True)


def test_mixture_of_many_sources(spark, monkeypatch):
    rows = [(k, "a b c d e f g h", "en" if k % 3 else "de", f"host{k % 600}" if k % 2 else f"tail{k}") for k in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"tail0": 0.5, "tail2": 0.25, "host1": 0.25}}
    near = {r.doc_id: r for r in mixing.mixture(docs, budget=0.0005, targets=targets).collect()}
    assert near[0].probability > 0 and near[2].probability > 0 and near[1].probability > 0 and near[4].probability == 0
    even = mixing.mixture(docs).groupBy("source").agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("probability")).alias("p"))
    assert even.count() == 1200 and "(other)" not in {r.source for r in even.collect()}
    small = docs.filter("doc_id < 300")
    driver = {r.doc_id: r.probability for r in mixing.mixture(small).collect()}
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 3)
    table = {r.doc_id: r.probability for r in mixing.mixture(small).collect()}
    assert len(driver) == 300 and all(abs(table[k] - p) < 1e-6 for k, p in driver.items())


# -- 7 and 9


def held_out_accuracy(rows, label):
    right = [r.predicted == r[label] for r in rows if r.held_out]
    return sum(right) / len(right)


@pytest.mark.parametrize(("module", "label", "mod", "fold"), [(quality, "quality", 3, 1), (toxicity, "toxic", 4, 2)])
def test_classifiers_on_the_held_out_fold(spark, module, label, mod, fold):
    docs, known = documents(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = module.score_documents(docs.select("doc_id", "text"), known)
    rows = scored.join(known, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == fold) for r in rows)
    assert held_out_accuracy(rows, label) > 0.9
    flipped = known.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == fold, 1 - F.col(label)).otherwise(F.col(label)))
    again = {r.doc_id: r.score for r in module.score_documents(docs.select("doc_id", "text"), flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-12 for r in rows)  # held-out labels do not matter


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_on_hard_rows(spark, module):
    rows = module.score_documents(hard(spark), labels(spark)).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id == 1}) == 1
    assert module.score_documents(hard(spark).limit(0), labels(spark)).count() == 0
    assert len(module.score_documents(hard(spark), labels(spark).limit(0)).collect()) == 8


def test_folding_and_exceptions():
    s = toxicity.Scorer({"idiot": 3.0, "stup*": 2.0, "trash": 1.0}, ["trash can"], np.zeros(6))
    assert s.hits("You 1d10t! іdiot ＩＤＩＯＴ idiots") == [3.0, 3.0, 3.0]
    assert s.hits("stupidly so") == [2.0] and s.hits("a trash can") == [] and s.hits("trash") == [1.0] and s.hits("") == []


def test_marks_and_unseen_code_points_do_not_hide_words():
    s = toxicity.Scorer({"idiot": 3.0, "fix": 1.0}, ["class idiot"], np.zeros(6))
    for unseen in "\u200b\u00ad\u200c\u200d\u2060\ufeff\u0301\u034f\u180e\ufe0f\U000e0041":
        assert s.hits(f"you i{unseen}d{unseen}iot!") == [3.0] and s.hits(f"class{unseen} idi{unseen}ot") == []
    assert s.hits("ídiot ÍDIÖT ｉｄｉｏｔ іdіот") == [3.0] * 4 and s.hits("a ﬁx") == [1.0] and s.hits("xídiot ídiotx") == []
    assert toxicity.fold("Ёж 日本 한국 ²") == "eж 日本 한국 ²"
    for text in ("naïve ﬁancé\u0301 x", "İstanbul", "a\u200bb"):
        folded, raw = toxicity.aligned(text)
        assert len(folded) == len(raw) and folded == toxicity.fold(text)


def test_words_are_cut_before_they_are_folded():
    assert toxicity.words_in("idiot! 1999 1d10t, st$pid; st0p. іd­iot a@b") == {"idiot", "stspid", "stop", "aab"}


def test_hits_against_a_plain_search():
    rng = np.random.default_rng(3)
    lexicon, exceptions = {"ab": 2.0, "b*": 1.0, "abc": 3.0, "ca": 1.5}, ["ab ca", "b c b"]
    s = toxicity.Scorer(lexicon, exceptions, np.zeros(6))
    for _ in range(300):
        text = "".join(rng.choice(list("abc ! "), 24))
        folded = toxicity.fold(text)

        def places(entry, stem):
            for k in range(len(folded) - len(entry) + 1):
                if folded[k : k + len(entry)] == entry and not (k and text[k - 1].isalpha()):
                    if stem or not (k + len(entry) < len(text) and text[k + len(entry)].isalpha()):
                        yield k, k + len(entry)

        safe = [p for e in exceptions for p in places(e, False)]
        best = {}
        for word, weight in lexicon.items():
            for a, b in places(word.rstrip("*"), word.endswith("*")):
                if weight > best.get(a, (0, 0))[0]:
                    best[a] = (weight, b)
        want = sorted(w for a, (w, b) in best.items() if not any(x <= a and b <= y for x, y in safe))
        assert sorted(s.hits(text)) == want


def test_votes_of_the_nearest():
    rng = np.random.default_rng(0)
    rows = rng.random((60, quality.N_FEATURES)).astype(np.float32)
    rows[30:40] = rows[20:30]  # ties
    labels = np.arange(60) % 2
    model = quality.NeighbourModel(rows, labels, (30, 30))
    got = model.score(rows[:50])
    vectors = [v / np.linalg.norm(v) for v in (rows * model.idf) / np.linalg.norm(rows * model.idf, axis=1, keepdims=True) @ model.axes]
    for k in range(50):
        cosines = (np.array([vectors[k]]) @ np.array(vectors).T)[0].round(5)
        near = sorted(range(60), key=lambda j: (-cosines[j], j))[: quality.NEIGHBOURS]
        votes = np.maximum(cosines[near], 0) ** 8
        assert abs(got[k] - (votes * labels[near]).sum() / votes.sum()) < 0.03


def test_text_ids_score_alike(spark):
    docs, known = documents(spark), spark.read.parquet(f"{SMALL}/labels.parquet")
    as_text = lambda df: df.withColumn("doc_id", F.col("doc_id").cast("string"))
    for module in (quality, toxicity):
        a = {str(r.doc_id): r.score for r in module.score_documents(docs.select("doc_id", "text"), known).collect()}
        b = {r.doc_id: r.score for r in module.score_documents(as_text(docs.select("doc_id", "text")), as_text(known)).collect()}
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 0.2 for k in a)


def test_borders_are_those_of_the_original_text():
    s = toxicity.Scorer({"idiot": 3.0}, [], np.zeros(6))
    assert s.hits("so\u00adft: idiot! or idi\u00adot$ or 1d10t\u200b!") == [3.0, 3.0, 3.0]
    assert s.hits("\u0130 @idiot\u200b 4idiot") == [3.0, 3.0] and s.hits("idiot\u00ads \u0130idiot") == []


# -- 8


def test_line_dedup_against_brute_force(spark):
    rows = [(k, f"head\nown {k}\n\nhead\n mid \nfoot" if k % 2 else f"own {k}\nhead", "a" if k < 20 else None) for k in range(24)] + [(30, None, "a"), (31, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs, ratio=0.4, min_pages=3).collect()}
    held, total = collections.Counter(), collections.Counter(s for _, _, s in rows)
    for _, t, s in rows:
        for line in {x.strip(" ") for x in (t or "").split("\n")} - {""} if t is not None else ():
            held[s, line] += 1
    for i, t, s in rows:
        if t is None:
            assert got[i].text is None and got[i].n_lines == 0
            continue
        lines = t.split("\n")
        kept = [x for x in lines if not (held[s, x.strip(" ")] >= 3 and x.strip(" ") and held[s, x.strip(" ")] > 0.4 * total[s])]
        assert got[i].text == "\n".join(kept) and got[i].n_removed == len(lines) - len(kept)
    assert line_dedup.drop_boilerplate(hard(spark)).count() == 8 and line_dedup.drop_boilerplate(hard(spark).limit(0)).count() == 0


# -- 10


def brute_signature(text):
    k = order_minhash.K
    hashes = order_minhash.kmer_hashes(order_minhash.code_points(text)).tolist()
    assert len(hashes) == (max(1, len(text) - k + 1) if text else 0)
    return order_minhash.numbered(np.array(hashes, np.uint32))


def test_order_minhash_slots_against_brute_force():
    text = "the cat sat on the mat and the cat sat on the hat " * 4
    hashes = brute_signature(text)
    assert len(set(hashes.tolist())) == len(hashes)  # numbered k-mers differ
    slots = order_minhash.signature(text)
    for s in range(order_minhash.SLOTS):
        values = [(int(h) * int(order_minhash._MULTIPLIERS[s])) & 0xFFFFFFFF for h in hashes]
        chosen = sorted(sorted(range(len(values)), key=lambda i: (values[i], i))[: order_minhash.TUPLE])
        out = 0x345678
        for k, i in enumerate(chosen):
            out = ((out * 0x100000001B3) & (2**64 - 1)) ^ (int(hashes[i]) + k)
            out = ((out ^ (out >> 31)) * 0x94D049BB133111EB) & (2**64 - 1)
        assert slots[s] == (out >> 40) & 0xFFFF


def test_order_minhash_follows_edits_and_order():
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in rng.integers(0, 5000, 400)]
    text = " ".join(words)
    near = [order_minhash.likeness(order_minhash.signature(text), order_minhash.signature(" ".join(words[:-n] + ["q"] * n))) for n in (1, 40, 200)]
    assert near[0] > near[1] > near[2]
    halves = " ".join(words[200:] + words[:200])
    assert order_minhash.likeness(order_minhash.signature(text), order_minhash.signature(halves)) < 0.8


def test_neighbours(spark):
    rows = sorted(((r[0], r[1] or "") for r in hard_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for parts in (1, 5):
        got = order_minhash.fingerprint_neighbours(hard(spark).repartition(parts)).collect()
        assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(r[0]) for r in rows)
        want = collections.Counter()
        for k, (i, t) in enumerate(rows):
            nxt = rows[(k + 1) % len(rows)][1]
            e = order_minhash.edited(t, nxt)
            want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), order_minhash.fingerprint(order_minhash.signature(t)), order_minhash.fingerprint(order_minhash.signature(e))] += 1
        assert want == collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got)
    one = spark.createDataFrame([(1, "only text here")], "doc_id long, text string")
    assert order_minhash.fingerprint_neighbours(one).first().near_next == 1.0
    assert order_minhash.fingerprint_neighbours(one.limit(0)).count() == 0
