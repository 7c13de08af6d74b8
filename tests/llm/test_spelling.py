"""Spelling variants against every pair, and the words of the contract against a plain count."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pageloom.llm import queries, spelling

SMALL = "/root/testdata/sf0.001"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_forms(words, ratio=5):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    forms = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None
    rows = {}
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows[w] = (forms[w], root, n, len(near[w]), words[forms[w]] if forms[w] else None)
    return rows


def collected(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def some_words(seed, letters="abé🙂", count=300, longest=9):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(2, longest))): int(5 * rng.paretovariate(0.5)) for _ in range(count)}


@pytest.mark.parametrize("crowd", [3, 500])
def test_forms_against_every_pair(spark, monkeypatch, crowd):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    words = some_words(1) | {"chain" + "x" * k: 6**k for k in range(12)}
    got = spelling.spelling_forms(spark.createDataFrame([*words.items()], "word string, n long"))
    assert collected(got) == plain_forms(words)
    assert plain_forms(words)["chain"][1] == "chain" + "x" * 11


def test_pairs_come_once(spark):
    words = some_words(2, "ab", 150, 7) | {"abcba": 1, "abxba": 2, "aabba": 3}  # an edit in the middle leaves both chunks
    pairs = spelling.near_pairs(spark.createDataFrame([*words.items()], "word string, n long")).collect()
    got = collections.Counter(frozenset((r.word, r.other)) for r in pairs)
    assert set(got.values()) == {1}
    assert set(got) == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}
    assert all((r.n, r.other_n) == (words[r.word], words[r.other]) for r in pairs)


def test_a_crowd_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CROWD", 20)
    words = {f"prefix{k:04d}"[:10]: k + 1 for k in range(400)}
    assert collected(spelling.spelling_forms(spark.createDataFrame([*words.items()], "word string, n long"))) == plain_forms(words)


def test_spelt_words_against_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(k if k % 9 else None, " ".join(rng.choice(("Lettér", "ÉCOLEs", "x×y÷zabc", "abc", "under_score", "sevenAB", "日本ascii")) for _ in range(60))) for k in range(40)] + [(77, None), (78, ""), (79, "q" * 30_000)]
    want = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                want[run] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash"))
    assert {r.word: r.n for r in spelling.count_words(spelling.spelt_words(df), least=1).collect()} == want
    assert any(len(w) == 6 for w in want) and not want["abc"]


def test_null_words_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([("abcdef", 50), ("abcdeg", 5), (None, 7), ("a", 9), ("b", 90)], "word string, n long").selectExpr("*", "1 AS form", "2 AS root", "3 AS gram")
    got = collected(spelling.spelling_forms(df))
    assert got == {"abcdef": (None, "abcdef", 50, 1, None), "abcdeg": ("abcdef", "abcdef", 5, 1, 50), "a": (None, "a", 9, 0, None), "b": (None, "b", 90, 0, None)}
    assert spelling.spelling_forms(df.filter("n > 1000")).count() == 0
    with pytest.raises(ValueError, match="twice"):
        spelling.spelling_forms(df, ratio=1)


def test_query_against_every_pair(spark):
    words = collections.Counter()
    for doc_id, text in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            words[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}
    assert collected(queries.QUERIES["op11_spelling_variants"](spark, SMALL)) == plain_forms(words)
