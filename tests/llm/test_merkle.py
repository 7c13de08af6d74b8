"""Hash trees against plain ones, and the audit of rows that were tampered with."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pageloom.llm import merkle, queries

SMALL = "/root/testdata/sf0.001"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, place):
    """(left, right) of every level but the last."""
    found = []
    for level in levels[:-1]:
        other = level[place ^ 1] if place ^ 1 < len(level) else ""
        found.append((other, "") if place & 1 else ("", other))
        place >>= 1
    return found


def plain(rows):
    """{doc_id: (subroot, root, path)} of (doc_id, lang, leaf) with ids of their own."""
    by_lang = {}
    for doc_id, lang, leaf in sorted(rows):
        by_lang.setdefault(lang, []).append((doc_id, leaf))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: tree([leaf for _, leaf in by_lang[lang]]) for lang in langs}
    top = tree([trees[lang][-1][0] for lang in langs])
    found = {}
    for at, lang in enumerate(langs):
        above = siblings(top, at)
        for place, (doc_id, _) in enumerate(by_lang[lang]):
            found[doc_id] = trees[lang][-1][0], top[-1][0], siblings(trees[lang], place) + above
    return found


@pytest.mark.parametrize("sizes", [{None: 1}, {"a": 1, "b": 1}, {"a": 5, None: 3, "é": 1, "z": 2}, {"a": 700, "b": 257, "c": 256, None: 1, "d": 255, "e": 513}])
def test_proofs_against_plain_trees(spark, sizes):
    rows, k = [], 0
    for lang, n in sizes.items():
        rows += [(k + i, lang, digest(str(k + i))) for i in range(n)]
        k += n
    random.Random(1).shuffle(rows)
    claimed = F.when(F.col("doc_id") % 5 == 0, F.sha2(F.lit("forged"), 256))
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string").withColumn("claimed", claimed)
    want, got = plain(rows), merkle.audit(df, "lang", "doc_id").collect()
    assert len(got) == len(rows)
    for r in got:
        subroot, root, path = want[r.doc_id]
        assert (r.subroot, r.root, [tuple(x) for x in r.path]) == (subroot, root, path)
        assert r.proof == "".join(a + b for a, b in path)
        at = r.claimed or r.leaf
        for left, right in path:
            at = digest(left, at, right)
        assert r.folded_root == at and r.verified == (r.claimed is None)


def test_three_steps_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    rows = [(k, "x" if k % 3 else f"l{k % 7}", digest(str(k))) for k in range(131)]
    want = plain(rows)
    for r in merkle.proofs(spark.createDataFrame(rows, "doc_id long, lang string, leaf string"), "lang", "doc_id").collect():
        assert (r.subroot, r.root, [tuple(x) for x in r.path]) == want[r.doc_id]


def test_repeated_and_null_ids_clashing_names_and_empty_tables(spark):
    rows = [(1, "a", digest("x")), (1, "a", digest("x")), (1, "a", digest("y")), (None, "a", digest("z"))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string").selectExpr("*", "1 AS path", "2 AS root", "3 AS place", "4 AS _tree", "5 AS row")
    got = merkle.proofs(df, "lang", "doc_id").collect()
    levels = tree([digest("z"), *sorted([digest("x"), digest("x"), digest("y")])])
    assert len(got) == 4 and {r.root for r in got} == {levels[-1][0]} and {r.row for r in got} == {5}
    assert sorted(str([tuple(x) for x in r.path]) for r in got) == sorted(str(siblings(levels, k)) for k in range(4))
    assert merkle.proofs(df.filter("doc_id = 9"), "lang", "doc_id").count() == 0


def test_leaves_of_nulls_and_signs(spark):
    rows = [(1, None), (2, ""), (3, "é:日"), (None, "-")]
    got = {r.a: r.h for r in spark.createDataFrame(rows, "a long, b string").select("a", merkle.leaf_digest([F.col("a"), F.col("b")]).alias("h")).collect()}
    assert got == {1: digest("1:1-"), 2: digest("1:20:"), 3: digest("1:36:é:日"), None: digest("-1:-")}


def test_query_against_plain_trees(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()

    def leaf(r, more=0):
        values = (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text)
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    want, by_id = plain([(r.doc_id, r.lang, leaf(r)) for r in docs]), {r.doc_id: r for r in docs}
    got = queries.QUERIES["op12_merkle_manifest"](spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        subroot, root, path = want[r.doc_id]
        at = leaf(by_id[r.doc_id], int(zlib.crc32(str(r.doc_id).encode()) % 7 == 0))
        for left, right in path:
            at = digest(left, at, right)
        assert (r.leaf, r.subroot, r.root, r.folded_root, r.verified) == (leaf(by_id[r.doc_id]), subroot, root, at, at == root)
        assert r.proof_sha256 == digest(*(a + b for a, b in path))
    assert 0 < sum(not r.verified for r in got) < len(got) / 3
