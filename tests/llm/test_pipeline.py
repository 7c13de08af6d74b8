"""The pipeline's stages take effect, and keep clean documents."""

from pyspark.sql import functions as F

import corpus_pipeline
from pageloom.llm.common import DOCUMENT_COLUMNS

SF = "/root/testdata/sf0.01"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = spark.read.parquet(f"{SF}/labels.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    before = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SF).cache()
        n, m = before.count(), after.count()
        assert 0 < m <= n and (k == 1) == (m == n)
        if k < 4:
            assert tuple(after.columns) == DOCUMENT_COLUMNS
        if k == 0:
            kept = after.join(known, "doc_id").groupBy().agg(F.avg("quality")).first()[0]
            good = before.join(known.filter("quality = 1"), "doc_id").count()
            assert kept > 0.97 and after.join(known.filter("quality = 1"), "doc_id").count() > 0.95 * good
        if k == 2:
            assert after.select("text").distinct().count() == m
        if k == 3:
            bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            left = [r.text for r in after.select("text").collect()]
            assert not any(b in t for b in bench for t in left)
        before = after


def test_stages_on_nulls_and_nothing(spark):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (None, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= 4
        assert stage(spark, docs.limit(0), SF).count() == 0
