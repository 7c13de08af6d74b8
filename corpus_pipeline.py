"""The corpus pipeline: stages in order, each written as Parquet and reread as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import decontamination, line_dedup, mixing, near_dedup, quality
from pageloom.llm.common import DOCUMENT_COLUMNS, checkpoint_dir
from pageloom.sources.tables import read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = quality.score_documents(docs.select(*DOCUMENT_COLUMNS), read_table(spark, sf_dir, "labels"))
    return scored.filter(F.col("predicted") == 1).select(*DOCUMENT_COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their host's boilerplate lines; n_chars follows the text."""
    cut = line_dedup.drop_boilerplate(docs.select(*DOCUMENT_COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dedup.drop_near_copies(docs.select(*DOCUMENT_COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_contaminated(docs.select(*DOCUMENT_COLUMNS), read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn documents with their weights."""
    drawn = mixing.mixture(docs.select(*DOCUMENT_COLUMNS))
    return drawn.filter("selected").select(*DOCUMENT_COLUMNS, "topic", "n_tokens", "weight", "probability")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: The classifier, the weighted sampling of near-dedup and the raking have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each result is a table in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return kept
        path = f"{checkpoint_dir(spark)}/pipeline-{k}-{uuid.uuid4().hex}"
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return docs
