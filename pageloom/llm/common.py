"""What the corpus operators share: input columns, shared-folder tables, row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the ``documents`` table.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share; one is chosen only where the session names none (tests)."""
    chosen = spark.conf.get("spark.checkpoint.dir", None)
    if not chosen:
        chosen = spark.conf.get("spark.pageloom.test.checkpoint.dir", None)
        if not chosen:
            chosen = tempfile.mkdtemp(prefix="spark-")
            spark.conf.set("spark.pageloom.test.checkpoint.dir", chosen)
    return chosen.rstrip("/")


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage at a copy that outlives any executor. The reread
    carries the written schema, so an empty table is read back as empty.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*columns: str) -> Column:
    """A 128-bit key of the values of a row: equal rows share it, nulls differ from empties."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts)))


def text_bytes(column):
    """UTF-8 bytes and the n + 1 offsets of an Arrow string column; a null has no bytes."""
    import numpy as np
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def labelled_ids(labels: DataFrame, label: str, held_out: Column, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled ids of either class, never a held-out one: (doc_id, label).

    The bound is the documented parameter of the classifiers; ids are taken by
    the hash of their value, so the choice does not depend on the row order.
    """
    usable = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    parts = [
        usable.filter(F.col("label") == c).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(per_class)
        for c in (0, 1)
    ]
    return parts[0].unionAll(parts[1])


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
