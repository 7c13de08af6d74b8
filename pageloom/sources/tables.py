"""Readers for the columnar tables the jobs start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a task where none are named; buckets dealt to each task; most tasks of one deal.
TASK_BYTES = 32 << 20
BUCKETS_A_TASK = 16
MOST_TASKS = 1 << 14


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a dataset directory (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt over all cores where it makes fewer partitions, as a small table in one row group does.

    Costly work per row follows. A scan that fills the cores stays as it is, so large tables are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def deal_by_bytes(df: DataFrame, column: str, keys: tuple[str, ...], partitions: int | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``df`` dealt to tasks of about equal bytes of ``column``, whatever the tail of its lengths.

    Rows fall into 16 buckets a task by the hash of ``keys``; the bytes of each bucket are summed in Spark, the sums
    (16 x 16,384 numbers at most, whatever the table) are dealt on the driver, largest first, each to the lightest task, and
    the rows then go to the task of their bucket. The largest task holds no more than the mean and one bucket. Only
    lengths are read in the first pass. Rows of equal keys stay together; a null length counts as none, and every row
    counts 64 bytes besides, so that empty texts are dealt too. Without ``partitions`` there are as many tasks as
    ``task_bytes`` asks for, but no fewer than the cores. An empty table gives an empty one.
    """
    import heapq

    spark = df.sparkSession
    weight = F.coalesce(F.octet_length(column), F.lit(0)) + F.lit(64)
    if partitions is None:
        whole = df.agg(F.sum(weight.cast("long"))).first()[0] or 0
        partitions = max(spark.sparkContext.defaultParallelism, -(-whole // task_bytes))
    partitions = max(1, min(partitions, MOST_TASKS))
    buckets = partitions * BUCKETS_A_TASK
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    sums = df.groupBy(bucket.alias("bucket")).agg(F.sum(weight.cast("long")).alias("size")).collect()  # ``buckets`` numbers at most
    tasks, place = [(0, k) for k in range(partitions)], [k % partitions for k in range(buckets)]
    for row in sorted(sums, key=lambda r: (-r["size"], r["bucket"])):
        load, k = tasks[0]
        place[row["bucket"]] = k
        heapq.heapreplace(tasks, (load + row["size"], k))
    packed = F.unhex(F.lit("".join(f"{k:04x}" for k in place)))  # two bytes a bucket
    task = F.conv(F.hex(F.substring(packed, bucket * 2 + 1, F.lit(2))), 16, 10).cast("int")
    return df.repartitionById(partitions, task)
