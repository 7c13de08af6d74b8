"""Sources and sinks: pages, requests, payloads, results and site maps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pageloom.functions import urls
from pageloom.sources.tables import deal_by_bytes, spread

#: Folders of a saved site map.
SITE_BUCKETS = 64


def read_pages(spark: SparkSession, path: str, partitions: int | None = None, balanced: bool = False) -> DataFrame:
    """page_id, url, html[, final_url]; dealt out by page_id if ``partitions`` are named, else only where the scan leaves cores idle.

    ``balanced`` deals pages by their bytes, so that a few very long pages do not make one long task (``deal_by_bytes``).
    """
    pages = spark.read.parquet(path)
    columns = [c for c in ("page_id", "url", "html", "final_url") if c in pages.columns]
    pages = pages.select(*columns)
    if balanced:
        return deal_by_bytes(pages, "html", ("page_id", "url"), partitions)
    return pages.repartition(partitions, "page_id") if partitions else spread(pages)


def split_requests(raw: DataFrame) -> DataFrame:
    """(value, url, site_id, deadline_ms, reason) of JSON request lines; reason is null for good ones."""
    parsed = raw.withColumn("v", F.try_parse_json("value"))
    kind = F.schema_of_variant("v")
    url = F.expr("try_variant_get(v, '$.url', 'string')")
    reason = F.when(F.col("v").isNull(), "not_json").when(~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), "not_an_object").when(F.coalesce(url, F.lit("")) == "", "no_url")
    return parsed.select(
        "value", F.when(reason.isNull(), urls.normalize_url(url)).alias("url"), F.when(reason.isNull(), F.expr("try_variant_get(v, '$.site_id', 'string')")).alias("site_id"),
        F.when(reason.isNull(), F.expr("try_variant_get(v, '$.deadline_ms', 'bigint')")).alias("deadline_ms"), reason.alias("reason"),
    )


def read_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) requests of a text file of JSON lines."""
    rows = split_requests(spark.read.text(path))
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL").select("value", "reason")


def read_payloads(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """page_id, seq, resp_url, content_type, content_length, body."""
    return spark.read.format(kind).load(path).select("page_id", "seq", "resp_url", "content_type", "content_length", "body")


def write_results(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Gzipped JSON lines or Parquet."""
    writer = df.write.mode(mode)
    if kind == "json":
        writer.option("compression", "gzip").json(path)
    else:
        writer.format(kind).save(path)


def upsert_site_map(old: DataFrame, new: DataFrame, key: str = "site_id", at: str = "updated_at") -> DataFrame:
    """The latest row of each key of both tables; of equal times, the new table's."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = both.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*old.columns), F.struct(at, "_new")).alias("_row"))
    return latest.select("_row.*")


def read_site_map(spark: SparkSession, path: str) -> DataFrame | None:
    """The saved site map; None where there is none yet."""
    try:
        return spark.read.parquet(path).drop("bucket")
    except AnalysisException as found:
        if found.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def save_site_map(new: DataFrame, path: str, key: str = "site_id", at: str = "updated_at", buckets: int = SITE_BUCKETS) -> None:
    """Upsert ``new`` into the site map at ``path``, a Parquet table partitioned by bucket of ``key``.

    Only the buckets of the sites in ``new`` are read and overwritten, so a few sites cost their buckets and not the
    table; files of other buckets stay. The merged rows are written to the shared folder first, as a table can't be
    overwritten while it is read. Run again with the same rows, or after a failure, it gives the same table. ``buckets`` must stay
    the same for a table; rows of equal key and time are those of ``new``; an empty ``new`` changes nothing.
    """
    spark = new.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    touched = [r[0] for r in new.select(bucket).distinct().collect()]  # ``buckets`` at most
    if not touched:
        return
    old = read_site_map(spark, path)
    before = new.limit(0) if old is None else spark.read.parquet(path).filter(F.col("bucket").isin(touched)).drop("bucket")
    merged = upsert_site_map(before.select(*new.columns), new, key, at).withColumn("bucket", bucket)
    staged = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/site-map-{uuid.uuid4().hex}"
    merged.write.parquet(staged)
    rows = spark.read.schema(merged.schema).parquet(staged)
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
