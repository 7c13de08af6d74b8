"""Structured Streaming forms of the page jobs, and recrawl suppression in batch and stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


TTL_SECONDS = 120
SPAN_SECONDS = 1200
SITE_BUCKETS = 64
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def suppress_recrawls(requests: DataFrame, key: str = "url_key", at: str = "ts", ttl: int = TTL_SECONDS, span: int = SPAN_SECONDS, ties: tuple[str, ...] = ()) -> DataFrame:
    """``requests`` with ``hit``: does the answer of the last crawl of the key still hold?

    A hit does not extend the life: the anchor is the last request that was crawled. Time is cut into spans, so that
    a frequent key is not one task's work: of every key and span it is found how the life of the answer at its end
    follows from that at its beginning (``_paths``), these are chained by key (``_entries``), and each span is
    then marked from its beginning (``_marks``). All three read sorted rows one by one and hold no group.
    Null keys or times are never hits; of requests at one time the first by ``ties`` comes first.
    """
    life, width = ttl * 1_000_000, max(span, ttl) * 1_000_000
    kind = requests.schema[key].dataType.simpleString()
    usable = F.col(key).isNotNull() & F.col(at).isNotNull()
    rows = requests.filter(usable).withColumn("_t", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("_span", F.floor(F.col("_t") / width))

    times = rows.select(F.col(key).alias("_key"), "_span", "_t").repartition("_key", "_span").sortWithinPartitions("_key", "_span", "_t")
    paths = times.mapInArrow(_paths(life, width), f"_key {kind}, _span long, upto long, until long")
    paths = paths.repartition("_key").sortWithinPartitions("_key", "_span", "upto")
    entries = paths.mapInArrow(_entries, f"_key {kind}, _span long, _until long")

    marked = rows.unionByName(entries.withColumnRenamed("_key", key).withColumn("_t", F.lit(-(1 << 62))), allowMissingColumns=True)
    marked = marked.repartition(key, "_span").sortWithinPartitions(key, "_span", "_t", *ties)
    schema = requests.select("*", F.lit(False).alias("hit")).schema
    rest = requests.filter(~usable).withColumn("hit", F.lit(False))
    return marked.mapInArrow(_marks(key, life, requests.columns), schema).unionByName(rest)


def _paths(life: int, width: int):
    """(key, span, upto, until) of every key and span: an answer that holds until ``upto`` or less, but more than the one before, leads to one that holds ``until`` when the span ends."""

    def work(batches):
        import pyarrow as pa
        from collections import deque

        own, live, last = None, deque(), None  # live: (all ``upto`` of a path, until), in the order of their ends

        def ended():
            found = sorted((u, until) for uptos, until in live for u in uptos)
            return [(*own, u, until) for k, (u, until) in enumerate(found) if k + 1 == len(found) or found[k + 1][1] != until]

        def batch_of(out):
            columns = list(zip(*out)) if out else [[], [], [], []]
            return pa.record_batch([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["_key", "_span", "upto", "until"])

        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for k, span, t in zip(*[c.to_pylist() for c in batch.columns]):
                if (k, span) != own:
                    out += ended()
                    own, last, first = (k, span), None, span * width + life
                    live.clear()
                if t == last:
                    continue
                # a path may start here as long as an answer from before the span may hold until now
                joined = [t] if last is None or last < first else []
                while live and live[0][1] <= t:
                    joined += live.popleft()[0]
                if joined:
                    live.append((joined, t + life))
                last = t
            yield batch_of(out)
        if own is not None:
            yield batch_of(ended())

    return work


def _entries(batches):
    """(key, span, until): until when the answer from before each span holds."""
    import pyarrow as pa

    own, key, now, after = None, None, None, None
    for batch in batches:
        out = []
        for k, span, upto, until in zip(*[c.to_pylist() for c in batch.columns]):
            if (k, span) != own:
                if key is None or k != key[0]:
                    now = None
                elif after is not None:
                    now = after
                own, key, after = (k, span), (k,), None
                out.append((k, span, now))
            if after is None and (now is None or now <= upto):
                after = until
        columns = list(zip(*out)) if out else [[], [], []]
        yield pa.record_batch([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["_key", "_span", "_until"])


def _marks(key: str, life: int, names: list[str]):
    """The requests of each key and span with ``hit``; the first row of a span says until when the answer from before it holds."""

    def work(batches):
        import pyarrow as pa

        until = None
        for batch in batches:
            hits, kept = [], []
            for t, entry in zip(batch.column("_t").to_pylist(), batch.column("_until").to_pylist()):
                if t == -(1 << 62):
                    until = entry
                    kept.append(False)
                    continue
                kept.append(True)
                hits.append(until is not None and t < until)
                until = until if hits[-1] else t + life
            rows = batch.select(names).filter(pa.array(kept, pa.bool_()))
            yield pa.record_batch([*rows.columns, pa.array(hits, pa.bool_())], names=[*names, "hit"])

    return work


def stream_suppress_recrawls(requests: DataFrame, key: str = "url_key", at: str = "ts", ttl: int = TTL_SECONDS) -> DataFrame:
    """The crawled requests of a stream: repeats of a key within the ttl are dropped; later than the watermark, too."""
    return requests.withWatermark(at, f"{ttl} seconds").dropDuplicatesWithinWatermark([key])


def _state_store(spark) -> None:
    """Processors with timers and several states need a RocksDB state store; a session's own choice of another one is an error."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name).rsplit(".", 1)[-1] == "HDFSBackedStateStoreProvider":
        raise ValueError(f"set {name} to {ROCKSDB}")


def stream_recrawl_hits(requests: DataFrame, key: str = "url_key", at: str = "ts", ttl: int = TTL_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """The requests of a stream with ``hit``, by the rule of ``suppress_recrawls``: a hit does not extend the life.

    The state of a key is the time of its last crawl; a timer removes it when the watermark has passed its life, so the
    state holds only keys crawled of late. Requests of a micro-batch are taken in time order, those of a later one after
    them; a request older than the last crawl is answered from it. Null keys and times are never hits; requests later
    than the watermark are dropped. What one task holds of a key is bounded by the size that the source gives to a
    micro-batch. The session must name the RocksDB state store (``ROCKSDB``).
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    _state_store(requests.sparkSession)
    # plain names, and the row as one value: the state runner renames columns that begin with a sign and makes floats of columns with nulls
    timed = requests.withWatermark(at, delay)
    usable = F.col(key).isNotNull() & F.col(at).isNotNull()
    timed = timed.select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(at).cast("timestamp").cast("double").alias("t"), usable.alias("usable"), F.struct(*requests.columns).alias("row"))
    schema = timed.select("row", F.lit(False).alias("hit")).schema

    class LastCrawl(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.anchor = handle.getValueState("anchor", "at double")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            pdf = pd.concat(list(rows)).sort_values("t", kind="stable")
            before = anchor = self.anchor.get()[0] if self.anchor.exists() else None
            hits = []
            for t, usable in zip(pdf["t"], pdf["usable"]):
                fresh = not usable or anchor is None or t - anchor >= ttl
                anchor = t if fresh and usable else anchor
                hits.append(not fresh)
            if anchor != before:
                if before is not None:
                    self.handle.deleteTimer(int((before + ttl) * 1000))
                self.anchor.update((float(anchor),))
                self.handle.registerTimer(max(int((anchor + ttl) * 1000), timerValues.getCurrentWatermarkInMs() + 1))
            yield pdf.assign(hit=hits)[["row", "hit"]]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.anchor.clear()  # a later crawl takes the timer of the one before away, so this one is the last crawl's
            return iter(())

        def close(self):
            pass

    return timed.groupBy("key").transformWithStateInPandas(LastCrawl(), schema, "Append", "EventTime").select("row.*", "hit")


def stream_first_seen(links: DataFrame, keys: tuple[str, ...] = ("site", "url_key"), at: str | None = None, delay: str | None = None, life: int | None = None) -> DataFrame:
    """Each key of a stream once. State never expires, unless a time column and delay bound it by the watermark, or ``life`` by seconds since the key was seen first (state with a time to live; a key that comes after it counts as new; RocksDB needed)."""
    if life is not None:
        return _first_seen_for(links, keys, life)
    if at and delay:
        return links.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))
    return links.dropDuplicates(list(keys))


def _first_seen_for(links: DataFrame, keys: tuple[str, ...], life: int) -> DataFrame:
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    _state_store(links.sparkSession)

    class Seen(StatefulProcessor):
        def init(self, handle):
            self.seen = handle.getValueState("seen", "yes boolean", life * 1000)

        def handleInputRows(self, key, rows, timerValues):
            first = next(rows)[["row"]].head(1)
            for _ in rows:
                pass
            if self.seen.exists():
                first = first.head(0)
            else:
                self.seen.update((True,))
            yield first

        def close(self):
            pass

    named = [F.col(k).alias(f"k{n}") for n, k in enumerate(keys)]
    rows = links.select(*named, F.struct(*links.columns).alias("row"))
    return rows.groupBy(*[f"k{n}" for n in range(len(keys))]).transformWithStateInPandas(Seen(), rows.select("row").schema, "Append", "ProcessingTime").select("row.*")


def stream_page_docs(pages: DataFrame) -> DataFrame:
    """Page rows of a stream of pages; stateless."""
    from pageloom.operators import content, dom

    return content.page_docs(dom.parse_pages(pages))


def stream_stats(docs: DataFrame) -> DataFrame:
    """Running page counts by site and type."""
    return docs.groupBy("site", "page_type").agg(F.count(F.lit(1)).alias("n_pages"))


def stream_site_snapshot(docs: DataFrame, folder: str, roll_up: Callable[[DataFrame], DataFrame]):
    """A stream writer that appends each batch of rows and rolls up the sites it touches.

    Rows go to ``folder``/rows by batch and bucket of sites, and only the buckets of the touched sites are read again;
    their roll-up over all rows goes to ``folder``/snapshots/batch=n. A batch that runs again overwrites its own output.
    For roll-ups that can't be merged; ``stream_site_state`` keeps one that can, without reading history.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("site"), F.lit(SITE_BUCKETS)).cast("int")
        batch.withColumns({"batch": F.lit(number), "bucket": bucket}).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/rows/b={number}")
        touched = batch.select("site").distinct()
        buckets = [r[0] for r in touched.select(bucket).distinct().collect()]  # SITE_BUCKETS at most
        rows = spark.read.parquet(f"{folder}/rows").filter((F.col("batch") <= number) & F.col("bucket").isin(buckets))
        roll_up(rows.join(touched, "site", "left_semi").drop("batch", "b", "bucket")).write.mode("overwrite").parquet(f"{folder}/snapshots/batch={number}")

    return docs.writeStream.foreachBatch(each)


def stream_site_state(rows: DataFrame, folder: str, merge: Callable[[DataFrame], DataFrame], partial: Callable[[DataFrame], DataFrame] | None = None, buckets: int = SITE_BUCKETS):
    """A stream writer that keeps a mergeable roll-up by ``site`` and reads no history: a batch costs its own rows and the states of the buckets it touches.

    ``partial`` makes state rows of a batch's rows (``merge`` where none is named), ``merge`` makes state rows of state rows
    of the same columns, e.g. ``sites.site_buttons`` or sums of counts; it must work site by site, take its own
    result and never leave a site without rows. Each bucket of sites has two slots; a batch
    reads the newer one from before it and overwrites the other, so storage is two states at most, nothing is listed or
    deleted, and a batch that runs again starts from the same state: counts are right after a failure, too. Null
    sites are a site; an empty batch changes nothing. ``site_state`` reads the result.
    """
    partial = partial or merge
    place = F.pmod(F.xxhash64("site"), F.lit(buckets)).cast("int")

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        made = partial(batch).persist(StorageLevel.MEMORY_AND_DISK)
        touched = [r[0] for r in made.select(place).distinct().collect()]  # ``buckets`` at most
        if touched:
            saved = _slots(spark, folder)
            states, newest = (None, {}) if saved is None else _newest(saved.filter(F.col("bucket").isin(touched) & (F.col("_batch") < number)))
            both = made if states is None else states.select(*made.columns).unionByName(made)
            slot = F.create_map(*[F.lit(x) for b in touched for x in (b, 1 - newest.get(b, 1))])
            out = merge(both).withColumns({"_batch": F.lit(number).cast("long"), "bucket": place}).withColumn("slot", F.element_at(slot, F.col("bucket")))
            out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot", "bucket").parquet(f"{folder}/state")
        made.unpersist()

    return rows.writeStream.foreachBatch(each)


def _slots(spark, folder: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{folder}/state")
    except AnalysisException as found:
        if found.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _newest(saved: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """The rows of each bucket's newest slot, and which slot that is; two numbers a bucket come to the driver."""
    last = saved.groupBy("bucket").agg(F.max_by("slot", "_batch").alias("slot")).collect()
    slots = {r["bucket"]: r["slot"] for r in last}
    keep = [F.struct(F.lit(s).alias("slot"), F.lit(b).alias("bucket")) for b, s in slots.items()]
    return (saved.filter(F.struct("slot", "bucket").isin(*keep)) if keep else saved.limit(0)), slots


def site_state(spark, folder: str) -> DataFrame:
    """The roll-up that ``stream_site_state`` keeps in ``folder``, after its last batch."""
    rows, _ = _newest(spark.read.parquet(f"{folder}/state"))
    return rows.drop("_batch", "slot", "bucket")


def latest_snapshot(spark, folder: str) -> DataFrame:
    """The newest row of each site over all snapshots."""
    every = spark.read.parquet(f"{folder}/snapshots")
    names = [c for c in every.columns if c != "batch"]
    return every.groupBy(F.col("site").alias("_site")).agg(F.max_by(F.struct(*names), "batch").alias("_row")).select("_row.*")


def requests_of_events(events: DataFrame, key: str = "event_type") -> DataFrame:
    """The events table as requests: (event_id, url_key, ts)."""
    return events.select("event_id", F.lower(F.col(key)).alias("url_key"), "ts")


__all__ = [
    "ROCKSDB", "TTL_SECONDS", "latest_snapshot", "requests_of_events", "site_state", "stream_first_seen", "stream_recrawl_hits", "stream_page_docs", "stream_site_snapshot", "stream_site_state", "stream_stats", "stream_suppress_recrawls", "suppress_recrawls",
]
