"""Streams whose every row is held against the batch form, and how much state and reading they need."""

import datetime as dt
import random

from pyspark.sql import functions as F

from pageloom.operators import sites
from pageloom.sources import io, tables
from pageloom.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def batches(spark, folder, *frames):
    """A stream with one frame a micro-batch."""
    for k, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(writer, at):
    q = writer.option("checkpointLocation", str(at)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return q


def test_state_of_recrawls_falls_after_its_life(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame([(k, T0 + dt.timedelta(seconds=s) if s is not None else None) for k, s in rows], "url_key string, ts timestamp")
    frames = [frame(*[(f"k{k}", k) for k in range(40)], (None, 3), ("k1", 30)), frame(("k1", 110), ("late", 5000)), frame(("k1", 5001), ("late", 5060)), frame(("late", 5119), ("late", 5120)), frame(("end", 20000)), frame(("end", 20001))]
    q = run(jobs.stream_recrawl_hits(batches(spark, str(tmp_path / "in"), *frames), delay="60 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")), tmp_path / "c")
    got = sorted((r.url_key or "", r.ts, r.hit) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    assert got == sorted((r.url_key or "", r.ts, r.hit) for r in jobs.suppress_recrawls(every).collect())
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(sizes) >= 40 and sizes[-1] <= 6


def test_first_seen_with_a_life(spark, tmp_path):
    frames = [spark.createDataFrame([(n, s, k) for n, (s, k) in enumerate(rows)], "id int, site string, url_key string") for rows in ([("a", "x"), ("a", "y"), ("b", "x")], [("a", "x"), ("b", "z"), ("b", "z"), (None, "x")], [(None, "x"), ("b", "y")])]
    for name, life in (("ever", None), ("hour", 3600)):
        out = str(tmp_path / name)
        run(jobs.stream_first_seen(batches(spark, out + "-in", *frames), life=life).writeStream.format("parquet").option("path", out), tmp_path / f"c-{name}")
        assert sorted((r.site or "", r.url_key) for r in spark.read.parquet(out).collect()) == [("", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("b", "z")]


def test_running_counts_equal_the_batch(spark, tmp_path):
    rng = random.Random(1)
    frames = [spark.createDataFrame([(f"s{rng.randrange(4)}", rng.choice(("home", "general"))) for _ in range(30)], "site string, page_type string") for _ in range(3)]
    run(jobs.stream_stats(batches(spark, str(tmp_path / "in"), *frames)).writeStream.format("memory").queryName("running").outputMode("complete"), tmp_path / "c")
    every = frames[0].unionByName(frames[1]).unionByName(frames[2])
    assert sorted(map(tuple, spark.table("running").collect())) == sorted(map(tuple, jobs.stream_stats(every).collect()))


def test_site_state_equals_the_batch_and_reads_no_history(spark, tmp_path):
    rng = random.Random(2)
    schema = "page_id long, site string, ord int, text string, selector string, keywords array<string>, action_type string"
    row = lambda k, site: (k, site, rng.randrange(9), rng.choice(("Go", "go", "Buy", "Call")) + str(rng.randrange(40)), "b", ["x"], "cta")
    frames = [spark.createDataFrame([row(100 * b + k, None if k == 0 else f"s{rng.randrange(3)}") for k in range(60)], schema) for b in range(6)]
    frames.append(spark.createDataFrame([row(0, "s9")], schema))
    folder = str(tmp_path / "state")
    run(jobs.stream_site_state(batches(spark, str(tmp_path / "in"), *frames), folder, sites.site_buttons, buckets=8), tmp_path / "c")
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    plain = lambda df: sorted((str(r.site), r.page_id, r.ord, r.key, r.text) for r in df.collect())
    assert plain(jobs.site_state(spark, folder)) == plain(sites.site_buttons(every))
    per_slot = {}
    for f in (tmp_path / "state" / "state").rglob("*.parquet"):
        per_slot.setdefault(f.parent, []).append(f)
    assert len(per_slot) <= 2 * 8 and all(len(fs) == 1 for fs in per_slot.values())  # two states at most, whatever the batches


def test_counts_of_a_batch_that_runs_again(spark, tmp_path):
    made = []

    class Writer:  # stands for the stream: hands out the function called with each batch
        def foreachBatch(self, each):
            made.append(each)

    class Rows:
        writeStream = Writer()

    counts = lambda d: d.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    sums = lambda d: d.groupBy("site").agg(F.sum("n").alias("n"))
    folder = str(tmp_path / "s")
    jobs.stream_site_state(Rows(), folder, sums, counts, buckets=4)
    each = made[0]
    first, second = (spark.createDataFrame([(s,) for s in rows], "site string") for rows in (["a", "a", "b"], ["a", "c", None]))
    for number, batch in ((0, first), (0, first), (1, second), (1, second), (2, first.limit(0)), (3, first), (3, first)):
        each(batch, number)
    assert {r.site: r.n for r in jobs.site_state(spark, folder).collect()} == {"a": 5, "b": 2, "c": 1, None: 1}


def test_pages_dealt_by_bytes(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, f"u{k}", "x" * min(200_000, int(300 * rng.paretovariate(0.8)))) for k in range(3000)] + [(None, None, None), (9, "u9", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(str(tmp_path / "p"))
    dealt = io.read_pages(spark, str(tmp_path / "p"), 8, balanced=True)
    sizes = [r.size for r in dealt.groupBy(F.spark_partition_id()).agg(F.sum(F.length("html")).alias("size")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.5 * sum(sizes) / 8
    assert sorted(map(str, dealt.collect())) == sorted(map(str, pages.collect()))
    assert tables.deal_by_bytes(pages.limit(0), "html", ("page_id",)).count() == 0
    assert tables.deal_by_bytes(pages, "html", ("page_id",), task_bytes=1 << 16).rdd.getNumPartitions() > 8


def test_payloads_and_results_of_files(spark, tmp_path):
    rows = [(1, 0, "https://a/x.json", "application/json", 9, '{"a": 1}'), (1, 1, None, None, None, None), (2, 0, "https://a/y", "text/html", 0, "")]
    want = spark.createDataFrame(rows, "page_id long, seq long, resp_url string, content_type string, content_length long, body string").withColumn("extra", F.lit(1))
    for kind in ("parquet", "json"):
        io.write_results(want, str(tmp_path / kind), kind=kind)
        got = io.read_payloads(spark, str(tmp_path / kind), kind)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_portfolio_of_many_pages_keeps_its_order(spark):
    docs = spark.range(20_000).select(
        F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("page_id"), F.lit("s").alias("site"), F.concat(F.lit("https://s/portfolio/p-"), "id").alias("url"), F.concat(F.lit("T"), "id").alias("title"),
        F.lit("general").alias("page_type"), F.lit("40 кв.м").alias("content"), F.lit(2).alias("word_count"), F.lit("ok").alias("status"), F.lit(False).alias("partial"),
    )
    got = sites.condense_portfolio(docs).collect()
    titles = [r.title for r in docs.orderBy("page_id").collect()]
    assert len(got) == 1 and got[0].content.split("\n")[1:] == [f"{t} — 40 кв.м." for t in titles]
    assert got[0].content.startswith("ПРОЕКТИ И ЗАВЪРШЕНИ ОБЕКТИ (20000 бр.):") and got[0].word_count == 4 * 20_000
