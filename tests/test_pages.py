"""Parsing, extraction, roll-ups, frontier, requests and streaming over small pages."""

import collections
import datetime as dt
import random

from pyspark.sql import functions as F

from pageloom.functions import text
from pageloom.operators import content, dom, forms, frontier, links, offers, sites
from pageloom.plans import registry
from pageloom.sources import io, tables
from pageloom.sources.tables import read_table
from pageloom.streaming import jobs

HTML = """<title>A &amp; B</title><body><header><nav class="menu"><a href="/about">About</a></nav></header><h1>Head one</h1><p>Para <b>one</p>
<ul class="feature-list"><li><svg class="lucide lucide-check"></svg>Wifi inside<li><img src="x.png" alt="not included">Parking lot</ul>
<details><summary>More info</summary><div>Hidden words</div></details><div data-href="/shop/thing-12345">x</div><div hidden>Secret words here</div>
<table><tr><td>k<td>v<tr><td>k2<td>v2</table><script>var t="</p>";</script><footer>Write to a@b.co or +359 88 123 456</footer>"""


def parsed(spark, *htmls):
    return dom.parse_pages(spark.createDataFrame([(k, f"https://www.a.com/p{k}", h) for k, h in enumerate(htmls)], "page_id long, url string, html string"))


def test_parser():
    title, text, nodes, failed = dom.parse(HTML)
    assert title == "A & B" and not failed and "Secret words" in text and "var t" not in text
    by_tag = {}
    for n in nodes:
        by_tag.setdefault(n["tag"], []).append(n)
    assert len(by_tag["li"]) == 2 and len(by_tag["tr"]) == 2 and len(by_tag["td"]) == 4
    assert all(n["pid"] == by_tag["ul"][0]["nid"] for n in by_tag["li"])
    assert [n["nth"] for n in by_tag["li"]] == [1, 2]
    for n in nodes:
        assert n["last"] >= n["nid"] and n["t0"] <= n["t1"] <= len(text)
    assert dom.parse(None)[3] and dom.parse("")[2] == []


def test_content(spark):
    pages = parsed(spark, HTML, None, "").cache()
    got = {(r.heading, r.text) for r in content.extract_sections(pages).collect()}
    assert ("Head one", "Para one ✓ Wifi inside ✗ Parking lot") in got
    rows = {r.page_id: r for r in content.page_docs(pages, keep_all=True).collect()}
    assert rows[0].content.startswith("DETAILS_CONTENT\nMore info\nHidden words") and not rows[0].partial and rows[1].partial
    assert content.page_docs(parsed(spark, "<p>" + "w " * 19 + "</p>", "<h1>heading</h1><p>" + "w " * 19 + "</p>")).count() == 1
    c = {r.page_id: r for r in content.page_contacts(pages).collect()}
    assert c[0].emails == ["a@b.co"] and c[0].phones == ["+35988123456"] and c[1].emails == []


def test_links(spark):
    pages = parsed(spark, HTML).cache()
    assert [r.dst_url for r in links.extract_links(pages).collect()] == ["https://www.a.com/about"]
    assert links.extract_nav_links(pages).count() == 1
    assert {r.dst_url for r in links.page_links(pages).collect()} == {"https://www.a.com/about", "https://www.a.com/shop/thing-12345"}
    assert not links.listing_flags(pages).first().is_listing
    assert links.listing_flags(parsed(spark, "<article>a</article>" * 3)).first().is_listing


def test_pages_are_parsed_once(spark):
    for name in ("page_all_links", "rendered_capabilities", "rendered_mined_links", "rendered_site_map", "rendered_price_map", "rendered_cards", "rendered_site_contacts"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[0].count("MapInArrow") == 1, name


def test_site_map_by_hand(spark):
    shop = '<button>Buy</button><button>BUY</button><form><input name="b"><input name="a"></form><form><input name="a"><input name="b"></form><p>€5</p><p>€5</p><p>€7</p>'
    pages = parsed(spark, shop, "<p>€9 alone</p>", shop.replace("Buy", "Go on").replace("€7", "€8"), None, "")
    listed = spark.createDataFrame([("a.com", 7, "https://a.com", 1), ("other", 8, "https://other", 2)], "site string, site_id int, url string, page_id int")
    site = sorted({r.site for r in pages.select("site").collect()})[0]
    rows = sites.site_map(sites.page_maps(pages), listed.withColumn("site", F.when(F.col("site") == "a.com", site).otherwise(F.col("site"))).drop("page_id")).collect()
    assert [(r.site_id, [b.text for b in r.buttons], [[f.name for f in x.fields] for x in r.forms], [p.text for p in r.prices]) for r in rows] == [(7, ["Buy", "Go on"], [["b", "a"]], ["€5", "€7", "€8"])]
    none = sites.site_map(sites.page_maps(pages.limit(0)), listed)
    assert none.count() == 0 and none.columns == ["site_id", "url", "buttons", "forms", "prices"]


def test_caps_by_kind(spark):
    rows = spark.createDataFrame([("s", kind, n) for kind in "abc" for n in range(6)], "site string, kind string, n int")
    got = offers.first_n(rows, ["site", "kind"], ["n"], 4, {"a": 2, "b": 9}).groupBy("kind").agg(F.max("n").alias("n"), F.count("*").alias("rows"))
    assert {r.kind: (r.n, r["rows"]) for r in got.collect()} == {"a": (1, 2), "b": (3, 4), "c": (3, 4)}


def test_offers_and_mentions_far_down_a_page(spark):
    script = '<script type="application/ld+json">[{"name":"A","offers":{"price":1}},{"offers":[{"name":"B","price":"2"},{"price":0}]},{"hasOfferCatalog":{"itemListElement":[{"offers":{"price":3}}]}},4,null]</script>'
    pages = parsed(spark, "<i></i>" * 3000 + script + '<script type="application/ld+json">{bad</script>', '<script type="application/ld+json">[]</script>', None)
    got = offers.jsonld_offers(pages).orderBy("page_id", "ord").collect()
    assert [(r.page_id, r.ord, r.title, r.price_text) for r in got] == [(0, 0, "A", "1"), (0, 1, "B", "2"), (0, 2, "Package", "3")]
    many = parsed(spark, "<div><b>Head</b>" + "".join(f"<p>€{k % 25}</p>" for k in range(60)) + "</div><div><p>€0</p></div>")
    rows = offers.price_mentions(many).orderBy("ord").collect()
    assert [(r.ord, r.text, r.context) for r in rows] == [(k, f"€{k}", "Head") for k in range(20)]


def test_listing_by_class(spark):
    pages = parsed(spark, '<div class="tile-card"></div>' * 3, '<div class="tile-card"></div>' * 2, "<p>" * 9, '<a href="/a/long-long-long-slug-of-a-page">x</a>' * 5)
    assert [r.is_listing for r in links.listing_flags(pages).orderBy("page_id").collect()] == [True, False, False, True]


def test_home_links_come_from_navigation(spark):
    rows = [("s", "https://s/", f"https://s/{k}", f"https://s/{k}", k, src) for k, src in ((1, "nav"), (2, "all"), (3, "card"))] + [("s", "https://s/1", "https://s/4", "https://s/4", 0, "all"), ("s", "https://s/", "https://s/5", "https://s/5", 9, "all"), ("s", "https://s/", "https://s/5", "https://s/5", 9, "nav")]
    home = spark.createDataFrame([("s", "https://s/")], "site string, url string")
    table = spark.createDataFrame(rows, "site string, src_key string, dst_url string, dst_key string, ord long, source string")
    assert [r.url_key for r in frontier.crawl_frontier(home, table).orderBy("seq").collect()] == ["https://s/", "https://s/1", "https://s/3", "https://s/5", "https://s/4"]
    assert [r.seq for r in frontier.crawl_frontier(home, table, most=2).orderBy("seq").collect()] == [1, 2]


def test_button_groups(spark):
    html = '<form><div><button aria-pressed="true">One</button><button aria-pressed="false">Two</button></div><div><b>Kind *</b><div><button>A</button><button>B</button><button>Next</button></div></div><div><button>Send</button><button>Cancel</button></div></form>'
    got = forms.extract_choices(parsed(spark, html)).collect()
    assert [(r.name, r.required, [o.value for o in r.options]) for r in got] == [("button_group", False, ["One", "Two"]), ("Kind", True, ["A", "B"])]


def test_forms(spark):
    html = '<form id="f"><label for="n">Your name *</label><input id="n" name="who"><select name="s"><option value="">-</option><option>x</option></select><input type="hidden" name="h"><button>Send</button></form><a class="btn" href="javascript:x()">Go</a><a href="#top">Top</a>'
    pages = parsed(spark, html).cache()
    f = forms.extract_forms(pages).first()
    assert [x.name for x in f.fields] == ["who", "s"] and f.selector == "#f" and f.fields[0].label == "Your name *" and f.fields[1].type == "select-one"
    assert [r.text for r in forms.extract_buttons(pages).orderBy("ord").collect()] == ["Send", "Top"]
    caps = forms.cap_forms(pages).first()
    assert '"required":true' in caps.schema_json and '"options":[{"value":"x"' in caps.schema_json
    bar = '<div class="bar"><input name="checkin" placeholder="Check-in"><input placeholder="Check-out"><input placeholder="Guests"><button>Book now</button></div>'
    got = forms.score_booking_bars(parsed(spark, bar)).collect()
    assert got and got[0].score >= 9 and got[0].execution_grade
    wizard = '<div class="wizard">Step 1 of 4 <input name="a"><input name="b"><button>Next</button></div>'
    assert '"total_steps":4' in forms.cap_wizards(parsed(spark, wizard)).first().schema_json


def test_wizard_roots(spark):
    fields = lambda *names: "".join(f'<input name="{n}">' for n in names)
    pages = parsed(
        spark,
        f'<div class="wizard"><div class="step">Step 1 of 2{fields("a")}</div><div class="step">Two{fields("b")}</div></div>',  # one root for both steps
        f'<section><ul><li class="progress-step">One</li></ul><p>{fields("a")}</p></section>',  # the section, not the list
        f'<div><p>{fields("a", "b")}</p><p><button>Напред</button></p></div>',
        f'<div><p>{fields("a")}</p><p><button>Next</button></p></div>',  # one input is too few
        f'<form><div class="wizard">{fields("a", "b")}<button>Next</button></div></form>',
        f'<div class="wizard" hidden>{fields("a", "b")}</div><div class="step">no inputs</div>',
    )
    got = {(r.page_id, r.tag) for r in pages.select("page_id", F.explode(F.transform(forms._wizard_roots(), lambda i: F.get("nodes", i)["tag"])).alias("tag")).collect()}
    assert got == {(0, "div"), (1, "section"), (2, "div")}
    made = {r.page_id: r.schema_json for r in forms.cap_wizards(pages).collect()}
    assert '"total_steps":2' in made[0] and '"step_indicators":["Step 1 of 2","Two"]' in made[0] and '"text":"Напред"' in made[2]


def test_offers(spark):
    html = '<script type="application/ld+json">{"name":"P","offers":[{"price":5},{"price":"7"}]}</script><script type="application/ld+json">{broken</script>'
    assert [(r.title, r.price_text) for r in offers.jsonld_offers(parsed(spark, html)).orderBy("ord").collect()] == [("P", "5"), ("P", "7")]
    cards = "".join(f'<div class="plan"><h3>Plan {k}</h3><span>€{k}0 one-time</span><ul><li>abc {k}</li></ul></div>' for k in range(1, 20))
    got = offers.pricing_cards(parsed(spark, cards)).collect()
    assert len(got) == 12 and {r.card_kind for r in got} == {"pricing"}


def test_first_seen_and_caps(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "a", 3), (1, "b", 4), (2, "a", 1)], "s int, k string, o int")
    assert sorted(map(tuple, offers.first_seen(rows, ["s", "k"], ["o"]).collect())) == [(1, "a", 3), (1, "b", 4), (2, "a", 1)]
    assert offers.first_n(rows, ["s"], ["o"], 1).count() == 2
    assert offers.first_seen(rows.limit(0), ["s", "k"], ["o"]).count() == 0


def test_portfolio_threshold(spark):
    row = lambda s, k: (k, s, f"https://{s}/portfolio/{k}", f"T{k} | x", "general", "40 кв.м", 2, "ok", False)
    docs = spark.createDataFrame([row("a", k) for k in range(4)] + [row("b", 10 + k) for k in range(5)], "page_id long, site string, url string, title string, page_type string, content string, word_count int, status string, partial boolean")
    got = sites.condense_portfolio(docs).collect()
    assert sorted(r.site for r in got) == ["a"] * 4 + ["b"]
    assert [r.content for r in got if r.site == "b"][0].split("\n")[1] == "T10 — 40 кв.м."


def test_site_capabilities_cap(spark):
    caps = spark.createDataFrame([(k, "s", "u", "form", 1, f'{{"fields":"f{k}"}}', None) for k in range(20)] + [(30, "s", "u", "form", 1, '{"fields":"f1"}', None)], "page_id long, site string, url string, kind string, ord int, schema_json string, dom_snapshot string")
    got = sites.site_capabilities(caps).collect()
    assert len(got) == 8 and len({r.template for r in got}) == 8


def test_frontier(spark):
    chain = [("s", f"https://s/{k}", f"https://s/{k + 1}", f"https://s/{k + 1}", 0) for k in range(9)] + [("s", "https://s/0", "https://s/about", "https://s/about", 5), ("s", "https://s/0", "https://s/login", "https://s/login", 6), ("s", "https://s/2", "https://s/0", "https://s/0", 0)]
    home = spark.createDataFrame([("s", "https://s/0")], "site string, url string")
    got = frontier.crawl_frontier(home, spark.createDataFrame(chain, "site string, src_key string, dst_url string, dst_key string, ord long")).orderBy("seq").collect()
    assert [r.url_key for r in got] == ["https://s/0", "https://s/about", "https://s/1", "https://s/2", "https://s/3", "https://s/4", "https://s/5"]
    pages = spark.createDataFrame([(1, "s", "https://s/0", "https://s/1"), (2, "s", "https://s/2", None)], "page_id long, site string, url string, final_url string")
    f = spark.createDataFrame(got)
    assert [r.seq for r in frontier.visited_pages(f, pages).orderBy("seq").collect()] == [1, 4]


def test_requests_and_upsert(spark, tmp_path):
    (tmp_path / "r.txt").write_text('{"url":"http://www.a.b/c?x"}\nnope\n[1]\n{"url":""}\n')
    good, bad = io.read_requests(spark, str(tmp_path / "r.txt"))
    assert [r.url for r in good.collect()] == ["http://a.b/c"] and sorted(r.reason for r in bad.collect()) == ["no_url", "not_an_object", "not_json"]
    old = spark.createDataFrame([("a", 1, "o"), ("b", 1, "o")], "site_id string, updated_at int, v string")
    new = spark.createDataFrame([("a", 1, "n"), ("c", 1, "n")], "site_id string, updated_at int, v string")
    assert sorted((r.site_id, r.v) for r in io.upsert_site_map(old, new).collect()) == [("a", "n"), ("b", "o"), ("c", "n")]
    io.write_results(good, str(tmp_path / "out"), kind="json")
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_recrawls(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = [0, 60, 119, 120, 200, 239, 241, 500]
    rows = spark.createDataFrame([("k", t0 + dt.timedelta(seconds=s)) for s in at] + [(None, t0)], "url_key string, ts timestamp")
    got = jobs.suppress_recrawls(rows).filter("url_key = 'k'").orderBy("ts").collect()
    assert [r.hit for r in got] == [False, True, True, False, True, True, False, False]
    assert jobs.suppress_recrawls(rows.limit(0)).count() == 0


def test_recrawls_across_spans(spark):
    rng, t0 = random.Random(4), dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(milliseconds=rng.randrange(0, 1000 * length))) for k, n, length in (("busy", 3000, 9000), ("some", 300, 30_000), ("rare", 40, 20_000), ("once", 1, 1)) for _ in range(n)]
    rows += rows[:50] + [("even", t0 + dt.timedelta(seconds=60 * s)) for s in range(200)]
    want, anchor = collections.Counter(), {}
    for k, t in sorted(rows):
        fresh = k not in anchor or t - anchor[k] >= dt.timedelta(seconds=120)
        anchor[k] = t if fresh else anchor[k]
        want[k, t, not fresh] += 1
    table = spark.createDataFrame(rows, "url_key string, ts timestamp")
    for span in (120, 1200, 10**6):
        assert collections.Counter(map(tuple, jobs.suppress_recrawls(table, span=span).collect())) == want


def test_recrawl_hits_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(n, k, t0 + dt.timedelta(seconds=s)) for n, (k, s) in enumerate((k, s) for s in (0, 60, 119, 120, 200, 239, 241, 500, 2000, 2100, 2119, 2120) for k in ("k", "m", None))]
    schema = "id int, url_key string, ts timestamp"
    for first in range(0, len(rows), 5):  # in time order: a file is a micro-batch
        spark.createDataFrame(rows[first : first + 5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.stream_recrawl_hits(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = {(r.id, r.hit) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.id, r.hit) for r in jobs.suppress_recrawls(spark.createDataFrame(rows, schema)).collect()}


def test_streams(spark, tmp_path):
    pages = [(k, f"https://s{k % 2}.x/p{k}", "<h1>heading</h1><p>" + "word " * 30 + f"{k}</p>") for k in range(6)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in content.page_docs(dom.parse_pages(df)).collect()}
    q = jobs.stream_page_docs(read()).writeStream.format("parquet").option("path", str(tmp_path / "docs")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert {tuple(r) for r in docs.collect()} == batch
    writer = jobs.stream_site_snapshot(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "docs")), str(tmp_path / "snap"), lambda d: d.groupBy("site").agg(F.count(F.lit(1)).alias("n")))
    writer.option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(120)
    assert {(r.site, r.n) for r in jobs.latest_snapshot(spark, str(tmp_path / "snap")).collect()} == {("s0.x", 3), ("s1.x", 3)}
    q = jobs.stream_stats(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))).writeStream.format("memory").queryName("stats").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("stats").agg(F.sum("n_pages")).first()[0] == 6
    q = jobs.stream_first_seen(read().select(F.lit("s").alias("site"), F.lit("k").alias("url_key"))).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c4")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").count() == 1


def test_every_query_has_rows(spark):
    assert set(registry.ORACLE) <= set(registry.QUERIES)
    for name in ("site_page_types", "url_columns", "json_fingerprints", "latest_orders"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").limit(1).count() == 1


def test_plans_stay_native(spark):
    for name in ("url_columns", "text_contacts", "button_words", "price_texts", "latest_orders"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_small_scans_are_spread_and_full_ones_stay(spark):
    small = read_table(spark, "/root/testdata/sf0.001", "part")
    cores = spark.sparkContext.defaultParallelism
    assert small.rdd.getNumPartitions() < cores and "Exchange" in tables.spread(small)._jdf.queryExecution().toString()
    full = spark.range(0, 100, 1, cores)
    assert tables.spread(full) is full
    assert sorted(tables.spread(small).collect()) == sorted(small.collect())


def test_unclosed_tags_stay_linear():
    small, large = (sum(len(str(n)) for n in dom.parse("<b>" * k)[2]) for k in (1000, 4000))
    assert large < 4.2 * small
    assert [(n["depth"], n["pid"], n["prev"]) for n in dom.parse("<div><p>a<p>b</div><i>")[2]] == [(0, -1, -1), (1, 0, -1), (1, 0, 1), (0, -1, 0)]


def test_climbing(spark):
    pages = parsed(spark, "<nav><ul><li><a href=x>y</a></ul></nav><p><b>z</b>")
    row = pages.select(
        F.transform("nodes", lambda n: dom.up(n)).alias("up"), F.transform("nodes", lambda n: dom.up(n, 2)).alias("two"), F.transform("nodes", lambda n: dom.inside(n, lambda m: m["tag"] == "nav")).alias("inside"),
        F.transform("nodes", lambda n: dom.within(n, lambda m: m["tag"] == "ul")).alias("within"), F.transform("nodes", lambda n: dom.nearest_ancestor(n, lambda m: m["tag"].isin("ul", "p"))).alias("nearest"),
    ).first()
    assert row.up == [[], [0], [1, 0], [2, 1, 0], [], [4]] and row.two == [[], [0], [1, 0], [2, 1], [], [4]]
    assert row.inside == [False, True, True, True, False, False] and row.within == [False, True, True, True, False, False]
    assert row.nearest == [-1, -1, 1, 1, -1, 4]


def test_index_of_ids_classes_and_labels(spark):
    html = '<label for="a">A</label><input id="a" class="x y"><input id="b" class="y z"><p id="b"></p><label for="b">B</label><label for="b">C</label>'
    rows = parsed(spark, html).select(F.explode("nodes").alias("n")).select("n.nid", "n.lone_id", "n.lone_class", "n.label").collect()
    assert [tuple(r) for r in rows[:4]] == [(0, False, "", -1), (1, True, "x", 0), (2, False, "z", 4), (3, False, "", 4)]
    plan = parsed(spark, html).select(F.transform("nodes", forms.unique_selector).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(nodes") == 1 and "filter(nodes" not in plan


def plain_parts(candidates):
    """(kept, emitted intervals) by looking through all that was emitted."""
    out = []
    for nid, last, words in candidates:
        if len(words) >= 5 and all(words != w for _, _, w in out) and not any(a <= nid <= b for a, b, _ in out):
            out.append((nid, last, words))
    return out


def test_parts_against_a_plain_search(spark):
    rng = random.Random(8)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(("alpha", "beta beta", "gamma", "no", "delta delta"))
        return "".join(f"<{t}>{tree(depth - 1)}</{t}>" for t in rng.choices(("ul", "li", "div", "h2"), k=rng.randint(1, 4)))

    htmls = [f"<main>{tree(5)}</main>" for _ in range(40)] + ["", None, "<p>" + "x" * 9]
    rows = content.section_parts(parsed(spark, *htmls)).orderBy("page_id").collect()
    assert sum(len(r.parts) for r in rows) > 60
    for r in rows:
        wanted = [(n.nid, n.last, r.text[n.t0 : n.t1].strip()) for n in r.nodes if n.tag in ("h2", "li", "p")]
        emitted = plain_parts(wanted)
        assert [(p.nid, p.text) for p in r.parts] == [(a, w) for a, _, w in emitted]
        assert r.free == [not any(a <= n.last and n.nid <= b for a, b, _ in emitted) for n in r.nodes]


def test_long_documents_by_rows_of_lines(spark):
    rng = random.Random(3)
    line = lambda: rng.choice(("short", "", " ", "x" * 40, "y" * 39, " " + "x" * 40, "long line number %d of more than forty characters" % rng.randint(0, 30)))
    rows = [(k, "\n".join(line() for _ in range(200))) for k in range(20)] + [(20, None), (21, ""), (22, "TOP_CONTROLS" + "z" * 50), (23, "a\nTOP_CONTROLS\nb"), (24, "\n".join(f"line {k % 9000:060d}" for k in range(100_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("at", F.lit("clash"))
    got = {r.doc_id: r.text for r in content.strip_long_documents(docs).collect()}
    want = {r.doc_id: r.t for r in docs.select("doc_id", text.strip_footer_dedup(F.col("text")).alias("t")).collect()}
    assert got == want and len(got[24].split("\n")) == 9000 and got[20] is None and got[21] == ""
    for k, t in rows[:20]:
        seen, kept = set(), []
        for x in t.split("\n"):
            if len(x.strip()) < 40 or x.strip() not in seen:
                kept.append(x)
                seen.add(x.strip())
        assert got[k] == "\n".join(kept)
    assert content.strip_long_documents(docs.filter("doc_id = 99")).count() == 0


def test_links_are_shuffled_once(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        home, links_ = registry.rendered_queries._tree(spark, "/root/testdata/sf0.001")
        good = frontier.settle_links(links_)
        rounds = [frontier._bucketed(home.select("site", F.col("url").alias("url_key"), "url", F.lit("").alias("via")), "frontier", "site", "url_key")]
        step = frontier.next_round(rounds[0], good, rounds, 1)
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 2  # only what was reached is moved
        assert step.count() == 25
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_saved_site_map(spark, tmp_path):
    path = str(tmp_path / "map")
    rows = lambda *r: spark.createDataFrame(list(r), "site_id string, url string, updated_at long")
    io.save_site_map(rows(*[(f"s{k}", "old", 1) for k in range(40)]), path, buckets=8)
    files = lambda: {f.relative_to(path): f.stat().st_mtime_ns for f in (tmp_path / "map").rglob("*.parquet")}
    before = files()
    for _ in range(2):  # safe to run twice
        io.save_site_map(rows(("s1", "new", 2), ("s2", "late", 0), ("t", "first", 5)), path, buckets=8)
        got = {r.site_id: (r.url, r.updated_at) for r in io.read_site_map(spark, path).collect()}
        assert got == {f"s{k}": ("old", 1) for k in range(40)} | {"s1": ("new", 2), "t": ("first", 5)}
    after = files()
    kept = {f.parts[0] for f, t in after.items() if before.get(f) == t}
    assert len(kept) >= 5 and len({f.parts[0] for f in after} - kept) <= 3
    io.save_site_map(rows(), path, buckets=8)
    assert files() == after and io.read_site_map(spark, str(tmp_path / "none")) is None
