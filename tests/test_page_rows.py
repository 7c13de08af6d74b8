"""What a page's own row answers is answered there: cards and statistics need no second look at a page and no shuffle of pages."""

import random

from pyspark.sql import functions as F

from pageloom.functions import money
from pageloom.functions.regexes import WS, ci, matches, norm_ws
from pageloom.operators import content, dom, offers, sites
from pageloom.plans import registry

DATA = "/root/testdata/sf0.001"


def pages_of(spark, *htmls):
    return spark.createDataFrame([(k, f"https://www.a.com/p{k}", h) for k, h in enumerate(htmls)], "page_id long, url string, html string")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_cards_need_no_shuffle(spark):
    for name in ("rendered_card_sources", "rendered_cards"):
        plan = plan_of(registry.QUERIES[name](spark, DATA))
        assert "hashpartitioning" not in plan and "Window" not in plan and "Aggregate" not in plan and plan.count("MapInArrow") == 1, name


def test_cards_of_repeated_pages_repeat(spark):
    card = lambda k: f'<div class="plan"><h3>Plan {k}</h3><span class="price">€{k}0 {"per month" if k % 2 else "one-time"}</span><ul><li>abc {k}</li></ul></div>'
    pages = pages_of(spark, "".join(map(card, range(1, 31))) + "".join(map(card, range(30, 0, -1))), card(1), None, "")
    got = sorted(map(tuple, offers.pricing_cards(dom.parse_pages(pages.unionAll(pages).filter("page_id <> 1"))).drop("features").collect()))
    once = sorted(map(tuple, offers.pricing_cards(dom.parse_pages(pages.filter("page_id <> 1"))).drop("features").collect()))
    assert got == sorted(once * 2)
    assert [r[2:5] for r in once] == [("installment", n, f"Plan {2 * n - 1}") for n in range(1, 13)] + [("pricing", n, f"Plan {2 * n}") for n in range(1, 13)]


def test_money_with_its_guard_is_money(spark):
    rng = random.Random(2)
    bits = ["€", "лв.", "лева", "r$", "EUR", "eur ", " ", "  ", "   ", "\n \n \t  ", "1", "12", "1 234,50", "7.", "from ", "desde  ", "ОТ ", "/", "/ mo", "month", "x", "слово", "😀", "Kč", "zł", "ſek", "K"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(4000)] + [None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = norm_ws(F.regexp_extract(F.coalesce("t", F.lit("")), ci(money.MONEY), 0))
    got = rows.select(money.has_money(F.col("t")).alias("has"), matches(F.col("t"), money.MONEY).alias("plain_has"), money.money_match(F.col("t")).alias("text"), plain.alias("plain_text")).collect()
    assert all(r.has == r.plain_has and r.text == r.plain_text for r in got) and 500 < sum(r.has for r in got) < 3900


def test_white_space_and_descendants(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(" \t\n  ﻿\u0085abя!~", k=rng.randint(0, 12))) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    before = F.regexp_replace(F.regexp_replace("t", f"{WS}+", " "), rf"^{WS}+|{WS}+\z", "")
    assert rows.filter(norm_ws(F.col("t")) != before).count() == 0
    pages = dom.parse_pages(pages_of(spark, "<div><p>a<b>x</b><p>b</div><i></i>", "", None))
    got = pages.orderBy("page_id").select(F.transform("nodes", lambda n: F.transform(dom.below(n), lambda m: m["nid"])).alias("x")).collect()
    assert [r.x for r in got] == [[[1, 2, 3], [2], [], [], []], [], []]


def test_statistics_look_at_a_page_once(spark):
    plan = plan_of(registry.QUERIES["rendered_stats"](spark, DATA))
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Arrow" not in plan.replace("MapInArrow", "") and "hashpartitioning(page_id" not in plan and "nodes" not in plan


def test_statistics_by_row_are_those_by_kept_table(spark):
    htmls = ["<title>Just a moment</title><p>x", "<h1>heading</h1><p>" + "word " * 30, "<p>few words", None, "", "<p>" + "a" * 590 + " ray id", "<p>" + "a" * 601 + " ray id", "<title>a</title><script>please wait</script><style>p</style><textarea>ray id</textarea>"]
    pages = pages_of(spark, *htmls, *htmls).withColumn("url", F.when(F.col("page_id") % 3 == 0, F.replace("url", F.lit("/p"), F.lit("/services/p"))).otherwise(F.col("url")))
    parsed = dom.parse_pages(pages)
    kept = content.page_docs(parsed, keep_all=True)
    ids = lambda df: sorted(r.page_id for r in df.select("page_id").collect())
    assert ids(parsed.filter(content.is_readable())) == ids(kept) and 0 < len(ids(kept)) < 16
    bare = dom.parse_pages(pages, elements=False)
    assert bare.columns == [c for c in parsed.columns if c != "nodes"] and sorted(map(tuple, bare.collect()), key=str) == sorted(map(tuple, parsed.drop("nodes").collect()), key=str)
    stats = lambda df, which: sorted((r.site, r.visited, r.saved, r.errors, sorted(r.by_type.items())) for r in sites.crawl_stats(df, which).collect())
    by_row = stats(bare, content.is_readable())
    assert by_row == stats(parsed, kept) and by_row[0][2] == len(ids(kept))
