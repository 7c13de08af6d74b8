"""Per-site roll-ups: first seen, capped, then gathered.

Rows are deduplicated by (site, key) with map-side aggregation before anything is grouped by site,
and capped by a rank per site, so a group of one site holds no more rows than its cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import fingerprints, lexicon, money, text, urls
from pageloom.operators import forms as page_forms
from pageloom.operators import offers
from pageloom.operators.offers import first_n, first_seen

CAPS = {"buttons": 50, "forms": 15, "prices": 30, "contacts": 20, "form": 8, "wizard": 5, "booking_widget": 5, "availability": 10}
PORTFOLIO = r"/(proekt/|project/|zavursheni-proekti/|completed|portfolio/|gallery/)"
MANY_PORTFOLIO = 5
LINE_BLOCKS = 64
MOST_PORTFOLIO_CHARS = 500_000_000
_CAP_ORDER = {"form": 0, "wizard": 1, "booking_widget": 2, "availability": 3}


def site_buttons(buttons: DataFrame) -> DataFrame:
    """Buttons of a site, one per lower-case text, 50 at most: (site, page_id, ord, key, text, selector, keywords, action_type)."""
    rows = first_seen(buttons.withColumn("key", F.lower("text")), ["site", "key"], ["page_id", "ord"])
    return first_n(rows, ["site"], ["page_id", "ord"], CAPS["buttons"])


def site_forms(forms: DataFrame) -> DataFrame:
    """Forms of a site, one per sorted field names, 15 at most."""
    key = F.array_join(F.sort_array(F.transform("fields", lambda f: f["name"])), ",")
    rows = first_seen(forms.withColumn("key", key), ["site", "key"], ["page_id", "ord"])
    return first_n(rows, ["site"], ["page_id", "ord"], CAPS["forms"])


def site_prices(prices: DataFrame) -> DataFrame:
    """Price mentions of a site, one per text and context, 30 at most."""
    rows = first_seen(prices.withColumn("key", F.concat_ws("|", "text", "context")), ["site", "key"], ["page_id", "ord"])
    return first_n(rows, ["site"], ["page_id", "ord"], CAPS["prices"])


def page_maps(pages_dom: DataFrame) -> DataFrame:
    """(page_id, site, buttons, forms, prices): what a page adds to its site's map, made in one pass over the page.

    Prices count only on pages with a button or a form; a page without either has three empty arrays.
    """
    made = pages_dom.select("page_id", "site", page_forms.buttons_of_page().alias("buttons"), page_forms.forms_of_page().alias("forms"), offers.mentions_of_page().alias("prices"))
    mapped = (F.size("buttons") > 0) | (F.size("forms") > 0)
    return made.withColumn("prices", F.when(mapped, F.col("prices")).otherwise(F.slice("prices", 1, 0)))


def site_map(maps: DataFrame, sites: DataFrame) -> DataFrame:
    """(site_id, url, buttons, forms, prices), one row a site of ``sites`` (site, site_id, url) with a page map.

    The rows of all three kinds go through one deduplication, one rank and one gathering. Keywords and types are
    looked up for the rows that the caps left only.
    """
    entry = {
        "buttons": lambda x: F.lower(x["text"]),
        "forms": lambda x: F.array_join(F.sort_array(F.transform(x["fields"], lambda f: f["name"])), ","),
        "prices": lambda x: F.concat_ws("|", x["text"], x["context"]),
    }
    nothing = lambda k: F.lit(None).cast(maps.schema[k].dataType.elementType)
    tagged = lambda k: F.transform(k, lambda x: F.struct(F.lit(k).alias("kind"), entry[k](x).alias("key"), x["ord"].alias("ord"), *[(x if o == k else nothing(o)).alias(o) for o in entry]))
    rows = maps.select("page_id", "site", F.explode(F.concat(*map(tagged, entry))).alias("e")).select("page_id", "site", "e.*")
    rows = first_n(first_seen(rows, ["site", "kind", "key"], ["page_id", "ord"]), ["site", "kind"], ["page_id", "ord"], max(CAPS[k] for k in entry), {k: CAPS[k] for k in entry})
    shown = {
        "buttons": lambda b: F.struct(b["text"].alias("text"), b["selector"].alias("selector"), lexicon.keywords(b["text"]).alias("keywords"), lexicon.action_type(b["text"]).alias("action_type")),
        "forms": lambda f: F.struct(f["selector"].alias("selector"), f["submit_button"].alias("submit_button"), F.transform(f["fields"], page_forms.rich_field).alias("fields")),
        "prices": lambda p: F.struct(p["text"].alias("text"), p["context"].alias("context")),
    }
    of_kind = lambda k: F.collect_list(F.when(F.col("kind") == k, F.struct("page_id", "ord", shown[k](F.col(k)).alias("row"))))
    gathered = rows.groupBy("site").agg(*[F.transform(F.array_sort(of_kind(k)), lambda x: x["row"]).alias(k) for k in entry])
    return gathered.join(sites, "site").select("site_id", "url", *entry)


def site_capabilities(caps: DataFrame) -> DataFrame:
    """(site, url, kind, rank, fingerprint, template, schema_json, dom_snapshot): first seen per template, capped by kind."""
    vendor = lexicon.vendor(F.get_json_object("schema_json", "$.src"), rollup=True)
    swapped = F.regexp_replace("schema_json", r'"vendor":"[^"]*"', F.concat(F.lit('"vendor":"'), vendor, F.lit('"')))
    rows = caps.withColumn("schema_json", F.when(F.col("kind") == "booking_widget", swapped).otherwise(F.col("schema_json")))
    rows = rows.withColumns({"fingerprint": fingerprints.fingerprint(F.col("kind"), F.col("schema_json")), "template": fingerprints.template_fingerprint(F.col("kind"), F.col("schema_json"))})
    place = F.create_map(*[x for k, v in _CAP_ORDER.items() for x in (F.lit(k), F.lit(v))])
    rows = first_seen(rows.withColumn("place", F.try_element_at(place, F.col("kind"))), ["site", "kind", "template"], ["page_id", "place", "ord"])
    from pyspark.sql import Window

    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("site", "kind").orderBy("page_id", "place", "ord")))
    cap = F.create_map(*[x for k in _CAP_ORDER for x in (F.lit(k), F.lit(CAPS[k]))])
    return rows.filter(F.col("rank") <= F.coalesce(F.try_element_at(cap, F.col("kind")), F.lit(10))).select("site", "url", "kind", "rank", "fingerprint", "template", "schema_json", "dom_snapshot")


def site_contacts(page_contacts: DataFrame) -> DataFrame:
    """(site, emails, phones): union over pages in order, 20 of each."""
    kinds = ("emails", "phones")
    said = lambda k: F.transform(k, lambda v, i: F.struct(F.lit(k).alias("kind"), i.alias("ord"), F.trim(v).alias("value")))
    rows = page_contacts.select("page_id", "site", F.explode(F.concat(*[F.coalesce(said(k), F.array().cast("array<struct<kind:string,ord:int,value:string>>")) for k in kinds])).alias("c"))
    rows = rows.select("page_id", "site", "c.*").filter("value <> ''")
    rows = first_n(first_seen(rows, ["site", "kind", "value"], ["page_id", "ord"]), ["site", "kind"], ["page_id", "ord"], CAPS["contacts"])
    of_kind = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("page_id", "ord", "value"))))
    return rows.groupBy("site").agg(*[F.transform(of_kind(k), lambda x: x["value"]).alias(k) for k in kinds])


def crawl_stats(pages_dom: DataFrame, kept: DataFrame | Column) -> DataFrame:
    """(site, visited, saved, errors, by_type): types count before the word rule and after the placeholder rule.

    ``kept`` tells which pages were saved: a table with their page_id, which is joined, or a test of the page's own row,
    as ``content.is_readable()``, which needs no second look at the pages and no shuffle of them.
    """
    of_row = isinstance(kept, Column)
    typed = pages_dom.select("site", "page_id", "parse_error", text.is_challenge_page(F.col("title"), F.col("text")).alias("challenge"), urls.page_type(F.col("url"), F.col("title")).alias("page_type"), *([kept.cast("int").alias("saved")] if of_row else []))
    if not of_row:
        typed = typed.join(kept.select("page_id").distinct().withColumn("saved", F.lit(1)), "page_id", "left")
    by = typed.groupBy("site", "page_type").agg(
        F.count_if(~F.col("parse_error")).alias("visited"), F.sum(F.coalesce("saved", F.lit(0))).alias("saved"), F.count_if(F.col("parse_error") | F.col("challenge")).alias("errors"), F.count_if(~F.col("parse_error") & ~F.col("challenge")).alias("n"),
    )
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("page_type", "n")))))
    return by.groupBy("site").agg(F.sum("visited").alias("visited"), F.sum("saved").alias("saved"), F.sum("errors").alias("errors"), pairs.alias("by_type"))


def condense_portfolio(docs: DataFrame) -> DataFrame:
    """Page rows; where a site has five or more portfolio pages, one summary row in their place.

    Lines are joined in two steps: within each of 64 ranges of page ids of a site, cut at approximate quantiles, and
    then range by range, so no group holds more than about a 64th of a site's lines but for repeated ids; the result
    itself is one text a site. A text of over 500,000,000 characters, near what one value can hold, raises an error
    that names the site.
    """
    from pageloom.functions.regexes import matches

    flagged = docs.withColumn("_portfolio", matches(F.col("url"), PORTFOLIO))
    cuts = F.percentile_approx("page_id", F.array(*[F.lit(k / LINE_BLOCKS) for k in range(1, LINE_BLOCKS)])).alias("_cuts")
    many = flagged.filter("_portfolio").groupBy(F.col("site").alias("_p_site")).agg(F.count(F.lit(1)).alias("n"), cuts).filter(F.col("n") >= MANY_PORTFOLIO)
    joined = flagged.join(many, F.col("site") == F.col("_p_site"), "left").withColumn("_condense", F.col("_portfolio") & F.col("n").isNotNull())
    area = money.area_m2(F.col("content"))
    name = F.when(money.compact_title(F.col("title")) != "", money.compact_title(F.col("title"))).otherwise(money.slug(F.col("url")))
    line = F.concat(name, F.coalesce(F.concat(F.lit(" — "), area.cast("string"), F.lit(" кв.м.")), F.lit("")))
    block = F.size(F.filter("_cuts", lambda c: c < F.col("page_id"))).alias("block")
    rows = joined.filter("_condense").select("site", "page_id", block, urls.origin(F.col("url")).alias("base"), line.alias("line"))
    blocks = rows.groupBy("site", "block").agg(F.max("page_id").alias("page_id"), F.min("base").alias("base"), F.array_sort(F.collect_list(F.struct("page_id", "line"))).alias("lines"))
    texts = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    blocks = blocks.select("site", "block", "page_id", "base", F.size("lines").alias("n_lines"), texts.alias("text"))
    sites_ = blocks.groupBy("site").agg(
        F.max("page_id").alias("page_id"), F.min("base").alias("base"), F.sum("n_lines").alias("n_lines"), F.sum(F.length("text").cast("long")).alias("size"),
        F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]).alias("texts"),
    )
    most = F.raise_error(F.concat(F.lit("portfolio text of over 500,000,000 characters: site "), "site")).cast("string")
    body = F.when(F.col("size") > MOST_PORTFOLIO_CHARS, most).otherwise(F.array_join("texts", "\n"))
    summary = sites_.withColumn("body", body).select(
        "page_id", "site", F.concat("base", F.lit("/projects-summary")).alias("url"), F.lit("Проекти и завършени обекти (обобщено)").alias("title"), F.lit("general").alias("page_type"),
        F.concat(F.lit("ПРОЕКТИ И ЗАВЪРШЕНИ ОБЕКТИ ("), F.col("n_lines").cast("string"), F.lit(" бр.):\n"), "body").alias("content"),
        text.word_count(F.col("body")).alias("word_count"), F.lit("ok").alias("status"), F.lit(False).alias("partial"),
    )
    return joined.filter(~F.col("_condense")).select(*docs.columns).unionByName(summary.select(*docs.columns))
