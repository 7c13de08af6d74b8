"""Round trips: pages rendered from business tables, extracted again; the oracle is the source columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions import urls
from pageloom.operators import content, dom, forms, frontier, links, offers, sites
from pageloom.plans import rendered
from pageloom.sources.tables import read_table, spread
from pageloom.streaming import jobs


def rendered_specs(spark, sf_dir):
    """Specifications of product pages."""
    parsed = dom.parse_pages(rendered.product_pages(spread(read_table(spark, sf_dir, "part"))))
    rows = offers.product_specs(parsed)
    value = lambda k: F.get(F.filter("specs", lambda s: s["key"] == k), F.lit(0))["value"]
    return rows.select("page_id", "title", "description", value("Brand").alias("brand"), value("Type").alias("type"), value("Size").alias("size"), F.array_join("prices", "|").alias("prices"), F.size("specs").alias("n_specs"))


def rendered_specs_text(spark, sf_dir):
    """The specification block of product pages."""
    parsed = dom.parse_pages(rendered.product_pages(spread(read_table(spark, sf_dir, "part"))))
    return offers.specs_text(offers.product_specs(parsed))


def rendered_cards(spark, sf_dir):
    """Pricing cards and instalment plans."""
    parsed = dom.parse_pages(rendered.card_pages(spread(read_table(spark, sf_dir, "part"))))
    cards = offers.pricing_cards(parsed).filter("ord = 1")
    return cards.select("page_id", "card_kind", "title", "price_text", "period", "badge", F.array_join("features", "|").alias("features"))


def rendered_card_sources(spark, sf_dir):
    """Every card of pages with cards of all sources, in their order, repeats told apart by the keys of each source."""
    cards = offers.pricing_cards(dom.parse_pages(rendered.card_source_pages(spread(read_table(spark, sf_dir, "part")))))
    return cards.select("page_id", "site", "card_kind", "ord", "title", "price_text", "period", "badge", F.array_join("features", "|").alias("features"))


def rendered_prices(spark, sf_dir):
    """Price mentions with their context."""
    parsed = dom.parse_pages(rendered.card_pages(spread(read_table(spark, sf_dir, "part"))))
    return offers.price_mentions(parsed).select("page_id", "text", "context")


def rendered_offers(spark, sf_dir):
    """Offers in JSON-LD."""
    parsed = dom.parse_pages(rendered.jsonld_pages(spread(read_table(spark, sf_dir, "part"))))
    return offers.jsonld_offers(parsed).select("page_id", "title", "price_text")


def rendered_contacts(spark, sf_dir):
    """Contacts of every supplier page."""
    rows = content.page_contacts(dom.parse_pages(rendered.contact_pages(spread(read_table(spark, sf_dir, "supplier")))))
    return rows.select("page_id", "site", F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"))


def rendered_site_contacts(spark, sf_dir):
    """Contacts of every site, first seen, twenty of each."""
    rows = sites.site_contacts(content.page_contacts(dom.parse_pages(rendered.contact_pages(spread(read_table(spark, sf_dir, "supplier"))))))
    return rows.select("site", F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"))


def rendered_forms(spark, sf_dir):
    """Fields of every customer form."""
    rows = forms.enrich_forms(forms.extract_forms(dom.parse_pages(rendered.form_pages(spread(read_table(spark, sf_dir, "customer"))))))
    rows = rows.select("page_id", "site", "submit_button", F.posexplode("fields").alias("pos", "f"))
    return rows.select("page_id", "site", "submit_button", "pos", "f.name", "f.type", F.array_join("f.keywords", ",").alias("keywords"))


def rendered_buttons(spark, sf_dir):
    """Buttons of every site, one per text."""
    rows = forms.enrich_buttons(forms.extract_buttons(dom.parse_pages(rendered.form_pages(spread(read_table(spark, sf_dir, "customer"))))))
    return sites.site_buttons(rows).select("site", "text", "action_type", "page_id")


def rendered_choices(spark, sf_dir):
    """Choices of every customer form: option values by group."""
    parsed = dom.parse_pages(rendered.form_pages(spread(read_table(spark, sf_dir, "customer"))))
    return forms.extract_choices(parsed).select("page_id", "name", "type", F.array_join(F.transform("options", lambda o: o["value"]), ",").alias("options"))


def rendered_capabilities(spark, sf_dir):
    """Capabilities of every site, one per template."""
    caps = forms.page_capabilities(dom.parse_pages(rendered.form_pages(spread(read_table(spark, sf_dir, "customer")))))
    return sites.site_capabilities(caps).groupBy("site", "kind").agg(F.count(F.lit(1)).alias("n"))


def _sites_of(pages):
    """The sites that pages belong to, from their urls alone."""
    found = pages.select(urls.normalize_domain(F.col("url")).alias("site")).distinct()
    return found.select("site", F.col("site").alias("site_id"), F.concat(F.lit("https://"), "site").alias("url"))


def rendered_site_map(spark, sf_dir):
    """Site maps: how many buttons, forms and prices each site has."""
    pages = rendered.form_pages(spread(read_table(spark, sf_dir, "customer")))
    parsed = dom.parse_pages(pages)
    listed = _sites_of(pages)
    rows = sites.site_map(sites.page_maps(parsed), listed)
    return rows.select("site_id", F.size("buttons").alias("n_buttons"), F.size("forms").alias("n_forms"), F.size("prices").alias("n_prices"))


def _extraction(spark, sf_dir):
    return dom.parse_pages(rendered.extraction_pages(spread(read_table(spark, sf_dir, "part"))))


def rendered_sections(spark, sf_dir):
    """Sections of general pages: headings, and items marked by their svg, font or image icon."""
    return content.extract_sections(_extraction(spark, sf_dir)).select("page_id", "site", "heading", "text")


def rendered_mined_links(spark, sf_dir):
    """Mined links of general pages by where they were found."""
    return links.mine_links(_extraction(spark, sf_dir)).select("page_id", "dst_url", "source")


def rendered_page_links(spark, sf_dir):
    """All links of each page: mined ones of general pages only; a third are contact pages."""
    pages = rendered.extraction_pages(spread(read_table(spark, sf_dir, "part")))
    url = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "/g([0-9]+)$", "/contact-$1")).otherwise(F.col("url"))
    return links.page_links(dom.parse_pages(pages.withColumn("url", url))).select("page_id", "src_url", "dst_url")


def rendered_listings(spark, sf_dir):
    """Listing flag: three cards or more."""
    return links.listing_flags(_extraction(spark, sf_dir)).select("page_id", "is_listing")


def rendered_dialogs(spark, sf_dir):
    """Dialog texts of general pages."""
    return _extraction(spark, sf_dir).select("page_id", content.dialog_text().alias("dialog"))


def rendered_stats(spark, sf_dir):
    """Statistics of sites with placeholder pages and pages that do not parse."""
    parsed = dom.parse_pages(rendered.extraction_pages(spread(read_table(spark, sf_dir, "part"))), elements=False)
    stats = sites.crawl_stats(parsed, content.is_readable())  # what page_docs(keep_all=True) keeps
    return stats.select("site", "visited", "saved", "errors", F.coalesce(F.try_element_at("by_type", F.lit("general")), F.lit(0)).cast("long").alias("general"))


def rendered_price_map(spark, sf_dir):
    """Prices of each site map: first seen, thirty at most, of pages with a button or form."""
    pages = rendered.mapped_pages(spread(read_table(spark, sf_dir, "part")))
    parsed = dom.parse_pages(pages)
    listed = _sites_of(pages)
    rows = sites.site_map(sites.page_maps(parsed), listed)
    return rows.select("site_id", F.posexplode("prices").alias("pos", "p")).select("site_id", "pos", "p.text", "p.context")


def rendered_button_groups(spark, sf_dir):
    """Button groups of every form: pressed ones and sibling options."""
    parsed = dom.parse_pages(rendered.option_pages(spread(read_table(spark, sf_dir, "customer"))))
    return forms.extract_choices(parsed).select("page_id", "name", "type", "required", F.array_join(F.transform("options", lambda o: o["value"]), ",").alias("options"))


def rendered_schemas(spark, sf_dir):
    """What the capability schemas of every form page say."""
    caps = forms.page_capabilities(dom.parse_pages(rendered.form_pages(spread(read_table(spark, sf_dir, "customer"))))).filter("kind = 'form'")
    said = lambda path: F.get_json_object("schema_json", path)
    return caps.select("page_id", "site", said("$.fields[0].name").alias("first_name"), said("$.fields[0].label").alias("first_label"), said("$.fields[0].required").alias("first_required"), said("$.choices[1].options[0].value").alias("segment"), said("$.submit.text").alias("submit"), said("$.method").alias("method"))


def rendered_wizards(spark, sf_dir):
    """Wizards outside forms: found by a step class, by a step indicator, by a next button."""
    caps = forms.cap_wizards(dom.parse_pages(rendered.wizard_pages(spread(read_table(spark, sf_dir, "customer")))))
    said = lambda path: F.get_json_object("schema_json", path)
    return caps.select(
        "page_id", "site", said("$.fields[0].name").alias("first_name"), said("$.choices[0].options[0].value").alias("option"), said("$.submit.text").alias("submit"), said("$.total_steps").alias("total_steps"),
        said("$.step_indicators").alias("step_indicators"),
    )


def rendered_parts(spark, sf_dir):
    """Details, marked features, overlays and what main holds besides its sections, of every page."""
    parsed = content.section_parts(dom.parse_pages(rendered.part_pages(spread(read_table(spark, sf_dir, "part")))))
    joined = lambda a: F.array_join(a, "|")
    return parsed.select("page_id", joined(content.details_texts()).alias("details"), joined(content.icon_feature_texts()).alias("features"), joined(content.overlay_texts()).alias("overlays"), joined(content.main_texts(F.col("free"))).alias("main"))


def rendered_boilerplate(spark, sf_dir):
    """Header, footer and navigation texts of home pages."""
    return content.boilerplate_text(dom.parse_pages(rendered.part_pages(spread(read_table(spark, sf_dir, "part")))))


def rendered_icons(spark, sf_dir):
    """Sections whose features are marked by colour, reference, label, font or image of an icon."""
    return content.extract_sections(dom.parse_pages(rendered.icon_pages(spread(read_table(spark, sf_dir, "part"))))).select("page_id", "heading", "text")


def rendered_full_text(spark, sf_dir):
    """Every element's and text run's words of icon pages, each once."""
    return dom.parse_pages(rendered.icon_pages(spread(read_table(spark, sf_dir, "part")))).select("page_id", content.full_text().alias("full_text"))


def rendered_page_docs(spark, sf_dir):
    """Kept page rows of general pages: marked features, sections, overlays and dialogs, each line once; placeholders and pages without html go."""
    rows = content.page_docs(_extraction(spark, sf_dir))
    return rows.select("page_id", "site", "title", "page_type", F.md5("content").alias("content_md5"), "word_count", "status", "partial")


def tree_visit_order(spark, sf_dir):
    """The first forty pages of each site in the order of their visit."""
    home, links_ = _tree(spark, sf_dir)
    return frontier.crawl_frontier(home, links_, most=frontier.MAX_PAGES).select("site", "seq", "url", "depth")


def tree_home_order(spark, sf_dir):
    """The first forty pages of each site where links have a source and some come first."""
    home, links_ = rendered.tagged_links(read_table(spark, sf_dir, "nation"), spread(read_table(spark, sf_dir, "customer")))
    return frontier.crawl_frontier(home, links_, most=frontier.MAX_PAGES).select("site", "seq", "url", "depth", "priority")


def rendered_portfolio(spark, sf_dir):
    """Page rows with the portfolio pages of large sites condensed."""
    rows = sites.condense_portfolio(rendered.portfolio_pages(read_table(spark, sf_dir, "orders")))
    return rows.select("site", "url", F.md5("content").alias("content_md5"), "word_count")


def _tree(spark, sf_dir):
    nation, customer, orders = (read_table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    return rendered.tree_links(nation, customer, spread(orders))


def tree_frontier(spark, sf_dir):
    """Pages reached by site and depth."""
    home, links = _tree(spark, sf_dir)
    return frontier.crawl_frontier(home, links).groupBy("site", "depth").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("first_url"))


def tree_next_urls(spark, sf_dir):
    """What to fetch next when the pages of the first levels are there."""
    home, links = _tree(spark, sf_dir)
    nation = read_table(spark, sf_dir, "nation")
    have = home.select("url").unionAll(nation.select(F.concat(F.lit("https://region"), F.col("n_regionkey").cast("string"), F.lit(".example/n/"), F.col("n_nationkey").cast("string")).alias("url")))
    return frontier.next_urls(frontier.crawl_frontier(home, links), have).select("site", "url_key", "depth")


def rendered_selectors(spark, sf_dir):
    """Selectors and labels of every form, its button and its fields."""
    rows = forms.extract_forms(dom.parse_pages(rendered.control_pages(spread(read_table(spark, sf_dir, "customer")))))
    rows = rows.select("page_id", F.col("selector").alias("form"), "submit_button", F.posexplode("fields").alias("pos", "f"))
    return rows.select("page_id", "form", "submit_button", "pos", "f.name", "f.selector", "f.label")


def rendered_availability(spark, sf_dir):
    """What the schemas of frames, date inputs, calendars and booking bars say."""
    parsed = dom.parse_pages(rendered.booking_pages(spread(read_table(spark, sf_dir, "customer"))))
    caps = forms.page_capabilities(parsed).filter("kind <> 'form'")
    said = lambda *paths: F.coalesce(*[F.get_json_object("schema_json", p) for p in paths])
    return caps.select(
        "page_id", "kind", said("$.ui_type").alias("ui_type"), said("$.vendor", "$.booking_vendor").alias("vendor"), said("$.src", "$.iframe_src").alias("src"), said("$.date_inputs[0].name").alias("date_name"),
        said("$.date_inputs[0].label").alias("date_label"), said("$.calendar_containers[0].text_hint").alias("calendar"), said("$.score").alias("score"), said("$.execution_grade").alias("ready"),
    )


def rendered_templates(spark, sf_dir):
    """The first form of each template of a site: forms differ in the numbers of a field's name, which templates leave out, and in an option."""
    caps = sites.site_capabilities(forms.cap_forms(dom.parse_pages(rendered.form_pages(spread(read_table(spark, sf_dir, "customer"))))))
    return caps.select("site", "kind", "rank", "url", F.get_json_object("schema_json", "$.fields[0].name").alias("first_name"))


def rendered_site_forms(spark, sf_dir):
    """The first fifteen forms of each site by their field names."""
    rows = sites.site_forms(forms.enrich_forms(forms.extract_forms(dom.parse_pages(rendered.form_pages(spread(read_table(spark, sf_dir, "customer")))))))
    return rows.select("site", "page_id", F.array_join(F.transform("fields", lambda f: f["name"]), ",").alias("names"), F.array_join(F.transform("fields", lambda f: f["type"]), ",").alias("types"))


def rendered_salvage(spark, sf_dir):
    """Rows of pages that could not be read: kept on request, marked as partial."""
    rows = content.page_docs(_extraction(spark, sf_dir), keep_all=True).filter("partial")
    return rows.select("page_id", "site", "page_type", "content", "word_count", "status", "partial")


def tree_visited(spark, sf_dir):
    """The first forty customer pages of each site in the order of their visit; a fifth was reached by a redirect."""
    home, links_ = _tree(spark, sf_dir)
    customer = read_table(spark, sf_dir, "customer").join(read_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    site = F.concat(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit(".example"))
    page = lambda folder: F.concat(F.lit("https://"), site, F.lit(folder), F.col("c_custkey").cast("string"))
    moved = F.col("c_custkey") % 5 == 0
    kept = customer.select(F.col("c_custkey").alias("page_id"), site.alias("site"), F.when(moved, page("/old/")).otherwise(page("/c/")).alias("url"), F.when(moved, page("/c/")).alias("final_url"))
    return frontier.visited_pages(frontier.crawl_frontier(home, links_), kept).select("site", "page_id", "url_key", "seq")


def event_recrawls(spark, sf_dir):
    """Events as requests: crawled or answered from the last crawl."""
    rows = jobs.suppress_recrawls(jobs.requests_of_events(read_table(spark, sf_dir, "events")), ties=("event_id",))
    return rows.select("event_id", "url_key", "hit")


QUERIES = {
    f.__name__: f
    for f in (
        rendered_specs, rendered_specs_text, rendered_cards, rendered_card_sources, rendered_prices, rendered_offers, rendered_contacts, rendered_site_contacts, rendered_forms, rendered_buttons, rendered_choices, rendered_capabilities,
        rendered_site_map, rendered_portfolio, rendered_selectors, rendered_availability, rendered_templates, rendered_site_forms, rendered_salvage, tree_visited, rendered_sections, rendered_mined_links, rendered_listings, rendered_dialogs, rendered_stats, rendered_price_map, rendered_button_groups, rendered_schemas, rendered_wizards, rendered_page_docs, rendered_parts, rendered_boilerplate, rendered_icons, rendered_full_text, tree_visit_order, tree_home_order, rendered_page_links, tree_frontier, tree_next_urls, event_recrawls,
    )
}

_PRICE = "CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR)"
_FORM_SITE = "'n' || c_nationkey || '.example'"
_PHONE = "'+359' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0')"
_REGION = "'https://region' || n_regionkey || '.example/'"

ORACLE = {
    "rendered_specs": f"""
        SELECT p_partkey AS page_id, p_name AS title, 'About ' || p_name AS description, p_brand AS brand, p_type AS type, CAST(p_size AS VARCHAR) AS size, '€' || {_PRICE} AS prices, 3 AS n_specs
        FROM part""",
    "rendered_specs_text": f"""
        SELECT p_partkey AS page_id, 'PRODUCT_SPECS' || chr(10) || 'Продукт: ' || p_name || chr(10) || 'Цена: €' || {_PRICE} || chr(10) || 'Brand: ' || p_brand || chr(10) || 'Type: ' || p_type || chr(10)
               || 'Size: ' || p_size || chr(10) || 'Описание: About ' || p_name AS specs_text
        FROM part""",
    "rendered_cards": f"""
        SELECT p_partkey AS page_id, CASE WHEN p_partkey % 2 = 1 THEN 'installment' ELSE 'pricing' END AS card_kind, 'Plan ' || p_partkey AS title,
               '€' || {_PRICE} || CASE WHEN p_partkey % 2 = 1 THEN ' /month' ELSE ' one-time' END AS price_text, CASE WHEN p_partkey % 2 = 1 THEN 'monthly' ELSE 'one_time' END AS period,
               'Best value' AS badge, '✓ ' || '✓ ' || p_brand || '|' || '✗ ' || '✗ ' || p_type || '|Size ' || p_size AS features
        FROM part""",
    "rendered_card_sources": f"""
        SELECT p_partkey AS page_id, 'shop' || (p_partkey % 7) || '.example' AS site, v.card_kind, CAST(v.ord AS INTEGER) AS ord, v.title, v.price_text, v.period, v.badge, v.features
        FROM part, LATERAL (VALUES ('pricing', 1, 'Alpha ' || p_partkey, {_PRICE}, NULL, '', ''), ('pricing', 2, 'Beta ' || p_partkey || ' plan', '€' || {_PRICE}, NULL, '', 'Type ' || p_type),
            ('pricing', 3, 'Epsilon ' || p_partkey, {_PRICE}, NULL, '', ''), ('pricing', 4, 'Epsilon ' || p_partkey, {_PRICE}, NULL, '', ''), ('pricing', 5, 'Delta ' || p_partkey, 'On request', NULL, 'Best value', ''),
            ('pricing', 6, 'Beta ' || p_partkey || ' plan', '€' || {_PRICE}, NULL, '', 'Type ' || p_type), ('installment', 1, 'Gamma ' || p_partkey, '€' || p_size, 'monthly', '', '')
        ) AS v(card_kind, ord, title, price_text, period, badge, features)""",
    "rendered_prices": f"SELECT p_partkey AS page_id, regexp_extract('€' || {_PRICE} || ' ', '€[0-9]+[.][0-9]*') AS text, 'Plan ' || p_partkey AS context FROM part",
    "rendered_offers": f"SELECT p_partkey AS page_id, p_name AS title, {_PRICE} AS price_text FROM part WHERE p_partkey % 50 <> 0",
    "rendered_contacts": f"SELECT s_suppkey AS page_id, 'nation' || s_nationkey || '.example' AS site, 'supplier' || s_suppkey || '@mail.example' AS emails, {_PHONE} AS phones FROM supplier",
    "rendered_site_contacts": f"""
        SELECT site, string_agg(email, ',' ORDER BY s_suppkey) AS emails, string_agg(phone, ',' ORDER BY s_suppkey) AS phones
        FROM (SELECT 'nation' || s_nationkey || '.example' AS site, s_suppkey, 'supplier' || s_suppkey || '@mail.example' AS email, {_PHONE} AS phone,
                     row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier)
        WHERE r <= 20 GROUP BY site""",
    "rendered_parts": """
        SELECT p_partkey AS page_id, 'Question ' || p_partkey || chr(10) || 'Size | ' || p_size || chr(10) || 'Answer ' || p_brand AS details, '✓ Feature ' || p_partkey || '|✗ Missing ' || p_partkey AS features,
               'Overlay of ' || p_name || ' here' AS overlays, 'Loose ' || p_type || ' words' AS main
        FROM part""",
    "rendered_boilerplate": """
        SELECT p_partkey AS page_id, 'h' || p_partkey || '.example' AS site, part, text
        FROM (SELECT p_partkey, 'header' AS part, 'Top of ' || p_brand AS text FROM part UNION ALL SELECT p_partkey, 'div', 'Steps ' || p_partkey || ' here' FROM part) WHERE p_partkey % 2 = 0""",
    "rendered_icons": """
        SELECT p_partkey AS page_id, 'Plans' AS heading, CASE WHEN p_partkey % 8 IN (0, 2, 5, 7) THEN '✓ ' ELSE '✗ ' END || CASE WHEN p_partkey % 8 = 6 THEN '✗ ' ELSE '' END || 'Feature ' || p_brand AS text
        FROM part""",
    "rendered_full_text": """
        SELECT p_partkey AS page_id, 'Plans ' || mark || 'Feature ' || p_brand || chr(10) || 'Plans' || chr(10) || mark || 'Feature ' || p_brand
               || CASE WHEN mark = '' THEN '' ELSE chr(10) || 'Feature ' || p_brand END AS full_text
        FROM (SELECT *, CASE WHEN p_partkey % 8 = 6 THEN '✗ ' ELSE '' END AS mark FROM part)""",
    "rendered_forms": f"""
        SELECT c_custkey AS page_id, {_FORM_SITE} AS site, 'button:nth-of-type(1)' AS submit_button, f.pos, CASE f.pos WHEN 0 THEN 'field_' || c_custkey ELSE f.name END AS name, f.type,
               CASE f.pos WHEN 0 THEN 'name,field_' || c_custkey ELSE f.keywords END AS keywords
        FROM customer, (VALUES (0, '', 'text', ''), (1, 'email', 'text', 'email'), (2, 'arrival', 'date', 'check-in,arrival,from,email'), (3, 'segment', 'select', 'segment'), (4, 'kind', 'text', 'kind'), (5, 'kind', 'text', 'kind')) AS f(pos, name, type, keywords)""",
    "rendered_buttons": f"SELECT {_FORM_SITE} AS site, 'Book now ' || c_mktsegment AS text, 'booking' AS action_type, min(c_custkey) AS page_id FROM customer GROUP BY 1, 2",
    "rendered_choices": """
        SELECT c_custkey AS page_id, k.name, k.type, CASE k.name WHEN 'kind' THEN 'a,b' ELSE c_mktsegment END AS options FROM customer, (VALUES ('kind', 'radio'), ('segment', 'select')) AS k(name, type)""",
    "rendered_capabilities": f"""
        SELECT {_FORM_SITE} AS site, k.kind, CASE k.kind WHEN 'form' THEN least(8, count(DISTINCT c_mktsegment)) ELSE max(k.n) END AS n
        FROM customer, (VALUES ('form', 0), ('booking_widget', 1), ('availability', 2)) AS k(kind, n) GROUP BY 1, 2""",
    "rendered_site_map": f"""
        SELECT {_FORM_SITE} AS site_id, CAST(least(50, count(DISTINCT c_mktsegment)) AS INTEGER) AS n_buttons, CAST(least(15, count(*)) AS INTEGER) AS n_forms, 0 AS n_prices
        FROM customer GROUP BY 1""",
    "rendered_portfolio": """
        WITH o AS (SELECT o_orderkey, o_custkey, 'House ' || o_orderkey || ' — ' || (o_orderkey % 300) || ' кв.м.' AS line, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
        SELECT 'c' || o_custkey || '.example' AS site, 'https://c' || o_custkey || '.example/portfolio/' || o_orderkey AS url, md5('Built with ' || (o_orderkey % 300) || ' кв.м of floor') AS content_md5, 6 AS word_count
        FROM o WHERE n < 5
        UNION ALL
        SELECT 'c' || o_custkey || '.example', 'https://c' || o_custkey || '.example/projects-summary', md5('ПРОЕКТИ И ЗАВЪРШЕНИ ОБЕКТИ (' || count(*) || ' бр.):' || chr(10) || string_agg(line, chr(10) ORDER BY o_orderkey)), CAST(count(*) * 5 AS INTEGER)
        FROM o WHERE n >= 5 GROUP BY o_custkey""",
    "rendered_sections": """
        SELECT p_partkey AS page_id, 'g' || (p_partkey % 7) || '.example' AS site, s.heading, s.text FROM part, LATERAL (SELECT * FROM (VALUES
            ('First ' || p_name, 'About the brand ' || p_brand), ('Second', '✓ Brand ' || p_brand || ' ✗ Type ' || p_type || ' ✓ Size ' || p_size)) AS v(heading, text)) AS s
        WHERE p_partkey % 11 <> 0""",
    "rendered_mined_links": """
        SELECT p_partkey AS page_id, s.dst_url, s.source FROM part, LATERAL (SELECT * FROM (VALUES
            ('https://g' || (p_partkey % 7) || '.example/n/' || p_partkey, CASE WHEN len(CAST(p_partkey AS VARCHAR)) >= 6 THEN 'anchor,product' ELSE 'anchor' END),
            ('https://g' || (p_partkey % 7) || '.example/data/' || p_partkey || 'x', 'data'), ('https://g' || (p_partkey % 7) || '.example/click/' || p_partkey, 'data'),
            (CASE WHEN p_size % 6 > 0 THEN 'https://g' || (p_partkey % 7) || '.example/thing/' || p_partkey || '?q=1' END, 'anchor'),
            (CASE WHEN p_size % 6 > 0 THEN 'https://g' || (p_partkey % 7) || '.example/thing/' || p_partkey END, CASE WHEN len(CAST(p_partkey AS VARCHAR)) >= 6 THEN 'card,product' ELSE 'card' END)) AS v(dst_url, source)) AS s
        WHERE p_partkey % 11 <> 0 AND s.dst_url IS NOT NULL""",
    "rendered_page_links": """
        WITH p AS (SELECT *, 'https://g' || (p_partkey % 7) || '.example/' AS host, CAST(p_partkey AS VARCHAR) AS k FROM part WHERE p_partkey % 11 <> 0),
        found AS (
            SELECT *, host || 'n/' || k AS dst_url FROM p UNION ALL SELECT *, host || 'thing/' || k || '?q=1' FROM p WHERE p_size % 6 > 0 UNION ALL SELECT *, host || 'thing/' || k FROM p WHERE p_size % 6 > 0 AND p_partkey % 3 <> 0
            UNION ALL SELECT *, host || 'data/' || k || 'x' FROM p WHERE p_partkey % 3 <> 0 UNION ALL SELECT *, host || 'click/' || k FROM p WHERE p_partkey % 3 <> 0
        ) SELECT p_partkey AS page_id, host || CASE WHEN p_partkey % 3 = 0 THEN 'contact-' ELSE 'g' END || k AS src_url, dst_url FROM found""",
    "rendered_listings": "SELECT p_partkey AS page_id, p_partkey % 11 <> 0 AND p_size % 6 >= 3 AS is_listing FROM part",
    "rendered_dialogs": "SELECT p_partkey AS page_id, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'Dialog about the part ' || p_partkey || ' that is long enough' END AS dialog FROM part",
    "rendered_stats": """
        SELECT 'g' || (p_partkey % 7) || '.example' AS site, count(*) FILTER (p_partkey % 11 <> 0) AS visited, count(*) FILTER (p_partkey % 7 <> 0 OR p_partkey % 11 = 0) AS saved, count(*) FILTER (p_partkey % 11 = 0 OR p_partkey % 7 = 0) AS errors,
               count(*) FILTER (p_partkey % 11 <> 0 AND p_partkey % 7 <> 0) AS general
        FROM part GROUP BY 1""",
    "rendered_price_map": f"""
        SELECT 'm' || (p_partkey % 90) || '.example' AS site_id, CAST(r - 1 AS INTEGER) AS pos, regexp_extract('€' || {_PRICE} || ' ', '€[0-9]+[.][0-9]*') AS text, 'Plan ' || p_partkey AS context
        FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey % 90 ORDER BY p_partkey) AS r FROM part WHERE p_partkey % 3 <> 0) WHERE r <= 30""",
    "rendered_button_groups": """
        SELECT c_custkey AS page_id, k.name, 'button_group' AS type, k.name = 'Segment' AS required, CASE k.name WHEN 'Room' THEN 'Single ' || c_custkey || ',Double' ELSE c_mktsegment || ',Other' END AS options
        FROM customer, (VALUES ('Room'), ('Segment')) AS k(name)""",
    "rendered_schemas": f"""
        SELECT c_custkey AS page_id, {_FORM_SITE} AS site, 'field_' || c_custkey AS first_name, 'Your name *' AS first_label, 'true' AS first_required, c_mktsegment AS segment, 'Book now ' || c_mktsegment AS submit, 'post' AS method FROM customer""",
    "rendered_wizards": """
        SELECT c_custkey AS page_id, 'w' || c_nationkey || '.example' AS site, substr('abc', CAST(c_custkey % 3 AS INTEGER) + 1, 1) || '_' || c_custkey AS first_name, CASE c_custkey % 3 WHEN 2 THEN c_mktsegment END AS option,
               CASE c_custkey % 3 WHEN 0 THEN 'Continue' END AS submit, CASE c_custkey % 3 WHEN 0 THEN CAST(c_nationkey + 2 AS VARCHAR) END AS total_steps,
               CASE c_custkey % 3 WHEN 0 THEN '["Step 1 of ' || (c_nationkey + 2) || '"]' WHEN 1 THEN '["Part ' || c_custkey || '"]' ELSE '[]' END AS step_indicators
        FROM customer WHERE c_custkey % 5 <> 0""",
    "rendered_page_docs": """
        WITH d AS (SELECT p_partkey, p_name, concat_ws(chr(10), '✓ Brand ' || p_brand, '✓ Size ' || p_size, 'First ' || p_name, ' About the brand ' || p_brand, 'Second', ' ✓ Brand ' || p_brand || ' ✗ Type ' || p_type || ' ✓ Size ' || p_size,
                          'Dialog about the part ' || p_partkey || ' that is long enough', 'DIALOG_CONTENT') AS content FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0)
        SELECT p_partkey AS page_id, 'g' || (p_partkey % 7) || '.example' AS site, p_name AS title, 'general' AS page_type, md5(content) AS content_md5, CAST(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) AS INTEGER) AS word_count, 'ok' AS status, false AS partial
        FROM d""",
    "tree_visit_order": f"""
        WITH c AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey), o AS (SELECT c.*, o_orderkey FROM orders JOIN c ON o_custkey = c_custkey),
        p AS (
            SELECT DISTINCT n_regionkey, 0 AS depth, {_REGION} AS url, '' AS via, 0 AS ord FROM nation
            UNION ALL SELECT n_regionkey, 1, {_REGION} || 'n/' || n_nationkey, {_REGION}, n_nationkey FROM nation
            UNION ALL SELECT n_regionkey, 2, {_REGION} || 'c/' || c_custkey, {_REGION} || 'n/' || n_nationkey, c_custkey FROM c
            UNION ALL SELECT n_regionkey, 3, {_REGION} || 'o/' || o_orderkey, {_REGION} || 'c/' || c_custkey, o_orderkey FROM o
        ) SELECT 'region' || n_regionkey || '.example' AS site, CAST(seq AS INTEGER) AS seq, url, depth
        FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY depth, via, ord, url) AS seq FROM p) WHERE seq <= 40""",
    "tree_home_order": f"""
        WITH n AS (SELECT *, {_REGION} AS home, {_REGION} || CASE WHEN n_nationkey % 2 = 1 THEN 'shop/' ELSE 'n/' END || n_nationkey AS page FROM nation),
        p AS (
            SELECT DISTINCT n_regionkey, true AS priority, 0 AS depth, home AS url, '' AS via, 0 AS ord FROM n
            UNION ALL SELECT n_regionkey, n_nationkey % 2 = 1, 1, page, home, n_nationkey FROM n WHERE n_nationkey % 3 > 0
            UNION ALL SELECT n_regionkey, false, 2, home || 'c/' || c_custkey, page, c_custkey FROM n JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey % 3 > 0
        ) SELECT 'region' || n_regionkey || '.example' AS site, CAST(seq AS INTEGER) AS seq, url, depth, priority
        FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY priority DESC, depth, via, ord, url) AS seq FROM p) WHERE seq <= 40""",
    "tree_frontier": f"""
        WITH c AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey), o AS (SELECT c.*, o_orderkey FROM orders JOIN c ON o_custkey = c_custkey),
        p AS (
            SELECT DISTINCT n_regionkey, 0 AS depth, {_REGION} AS url FROM nation
            UNION ALL SELECT n_regionkey, 1, {_REGION} || 'n/' || n_nationkey FROM nation
            UNION ALL SELECT n_regionkey, 2, {_REGION} || 'c/' || c_custkey FROM c
            UNION ALL SELECT n_regionkey, 3, {_REGION} || 'o/' || o_orderkey FROM o
        ) SELECT 'region' || n_regionkey || '.example' AS site, depth, count(*) AS n, min(url) AS first_url FROM p GROUP BY n_regionkey, depth""",
    "tree_next_urls": f"""
        WITH c AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey)
        SELECT 'region' || n_regionkey || '.example' AS site, {_REGION} || 'c/' || c_custkey AS url_key, 2 AS depth FROM c
        UNION ALL SELECT 'region' || n_regionkey || '.example', {_REGION} || 'o/' || o_orderkey, 3 FROM orders JOIN c ON o_custkey = c_custkey""",
    "rendered_selectors": """
        SELECT c_custkey AS page_id, '#f' || c_custkey AS form, '.go' AS submit_button, f.pos, f.name, CASE f.pos WHEN 0 THEN '#u' || c_custkey ELSE f.selector END AS selector,
               CASE f.pos WHEN 0 THEN 'Name ' || c_mktsegment ELSE f.label END AS label
        FROM customer, (VALUES (0, 'who', '', ''), (1, 'mail', '.mail', 'Mail'), (2, 'phone', 'input:nth-of-type(1)', 'Phone'), (3, 'extra', 'input:nth-of-type(2)', ''), (4, 'last', 'input:nth-of-type(3)', '')) AS f(pos, name, selector, label)""",
    "rendered_availability": """
        WITH c AS (SELECT *, 'https://app.cloudbeds.com/w/' || (c_nationkey % 3) AS frame FROM customer)
        SELECT c_custkey AS page_id, 'booking_widget' AS kind, NULL AS ui_type, 'cloudbeds' AS vendor, frame AS src, NULL AS date_name, NULL AS date_label, NULL AS calendar, NULL AS score, NULL AS ready FROM c
        UNION ALL SELECT c_custkey, 'availability', 'iframe_booking_widget', 'cloudbeds', frame, NULL, NULL, NULL, NULL, 'false' FROM c
        UNION ALL SELECT c_custkey, 'availability', NULL, NULL, NULL, 'day_' || c_custkey, 'Day ' || c_custkey, NULL, NULL, NULL FROM c
        UNION ALL SELECT c_custkey, 'availability', NULL, NULL, NULL, NULL, NULL, 'May ' || c_mktsegment, NULL, NULL FROM c
        UNION ALL SELECT c_custkey, 'availability', 'booking_bar', NULL, NULL, NULL, NULL, NULL, '11', 'true' FROM c, range(3)""",
    "rendered_templates": f"""
        WITH t AS (SELECT {_FORM_SITE} AS site, c_nationkey, c_mktsegment, min(c_custkey) AS k FROM customer GROUP BY ALL)
        SELECT site, 'form' AS kind, CAST(rank AS INTEGER) AS rank, 'https://' || site || '/rooms/' || k AS url, 'field_' || k AS first_name
        FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY k) AS rank FROM t) WHERE rank <= 8""",
    "rendered_site_forms": f"""
        SELECT {_FORM_SITE} AS site, c_custkey AS page_id, 'field_' || c_custkey || ',email,arrival,segment,kind,kind' AS names, 'text,text,date,select,text,text' AS types
        FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) WHERE r <= 15""",
    "rendered_salvage": """
        SELECT p_partkey AS page_id, 'g' || (p_partkey % 7) || '.example' AS site, 'general' AS page_type, '' AS content, 0 AS word_count, 'ok' AS status, true AS partial FROM part WHERE p_partkey % 11 = 0""",
    "tree_visited": f"""
        WITH c AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey), many AS (SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY 1),
        p AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY {_REGION} || 'n/' || n_nationkey, c_custkey) AS r FROM c)
        SELECT 'region' || n_regionkey || '.example' AS site, c_custkey AS page_id, {_REGION} || 'c/' || c_custkey AS url_key, CAST(1 + nations + r AS INTEGER) AS seq
        FROM p JOIN many USING (n_regionkey) WHERE r <= 40""",
    "event_recrawls": """
        WITH RECURSIVE e AS (SELECT event_id, lower(event_type) AS url_key, epoch(ts) AS t, row_number() OVER (PARTITION BY lower(event_type) ORDER BY ts, event_id) AS r FROM events),
        run AS (
            SELECT event_id, url_key, t, r, t AS anchor, false AS hit FROM e WHERE r = 1
            UNION ALL
            SELECT e.event_id, e.url_key, e.t, e.r, CASE WHEN e.t - run.anchor >= 120 THEN e.t ELSE run.anchor END, e.t - run.anchor < 120
            FROM run JOIN e ON e.url_key = run.url_key AND e.r = run.r + 1
        ) SELECT event_id, url_key, hit FROM run""",
}
