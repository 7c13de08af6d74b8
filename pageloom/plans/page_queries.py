"""Queries over fetched pages and documents, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions import contacts, fingerprints, lexicon, money, text, urls
from pageloom.functions.regexes import RE2_WS
from pageloom.operators import content, dom, links, sites
from pageloom.sources import io
from pageloom.sources.tables import read_table, spread


def site_page_types(spark, sf_dir):
    """Pages by site and page type."""
    pages = read_table(spark, sf_dir, "pages")
    rows = pages.select(urls.normalize_domain(F.col("url")).alias("site"), urls.page_type(F.col("url"), F.lit("")).alias("page_type"))
    return rows.groupBy("site", "page_type").agg(F.count(F.lit(1)).alias("n_pages"))


def url_columns(spark, sf_dir):
    """Canonical form, key, host, skip and priority flags of every page URL."""
    u = F.col("url")
    pages = read_table(spark, sf_dir, "pages")
    return pages.select(
        "page_id", urls.normalize_url(u).alias("normalized"), urls.url_key(u).alias("url_key"), urls.normalize_domain(u).alias("site"), urls.is_skippable_url(u).alias("skippable"),
        urls.is_priority_url(u).alias("priority"), urls.third_party_class(
            F.when(F.col("page_id") % 3 == 0, "https://www.googletagmanager.com/gtm.js").otherwise(u), F.when(F.col("page_id") % 4 == 0, "image").when(F.col("page_id") % 4 == 1, "document").otherwise("script"), u,
        ).alias("resource_class"),
    )


def url_first_seen(spark, sf_dir):
    """The first page of each URL key, by page_id."""
    from pageloom.operators.offers import first_seen

    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", urls.url_key(F.col("url")).alias("url_key"))
    return first_seen(pages, ["url_key"], ["page_id"])


def text_long_documents(spark, sf_dir):
    """Documents without repeated long lines, by rows of lines."""
    docs = content.strip_long_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.md5("text").alias("strip_md5"))


def text_columns(spark, sf_dir):
    """Cleaned text, word counts and line-deduplicated text of every document."""
    t = F.col("text")
    docs = spread(read_table(spark, sf_dir, "documents"))
    return docs.select(
        "doc_id", F.md5(text.clean(t)).alias("clean_md5"), text.word_count(t).alias("n_words"), F.md5(text.dedupe_lines(t)).alias("dedupe_md5"),
        F.md5(text.strip_footer_dedup(t)).alias("strip_md5"), F.length(text.norm_ws(t)).alias("norm_length"), text.is_challenge_page(F.lit(""), t).alias("challenge"),
    )


def text_contacts(spark, sf_dir):
    """E-mail addresses and phone numbers of every document that has some."""
    docs = spread(read_table(spark, sf_dir, "documents")).select("doc_id", contacts.extract_emails(F.col("text")).alias("e"), contacts.extract_phones(F.col("text")).alias("p"))
    docs = docs.select("doc_id", F.array_join("e", ",").alias("emails"), F.array_join("p", ",").alias("phones"))
    return docs.filter((F.col("emails") != "") | (F.col("phones") != ""))


def button_words(spark, sf_dir):
    """Action class and keywords of every conversation turn taken as a button text."""
    turns = read_table(spark, sf_dir, "conversations")
    t = F.col("text")
    return turns.select("conv_id", "turn", lexicon.action_type(t).alias("action_type"), F.array_join(lexicon.keywords(t), ",").alias("keywords"), lexicon.vendor(t).alias("vendor"), lexicon.field_type(F.col("role"), F.lit("text"), t, F.lit("")).alias("field_type"))


def page_link_table(spark, sf_dir):
    """Every same-origin link of every page."""
    parsed = dom.parse_pages(io.read_pages(spark, f"{sf_dir}/pages.parquet"))
    return links.extract_links(parsed).select("page_id", "site", "dst_url", "dst_key")


def page_nav_links(spark, sf_dir):
    """Navigation links of every page, counted."""
    parsed = dom.parse_pages(io.read_pages(spark, f"{sf_dir}/pages.parquet"))
    return links.extract_nav_links(parsed).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"))


def page_all_links(spark, sf_dir):
    """All discovered links of every page: anchors and, of general pages, mined ones."""
    parsed = dom.parse_pages(io.read_pages(spark, f"{sf_dir}/pages.parquet"))
    return links.page_links(parsed).select("page_id", "site", "dst_url", "dst_key")


def listing_pages(spark, sf_dir):
    """Listing flag of every page."""
    return links.listing_flags(dom.parse_pages(io.read_pages(spark, f"{sf_dir}/pages.parquet")))


def page_titles(spark, sf_dir):
    """Title and number of elements by tag of every page."""
    parsed = dom.parse_pages(io.read_pages(spark, f"{sf_dir}/pages.parquet"))
    count = lambda tag: F.size(dom.select_nodes(lambda n: n["tag"] == tag))
    return parsed.select("page_id", count("a").alias("n_a"), count("li").alias("n_li"), count("h1").alias("n_h1"))


def page_sections(spark, sf_dir):
    """Sections of every page: heading and text."""
    return content.extract_sections(dom.parse_pages(io.read_pages(spark, f"{sf_dir}/pages.parquet")))


def page_docs(spark, sf_dir):
    """The kept page rows."""
    return content.page_docs(dom.parse_pages(io.read_pages(spark, f"{sf_dir}/pages.parquet")))


def page_contacts(spark, sf_dir):
    """Contacts of every page."""
    rows = content.page_contacts(dom.parse_pages(io.read_pages(spark, f"{sf_dir}/pages.parquet")))
    return rows.select("page_id", "site", F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"))


def site_stats(spark, sf_dir):
    """Visited pages of each site, by type."""
    parsed = dom.parse_pages(io.read_pages(spark, f"{sf_dir}/pages.parquet"))
    stats = sites.crawl_stats(parsed, parsed)
    return stats.select("site", "visited", "saved", "errors", F.size("by_type").alias("n_types"))


def json_fingerprints(spark, sf_dir):
    """Fingerprint and template fingerprint of the events' JSON."""
    events = read_table(spark, sf_dir, "events")
    return events.select("event_id", fingerprints.stable_json(F.col("props")).alias("stable"), fingerprints.fingerprint(F.col("event_type"), F.col("props")).alias("fingerprint"), fingerprints.template_fingerprint(F.col("event_type"), F.col("props")).alias("template"))


def payload_budget(spark, sf_dir):
    """Turns as payloads of their conversation: commercial ones, joined up to the budget."""
    turns = read_table(spark, sf_dir, "conversations")
    pages = turns.select(F.col("conv_id").alias("page_id"), F.concat(F.lit("https://www.conv"), F.col("conv_id").cast("string"), F.lit(".example/")).alias("url")).distinct()
    payloads = turns.select(
        F.col("conv_id").alias("page_id"), F.col("turn").alias("seq"), F.concat(F.lit("https://api.conv"), F.col("conv_id").cast("string"), F.lit(".example/v1")).alias("resp_url"), F.lit("application/json").alias("content_type"), F.lit(0).alias("content_length"),
        F.concat(F.lit("price "), F.repeat("text", F.lit(400))).alias("body"),
    )
    mined = content.mine_payloads(payloads, pages)
    return mined.select("page_id", F.length("payload_text").alias("length"), F.md5("payload_text").alias("md5"))


def request_lines(spark, sf_dir):
    """The events as request lines: accepted with a canonical URL, or rejected with a reason."""
    events = read_table(spark, sf_dir, "events")
    k = F.col("event_id").cast("string")
    line = (
        F.when(F.col("event_id") % 5 == 0, F.lit("not json"))
        .when(F.col("event_id") % 5 == 1, F.lit("[1, 2]"))
        .when(F.col("event_id") % 5 == 2, F.lit('{"site_id": "s"}'))
        .otherwise(F.concat(F.lit('{"url": "HTTPS://www.Site'), k, F.lit('.example/A/?q=1#f", "site_id": "s'), k, F.lit('", "deadline_ms": 9000}')))
    )
    rows = io.split_requests(events.select(line.alias("value"))).withColumn("deadline_ms", F.col("deadline_ms").cast("string"))
    return rows.groupBy("url", "site_id", "deadline_ms", "reason").agg(F.count(F.lit(1)).alias("n"))


def latest_orders(spark, sf_dir):
    """Upsert: the latest order of each customer over two halves of the table."""
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site_id"), F.col("o_orderkey").alias("order_key"), F.col("o_orderdate").alias("ordered"))
    orders = orders.withColumn("at", F.struct("ordered", "order_key"))
    return io.upsert_site_map(orders.filter("order_key % 2 = 0"), orders.filter("order_key % 2 = 1"), at="at").drop("at")


def price_texts(spark, sf_dir):
    """Money columns of texts that state each part's price."""
    part = read_table(spark, sf_dir, "part")
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    t = F.concat(F.lit("Only €"), price, F.when(F.col("p_partkey") % 3 == 0, " per month").when(F.col("p_partkey") % 3 == 1, " per year").otherwise(""), F.lit(" or "), F.col("p_size").cast("string"), F.lit(" EUR"))
    return part.select("p_partkey", F.array_join(money.price_mentions(t), "|").alias("mentions"), money.money_match(t).alias("money"), money.billing_period(t).alias("period"), money.split_spec(F.concat(F.lit("Brand: "), "p_brand"))["value"].alias("brand"))


def price_or_request(spark, sf_dir):
    """The price that a text states, or that it is on request, or nothing."""
    part = read_table(spark, sf_dir, "part")
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    t = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("From €"), price, F.lit(", or price on request"))).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(": price on request"))).otherwise(F.col("p_name"))
    return part.select("p_partkey", money.price_text_or_on_request(t).alias("price_text"))


QUERIES = {
    f.__name__: f
    for f in (
        site_page_types, url_columns, url_first_seen, text_long_documents, text_columns, text_contacts, button_words, page_link_table, page_nav_links, page_all_links, listing_pages, page_titles, page_sections, page_docs,
        page_contacts, site_stats, json_fingerprints, payload_budget, request_lines, latest_orders, price_texts, price_or_request,
    )
}

_SQL_PARTS = r"(?is)^([A-Za-z][A-Za-z0-9+.-]*):[/\\]*(?:[^/\\?#@]*@)?([^/\\?#:]+)(?::([0-9]*))?([^?#]*)"


def _group(k: int, column: str = "url") -> str:
    return f"regexp_extract({column}, '{_SQL_PARTS}', {k})"


_HOST = f"regexp_replace(lower({_group(2)}), '^www\\.', '')"
_PATH = f"CASE WHEN {_group(4)} = '' THEN '/' ELSE {_group(4)} END"
_KEY = f"lower('https://' || {_HOST} || CASE WHEN {_PATH} = '/' THEN '/' ELSE regexp_replace({_PATH}, '/$', '') END)"
_SKIP = urls.SKIP.replace(r"\z", "$")


def _type_sql(u: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower({u}) || ' ', '(?i){pattern}') THEN '{kind}'" for kind, pattern, _ in urls.PAGE_TYPES)
    return f"CASE {cases} WHEN regexp_matches({u}, '(?i){urls.PRODUCT_DETAIL}') THEN 'product_detail' ELSE 'general' END"


def _trim_sql(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '^{RE2_WS}+', ''), '{RE2_WS}+$', '')"


def _clean_sql(t: str) -> str:
    return _trim_sql(f"regexp_replace(regexp_replace(replace({t}, chr(13), ''), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


_LINES = "string_split(text, chr(10))"
_HREFS = r"unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"#]*)', 1))"
_LINK_ROWS = f"""SELECT page_id, {_HOST} AS site, lower({_group(1)}) || '://' || lower({_group(2)}) || href AS dst_url
        FROM (SELECT page_id, url, {_HREFS} AS href FROM pages) WHERE href LIKE '/%'"""


def _contains_chain(column: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({column}, '{k}') THEN '{v}'" for k, v in rules) + f" ELSE '{default}' END"


_LOW = _trim_sql("lower(text)")
_WORDS = "list_filter(string_split_regex(low, '" + RE2_WS + "+'), lambda w: len(w) > 2)"
_MAPPED = " || ".join("CASE WHEN contains(low, '" + k + "') THEN [" + ", ".join(f"'{v}'" for v in vs) + "] ELSE [] END" for k, vs in lexicon.KEYWORDS)
_FIRST = lambda a: f"list_filter({a}, lambda x, i: list_position({a}, x) = i)"

ORACLE = {
    "site_page_types": f"SELECT {_HOST} AS site, {_type_sql('url')} AS page_type, count(*) AS n_pages FROM pages GROUP BY 1, 2",
    "url_columns": f"""
        SELECT page_id, lower({_group(1)}) || '://' || {_HOST} || {_PATH} AS normalized, {_KEY} AS url_key, {_HOST} AS site,
               regexp_matches(url, '(?i){_SKIP}') AS skippable, regexp_matches(url, '(?i){urls.PRIORITY}') AS priority, CASE WHEN page_id % 4 = 0 THEN 'textless' WHEN page_id % 3 = 0 THEN 'third_party' WHEN page_id % 4 = 1 THEN 'own_document' ELSE 'kept' END AS resource_class
        FROM pages""",
    "url_first_seen": f"SELECT min(page_id) AS page_id, arg_min(url, page_id) AS url, {_KEY} AS url_key FROM pages GROUP BY 3",
    "text_long_documents": f"""
        WITH l AS (SELECT doc_id, {_LINES} AS lines FROM documents), k AS (SELECT *, list_transform(lines, lambda x: {_trim_sql('x')}) AS keys FROM l)
        SELECT doc_id, md5(array_to_string(list_filter(lines, lambda x, i: len(keys[i]) < 40 OR list_position(keys, keys[i]) = i), chr(10))) AS strip_md5 FROM k""",
    "text_columns": f"""
        WITH l AS (SELECT doc_id, text, {_LINES} AS lines, list_filter(string_split_regex(text, '\\n+'), lambda x: x <> '') AS filled FROM documents),
        k AS (SELECT *, list_transform(lines, lambda x: {_trim_sql('x')}) AS keys FROM l)
        SELECT doc_id, md5({_clean_sql('text')}) AS clean_md5,
               CAST(len(list_filter(string_split_regex(text, '{RE2_WS}+'), lambda x: x <> '')) AS INTEGER) AS n_words,
               md5({_clean_sql("array_to_string(" + _FIRST('filled') + ", chr(10))")}) AS dedupe_md5,
               md5(array_to_string(list_filter(lines, lambda x, i: len(keys[i]) < 40 OR list_position(keys, keys[i]) = i), chr(10))) AS strip_md5,
               CAST(len({_trim_sql("regexp_replace(text, '" + RE2_WS + "+', ' ', 'g')")}) AS INTEGER) AS norm_length,
               {' OR '.join(f"contains(lower(text[1:600]), '{c}')" for c in text.CHALLENGES)} AS challenge
        FROM k""",
    "page_link_table": f"""
        SELECT DISTINCT page_id, site, dst_url, lower(regexp_replace(regexp_replace(regexp_replace(dst_url, '^https?://(www\\.)?', 'https://'), '\\?.*', ''), '([^/])/$', '\\1')) AS dst_key
        FROM ({_LINK_ROWS})""",
    "page_all_links": f"""
        SELECT DISTINCT page_id, site, dst_url, lower(regexp_replace(regexp_replace(regexp_replace(dst_url, '^https?://(www\\.)?', 'https://'), '\\?.*', ''), '([^/])/$', '\\1')) AS dst_key
        FROM ({_LINK_ROWS})""",
    "page_nav_links": f"SELECT page_id, count(DISTINCT dst_url) AS n_links FROM ({_LINK_ROWS}) GROUP BY page_id",
    "page_titles": """
        SELECT page_id, CAST(len(regexp_extract_all(html, '<a[ >]')) AS INTEGER) AS n_a, CAST(len(regexp_extract_all(html, '<li[ >]')) AS INTEGER) AS n_li, CAST(len(regexp_extract_all(html, '<h1[ >]')) AS INTEGER) AS n_h1
        FROM pages""",
    "site_stats": f"""
        SELECT site, count(*) AS visited, count(*) AS saved, CAST(0 AS BIGINT) AS errors, CAST(count(DISTINCT page_type) AS INTEGER) AS n_types
        FROM (SELECT {_HOST} AS site, {_type_sql('url')} AS page_type FROM pages) GROUP BY site""",
    "text_contacts": f"""
        WITH raw AS (
            SELECT doc_id, list_slice({_FIRST("regexp_extract_all(text, '" + contacts.EMAIL + "')")}, 1, 20) AS e,
                   regexp_extract_all(text, '(\\+?[0-9](?:[0-9().\\/\\-]|{RE2_WS}){{4,}}[0-9])', 1) AS c
            FROM documents
        ), digits AS (
            SELECT doc_id, e, list_transform(list_filter(c, lambda x: NOT regexp_matches(x, '\\b[0-9]{{1,2}}\\.[0-9]{{1,2}}\\.[0-9]{{4}}\\b') AND len(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 7 AND 15),
                   lambda x: CASE WHEN starts_with(x, '+') THEN '+' ELSE '' END || regexp_replace(x, '[^0-9]', '', 'g')) AS p
            FROM raw
        )
        SELECT doc_id, array_to_string(e, ',') AS emails, array_to_string(list_slice({_FIRST('p')}, 1, 20), ',') AS phones
        FROM digits WHERE len(e) > 0 OR len(p) > 0""",
    "button_words": f"""
        WITH t AS (SELECT conv_id, turn, role, text, {_LOW} AS low FROM conversations),
        w AS (SELECT *, list_filter([low] || {_WORDS} || {_MAPPED}, lambda k: len(k) > 1) AS every FROM t)
        SELECT conv_id, turn,
               CASE {' '.join(f"WHEN regexp_matches(lower(text), '(?i){p}') THEN '{k}'" for k, p in lexicon.ACTIONS)} ELSE 'other' END AS action_type,
               array_to_string({_FIRST('every')}, ',') AS keywords, {_contains_chain('lower(text)', lexicon.VENDORS, 'unknown')} AS vendor,
               CASE WHEN regexp_matches(lower(role || ' text ' || text || ' '), 'date|дата') THEN 'date'
                    WHEN regexp_matches(lower(role || ' text ' || text || ' '), 'guest|човек|брой|count|number') THEN 'number' ELSE 'text' END AS field_type
        FROM w""",
    "json_fingerprints": """
        SELECT event_id, replace(props, ' ', '') AS stable, sha256('{"kind":"' || event_type || '","schema":' || replace(props, ' ', '') || '}') AS fingerprint,
               sha256(event_type || '|' || replace(props, ' ', '')) AS template
        FROM events""",
    "payload_budget": f"""
        WITH b AS (SELECT conv_id, turn, substr('price ' || repeat(text, 400), 1, {content.PAYLOAD_ONE}) AS body FROM conversations WHERE text IS NOT NULL),
        s AS (SELECT *, coalesce(sum(len(body)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
        SELECT conv_id AS page_id, CAST(len(string_agg(body, chr(10) ORDER BY turn)) AS INTEGER) AS length, md5(string_agg(body, chr(10) ORDER BY turn)) AS md5
        FROM s WHERE before < {content.PAYLOAD_ALL} GROUP BY conv_id""",
    "request_lines": """
        SELECT CASE WHEN event_id % 5 IN (3, 4) THEN 'https://site' || event_id || '.example/A/' END AS url, CASE WHEN event_id % 5 IN (3, 4) THEN 's' || event_id END AS site_id,
               CASE WHEN event_id % 5 IN (3, 4) THEN '9000' END AS deadline_ms,
               CASE event_id % 5 WHEN 0 THEN 'not_json' WHEN 1 THEN 'not_an_object' WHEN 2 THEN 'no_url' END AS reason, count(*) AS n
        FROM events GROUP BY 1, 2, 3, 4""",
    "latest_orders": "SELECT o_custkey AS site_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS order_key, max(o_orderdate) AS ordered FROM orders GROUP BY o_custkey",
    "price_or_request": """
        SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '€' || CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) WHEN 1 THEN 'On request' ELSE '' END AS price_text
        FROM part""",
    "price_texts": """
        WITH p AS (SELECT *, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price FROM part),
        q AS (SELECT *, '€' || price AS shown FROM p)
        SELECT p_partkey, regexp_extract(shown, '€[0-9]+[.][0-9]*') || '|' || p_size || ' EUR' AS mentions, shown || CASE p_partkey % 3 WHEN 2 THEN '' ELSE '' END AS money,
               CASE p_partkey % 3 WHEN 0 THEN 'monthly' WHEN 1 THEN 'yearly' END AS period, p_brand AS brand
        FROM q""",
}
