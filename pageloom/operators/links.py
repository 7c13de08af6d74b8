"""Link tables of pages: all, navigation and mined links, and the listing flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import urls
from pageloom.operators import dom

DATA_URLS = ("data-href", "data-url", "data-link", "data-path", "data-navigate", "data-route")
#: Paths of product pages, and deep paths that end in a slug. Fixed values.
PRODUCT_PATH = r"/(prodaj|proekt|id-|car|auto|vehicle|propert|hotel|offer|listing|detail|item|product)"
DEEP_SLUG = r"/[^/]+/[a-z0-9][a-z0-9-]{5,}"
ONCLICK = r"(?:location\.href|window\.location(?:\.href)?)\s*=\s*['\"]([^'\"]+)['\"]"
CARDS = ("card", "item-wrap", "product-item", "vehicle", "listing-item")
LISTING_CLASSES = ("card", "item", "product", "listing", "result", "vehicle", "propert", "hotel", "offer", "avto", "kola", "auto", "catalog")


def _anchor(n: Column) -> Column:
    return dom.tagged(n, "a") & dom.has_attr(n, "href")


def _links(pages_dom: DataFrame, hrefs: Column, source: str, base: Column | None = None) -> DataFrame:
    """Distinct same-origin links of the hrefs (struct ord, href) of each page."""
    base = F.col("url") if base is None else base
    found = pages_dom.select("page_id", "site", "url", "base_origin", F.explode(hrefs).alias("h"))
    rows = found.select("page_id", "site", F.col("url").alias("src_url"), F.col("h.ord").alias("ord"), F.col("h.href").alias("href"), urls.resolve_href(F.col("h.href"), base).alias("dst_url"))
    rows = rows.filter(F.col("dst_url").isNotNull())
    first = rows.groupBy("page_id", "site", "src_url", "dst_url").agg(F.min(F.struct("ord", "href")).alias("f"))
    return first.select("page_id", "site", "src_url", F.col("f.ord").alias("ord"), F.col("f.href").alias("href"), "dst_url", urls.url_key(F.col("dst_url")).alias("dst_key"), F.lit(source).alias("source"))


def _hrefs(test) -> Column:
    return F.transform(dom.select_nodes(test), lambda n: F.struct(n["nid"].alias("ord"), dom.attr(n, "href").alias("href")))


def extract_links(pages_dom: DataFrame) -> DataFrame:
    """Every same-origin anchor; the query stays, the fragment goes."""
    return _links(pages_dom, _hrefs(_anchor), "all")


def extract_nav_links(pages_dom: DataFrame) -> DataFrame:
    """Anchors within header, nav, footer, a navigation role, or a nav or menu class or id."""
    test = lambda m: dom.tagged(m, "header", "nav", "footer") | (dom.attr(m, "role") == "navigation") | dom.cls_has(m, "nav", "menu") | dom.id_has(m, "nav", "menu")
    return _links(pages_dom, _hrefs(lambda n: _anchor(n) & dom.inside(n, test)), "nav")


def _found(pages_dom: DataFrame, general: Column) -> DataFrame:
    """(page_id, site, src_url, ord, href, dst_url, dst_key, source) of all anchors, and of pages that are ``general`` of the mined links; one pass over the page.

    Mined are anchors with a path, data attributes and onclick locations, product-like paths and anchors in cards; the last three lose their query.
    """
    in_card = lambda n: dom.inside(n, lambda m: dom.cls_has(m, *CARDS) | dom.tagged(m, "article"))
    entry = lambda ord_, href, data, card: F.struct(ord_.alias("ord"), href.alias("href"), data.alias("data"), card.alias("card"))
    anchors = F.transform(dom.select_nodes(_anchor), lambda n: entry(n["nid"], dom.attr(n, "href"), F.lit(False), F.when(general, in_card(n)).otherwise(False)))
    attributes = F.flatten(F.transform(F.col("nodes"), lambda n: F.array(*[entry(n["nid"], dom.attr(n, a), F.lit(True), F.lit(False)) for a in DATA_URLS], entry(n["nid"], F.regexp_extract(dom.attr(n, "onclick"), ONCLICK, 1), F.lit(True), F.lit(False)))))
    attributes = F.filter(attributes, lambda x: (x["href"] != "") & ~x["href"].rlike("^(?:javascript|mailto):"))
    rows = pages_dom.select("page_id", "site", "url", "base_origin", general.alias("general"), F.explode(F.when(general, F.concat(anchors, attributes)).otherwise(anchors)).alias("h"))
    rows = rows.select("page_id", "site", F.col("url").alias("src_url"), "general", "h.*", urls.resolve_href(F.col("h.href"), F.when(F.col("h.data"), F.col("base_origin")).otherwise(F.col("url"))).alias("whole"))
    bare = urls.path(F.col("whole"))
    cut = F.regexp_replace("whole", r"\?.*", "")
    kind = lambda name, url, test: F.when(test, F.struct(F.lit(name).alias("source"), url.alias("dst_url")))
    plain, mined = ~F.col("data"), F.col("general")
    kinds = F.array(
        kind("all", F.col("whole"), plain),
        kind("anchor", F.col("whole"), mined & plain & (F.length(bare) > 1)),
        kind("data", cut, mined & F.col("data") & (F.length(bare) > 2) & ~bare.endswith("/")),
        kind("product", cut, mined & plain & (dom.like(bare, PRODUCT_PATH) | dom.like(bare, DEEP_SLUG))),
        kind("card", cut, mined & F.col("card") & (F.length(bare) > 2)),
    )
    rows = rows.filter(F.col("whole").isNotNull()).select("page_id", "site", "src_url", "ord", "href", urls.url_key(F.col("whole")).alias("dst_key"), F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("k"))
    return rows.select("page_id", "site", "src_url", "ord", "href", "k.dst_url", "dst_key", "k.source")


def mine_links(pages_dom: DataFrame) -> DataFrame:
    """Links beyond plain anchors: data attributes, onclick locations, product-like paths, cards."""
    found = _found(pages_dom, F.lit(True)).filter("source <> 'all'")
    return found.groupBy("page_id", "site", "src_url", "dst_url", "dst_key").agg(F.min("ord").alias("ord"), F.min_by("href", "ord").alias("href"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("source"))


def listing_flags(pages_dom: DataFrame) -> DataFrame:
    """(page_id, is_listing): three or more card-like elements of a kind, or five deep links."""
    many = F.lit(False)
    holds = lambda c: lambda n: dom.cls_has(n, c)  # noqa: E731  a second parameter would be taken for the element's index
    for c in LISTING_CLASSES:
        many = many | (F.size(dom.select_nodes(holds(c))) >= 3)
    many = many | (F.size(dom.select_nodes(lambda n: dom.tagged(n, "article"))) >= 3)
    parent = lambda n: F.get(F.col("nodes"), n["pid"])
    many = many | (F.size(dom.select_nodes(lambda n: F.coalesce(dom.cls_has(parent(n), "grid"), F.lit(False)))) >= 3)
    many = many | (F.size(dom.select_nodes(lambda n: dom.cls_has(n, "col") & F.coalesce(dom.cls_has(parent(n), "row"), F.lit(False)))) >= 3)
    resolved = F.transform(dom.select_nodes(_anchor), lambda n: urls.resolve_href(dom.attr(n, "href"), F.col("url")))
    deep = F.filter(resolved, lambda u: u.isNotNull() & (F.size(F.split(urls.path(u), "/")) >= 3) & (F.length(urls.path(u)) > 20))
    return pages_dom.select("page_id", "site", "url", (many | (F.size(deep) >= 5)).alias("is_listing"))


def page_links(pages_dom: DataFrame) -> DataFrame:
    """All links of each page; of general pages the mined ones too. Distinct by (page, URL)."""
    found = _found(pages_dom, urls.page_type(F.col("url"), F.col("title")) == "general")
    return found.groupBy("page_id", "site", "src_url", "dst_url", "dst_key").agg(F.min("ord").alias("ord"))
