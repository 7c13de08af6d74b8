"""Readable text of pages: sections, details, overlays, dialogs, main text, contacts, assembled page rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions import contacts, money, text, urls
from pageloom.functions.binding import let
from pageloom.functions.regexes import norm_ws, trim_ws
from pageloom.operators import dom

MIN_WORDS = 20
#: Parts of class and id names. Fixed values.
OVERLAYS = ("overlay", "modal", "popup", "tooltip", "banner", "notification", "alert")
BOILERPLATE_CLASSES = ("cookie", "gdpr", "consent", "banner")
CONTACT_WORDS = ("contact", "kontakt", "phone", "tel", "sidebar", "info")
FULL_TEXT_URL = "pricing|price|service|product|plan|package|tariff|shop|store|catalog"
FEATURE_CONTEXT = "pricing|feature|package|plan|pricelist|price-list|includ|benefit|amenit|checklist|spec|detail|what.*includ|пакет|цен|включ|характеристик"
NOT_FEATURE_CONTEXT = "testimonial|review|client|footer|header|nav|menu|hero|banner|cta|contact|faq|accordion"
PAYLOAD_WORDS = r"price|cost|amount|rate|tariff|subscription|monthly|annual|€|£|\$|¥|₹|currency|checkout|cart|product|service|plan|package|offer|catalog"
PAYLOAD_ONE, PAYLOAD_ALL = 100_000, 400_000


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def is_boilerplate(n: Column) -> Column:
    """Within nav, footer, header, a navigation role or a consent banner."""
    return dom.within(n, lambda m: dom.tagged(m, "nav", "footer", "header") | (dom.attr(m, "role") == "navigation") | dom.cls_has(m, *BOILERPLATE_CLASSES) | dom.id_has(m, "cookie", "gdpr"))


def in_feature_context(n: Column) -> Column:
    """Of the element and ten ancestors, the first that is of a known kind is a pricing or feature part."""
    words = lambda m: F.lower(F.concat_ws(" ", m["cls"], m["id"], m["tag"]))
    kind = lambda m: F.when(m["tag"] == "body", False).when(dom.like(words(m), FEATURE_CONTEXT), True).when(dom.like(words(m), NOT_FEATURE_CONTEXT), False)
    kinds = F.transform(F.concat(F.array(n), dom.ancestors(n, 9)), kind)
    return F.coalesce(dom.first_of(F.filter(kinds, lambda k: k.isNotNull())), F.lit(False))


@F.arrow_udf(T.StructType([T.StructField("kept", T.ArrayType(T.IntegerType())), T.StructField("free", T.ArrayType(T.BooleanType()))]))
def _emission(nids, lasts, fits, order, repeats, ends):
    """Which candidates are emitted, and which elements neither hold nor lie in one, of every page.

    In document order a candidate is emitted if it fits, no emitted one has its text, and it begins after the last
    emitted element ends. ``order`` sorts candidates by text, and ``repeats`` tells in that order whether the text
    is that before it. One pass over the candidates and one over the elements of a page.
    """
    import numpy as np
    import pyarrow as pa

    def rows(array):
        # numpy views of the rows of a list array
        flat, starts = array.values.to_numpy(zero_copy_only=False), array.offsets.to_numpy()
        return [flat[i:j] for i, j in zip(starts[:-1], starts[1:], strict=True)]

    kept, free = [], []
    for nid, last, fit, by_text, again, end in zip(*map(rows, (nids, lasts, fits, order, repeats, ends)), strict=True):
        text = np.empty(len(nid), np.int64)
        text[by_text] = np.cumsum(~again.astype(bool))
        seen, out, until = set(), [], -1
        for k, (start, stop, ok, t) in enumerate(zip(nid.tolist(), last.tolist(), fit.tolist(), text.tolist(), strict=True)):
            if ok and start > until and t not in seen:
                out.append(k)
                seen.add(t)
                until = stop
        starts = np.zeros(len(end) + 1, np.int64)
        open_, shut = np.zeros(len(end) + 1, np.int64), np.zeros(len(end) + 1, np.int64)
        starts[nid[out] + 1] += 1
        open_[nid[out]] += 1
        shut[last[out] + 1] += 1
        before = np.cumsum(starts)
        covered = np.cumsum(open_ - shut)[:-1] > 0
        kept.append(np.array(out, np.int32))
        free.append((before[end + 1] == before[:-1]) & ~covered)
    return pa.StructArray.from_arrays([pa.array(kept, pa.list_(pa.int32())), pa.array(free, pa.list_(pa.bool_()))], names=["kept", "free"])


#: Not marked as deterministic, though it is, so that the planner neither repeats it nor moves it into a lambda.
_emission = _emission.asNondeterministic()


def section_parts(pages_dom: DataFrame) -> DataFrame:
    """``pages_dom`` with ``parts`` and ``free``.

    Parts are headings, paragraphs and list items that carry content, each text once and none within another; ``free``
    tells of every element whether it neither holds a part nor lies in one. Equal texts are found by sorting.
    """
    wanted = lambda n: dom.tagged(n, "h1", "h2", "h3", "p", "li") & ~n["hidden"] & ~dom.inside(n, lambda m: m["tag"] == "details") & ~is_boilerplate(n)

    def row(n: Column) -> Column:
        plain = trim_ws(dom.raw_text(n))
        marked = F.when((n["tag"] == "li") & in_feature_context(n), money.with_mark(icon_status_of(n), plain)).otherwise(plain)
        return F.struct(n["nid"].alias("nid"), n["last"].alias("last"), n["tag"].alias("tag"), marked.alias("text"))

    found = pages_dom.withColumn("_found", F.transform(dom.select_nodes(wanted), row))
    found = found.withColumn("_sorted", F.sort_array(F.transform("_found", lambda x, k: F.struct(x["text"].alias("text"), k.alias("k")))))
    repeats = F.transform("_sorted", lambda x, k: F.coalesce(F.get(F.col("_sorted"), k - 1)["text"] == x["text"], F.lit(False)))
    each = lambda name: F.transform("_found", lambda x: x[name])
    fits = F.transform("_found", lambda x: F.length(x["text"]) >= 5)
    emitted = _emission(each("nid"), each("last"), fits, F.transform("_sorted", lambda x: x["k"]), repeats, F.transform("nodes", lambda n: n["last"]))
    part = lambda k: let(F.get(F.col("_found"), k), lambda x: F.struct(x["nid"].alias("nid"), x["tag"].alias("tag"), x["text"].alias("text")))
    found = found.withColumn("_emitted", emitted)
    return found.withColumns({"parts": F.transform("_emitted.kept", part), "free": F.col("_emitted.free")}).drop("_found", "_sorted", "_emitted")


def icon_status_of(n: Column) -> Column:
    """Status by the first svg, font icon or image below an element, else by a leading mark of its text."""
    def svg(m: Column) -> Column:
        parent = F.get(F.col("nodes"), m["pid"])
        hints = F.concat_ws(" ", dom.attr(m, "aria-label"), dom.attr(m, "data-icon"), dom.attr(m, "data-lucide"), dom.attr(m, "name"))
        href = F.array_join(F.transform(F.filter(dom.below(m), lambda u: u["tag"] == "use"), lambda u: F.concat_ws(" ", dom.attr(u, "href"), dom.attr(u, "xlink:href"))), " ")
        return money.icon_status(m["cls"], parent["cls"], hints, href)

    def image(m: Column) -> Column:
        names = ("alt", "title", "aria-label", "class", "src", "data-src", "data-lazy-src", "srcset")
        return money.image_status(F.concat_ws(" ", *[dom.attr(m, a) for a in names], F.get(F.col("nodes"), m["pid"])["cls"]))

    font = lambda m: money.font_status(m["cls"], m["own"])
    is_font = lambda m: (m["tag"] == "i") | ((m["tag"].isin("span", "em")) & dom.cls_has(m, "icon", "fa-"))
    found = lambda test, status: dom.first_of(F.filter(F.transform(F.filter(dom.below(n), test), status), lambda s: s.isNotNull()))
    return F.coalesce(found(lambda m: m["tag"] == "svg", svg), found(is_font, font), found(lambda m: m["tag"] == "img", image), money.mark_status(dom.text_of(n)))


def extract_sections(pages_dom: DataFrame) -> DataFrame:
    """(page_id, site, ord, heading, text): text goes to the last heading before it; text before any heading is dropped."""
    rows = section_parts(pages_dom).select("page_id", "site", F.explode("parts").alias("p"))
    rows = rows.select("page_id", "site", F.col("p.nid").alias("ord"), F.col("p.tag").alias("tag"), F.col("p.text").alias("t"))
    upto = Window.partitionBy("page_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_head = F.col("tag").startswith("h")
    rows = rows.withColumn("head", F.last(F.when(is_head, F.struct("ord", "t")), ignorenulls=True).over(upto)).filter(F.col("head").isNotNull())
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~is_head, F.struct("ord", "t")))), lambda x: x["t"]), " ")
    return rows.groupBy("page_id", "site", F.col("head.ord").alias("ord"), F.col("head.t").alias("heading")).agg(texts.alias("text"))


def _sections_text(parts: Column) -> Column:
    """Sections as heading, line break, texts; blank line between."""
    built = F.aggregate(
        parts,
        F.lit(None).cast("string"),
        lambda s, p: F.when(p["tag"].startswith("h"), F.concat(F.coalesce(F.concat(s, F.lit("\n\n")), F.lit("")), p["text"], F.lit("\n"))).when(s.isNotNull(), F.concat(s, F.lit(" "), p["text"])).otherwise(s),
    )
    return F.coalesce(built, F.lit(""))


def _table_rows(t: Column) -> Column:
    cells = lambda r: F.filter(F.transform(F.filter(dom.below(r), lambda c: c["tag"].isin("td", "th")), dom.text_of), lambda x: x != "")
    rows = F.transform(F.filter(dom.below(t), lambda r: r["tag"] == "tr"), lambda r: F.array_join(cells(r), " | "))
    return F.array_join(F.filter(rows, lambda x: x != ""), "\n")


def details_texts() -> Column:
    """Text of each details element: summary, tables as rows, the rest; distinct, of five or more characters."""

    def rest(c: Column) -> Column:
        tables = F.filter(F.transform(F.filter(dom.below(c), lambda t: t["tag"] == "table"), _table_rows), lambda x: x != "")
        direct = F.exists(dom.children(c), lambda t: t["tag"] == "table")
        others = F.array_join(F.concat(F.array(c["own"]), F.transform(F.filter(dom.children(c), lambda t: t["tag"] != "table"), dom.raw_text)), " ")
        return F.concat(tables, F.array(F.when(direct, norm_ws(others)).otherwise(dom.text_of(c))))

    def whole(d: Column) -> Column:
        summary = F.transform(F.filter(dom.children(d), lambda c: c["tag"] == "summary"), dom.text_of)
        body = F.flatten(F.transform(F.filter(dom.children(d), lambda c: c["tag"] != "summary"), rest))
        return F.array_join(F.filter(F.concat(F.slice(summary, 1, 1), body), lambda x: x != ""), "\n")

    return F.array_distinct(F.filter(F.transform(dom.select_nodes(lambda n: n["tag"] == "details"), whole), lambda x: F.length(x) >= 5))


def icon_feature_texts() -> Column:
    """Short marked texts beside status icons in pricing and feature parts."""

    def row(icon: Column) -> Column:
        near = F.filter(F.transform(dom.ancestors(icon, 4), lambda a: F.when(a["tag"] != "body", a)), lambda a: a.isNotNull())
        fits = F.filter(F.transform(near, lambda a: F.struct(a["nid"].alias("nid"), dom.text_of(a).alias("t"), icon_status_of(a).alias("s"))), lambda x: F.length(x["t"]).between(5, 150))
        return let(dom.first_of(fits), lambda x: F.when(x["s"].isNotNull() & ~dom.like(x["t"], "^(?:поръчай|купи|свържи|изпрати|научи|виж|изберете|started|buy|order|contact|submit|learn|view|select)"), F.struct(x["nid"].alias("nid"), F.concat(F.when(x["s"] == "included", "✓ ").otherwise("✗ "), x["t"]).alias("t"))))

    icons = dom.select_nodes(lambda n: n["tag"].isin("svg", "img") & ~is_boilerplate(n) & in_feature_context(n))
    return F.array_distinct(F.transform(F.filter(F.transform(icons, row), lambda x: x.isNotNull()), lambda x: x["t"]))


def overlay_texts() -> Column:
    """Distinct texts of overlay-like elements, of ten or more characters."""
    test = lambda n: (dom.cls_has(n, *OVERLAYS) | dom.attr(n, "role").isin("dialog", "alertdialog")) & ~n["hidden"]
    return F.array_distinct(F.filter(F.transform(dom.select_nodes(test), lambda n: trim_ws(dom.raw_text(n))), lambda x: F.length(x) >= 10))


def dialog_text() -> Column:
    """Texts over 20 characters of dialogs and modals, joined by a marker line."""
    test = lambda n: dom.attr(n, "role").isin("dialog", "alertdialog") | (n["tag"] == "dialog") | dom.cls_has(n, "modal", "dialog") | dom.has_attr(n, "data-radix-portal")
    return F.array_join(F.array_distinct(F.filter(F.transform(dom.select_nodes(test), dom.text_of), lambda x: F.length(x) > 20)), "\n---DIALOG---\n")


def main_texts(free: Column) -> Column:
    """Texts below main (else article) that hold nothing already emitted; ``free`` is that of ``section_parts``."""
    root = F.coalesce(dom.first_of(dom.select_nodes(lambda n: n["tag"] == "main")), dom.first_of(dom.select_nodes(lambda n: n["tag"] == "article")))

    def body(r: Column) -> Column:
        top = F.filter(dom.below(r), lambda n: F.get(free, n["nid"]) & ((n["pid"] == r["nid"]) | ~F.get(free, n["pid"])))
        return F.array_distinct(F.filter(F.transform(top, lambda n: trim_ws(dom.raw_text(n))), lambda x: F.length(x) >= 5))

    return F.coalesce(let(root, lambda r: F.when(r.isNotNull(), body(r))), _empty("string"))


def full_text() -> Column:
    """Every element's and text run's words, distinct, of two or more characters."""
    every = F.flatten(F.transform(F.col("nodes"), lambda n: F.array(dom.text_of(n), norm_ws(F.when(n["hidden"], F.lit("")).otherwise(n["own"])))))
    return F.array_join(F.array_distinct(F.filter(every, lambda x: F.length(x) >= 2)), "\n")


def dom_contacts(pages_dom: DataFrame) -> DataFrame:
    """``pages_dom`` with dom_emails, dom_phones and text_hints."""
    anchors = lambda p: dom.select_nodes(lambda n: (n["tag"] == "a") & F.lower(dom.attr(n, "href")).startswith(p))
    value = lambda n, p: F.regexp_replace(dom.attr(n, "href"), f"(?i)^{p}", "")
    mails = F.transform(anchors("mailto:"), lambda n: norm_ws(F.element_at(F.split(value(n, "mailto:"), r"\?"), 1)))
    calls = F.flatten(F.transform(anchors("tel:"), lambda n: F.array(trim_ws(value(n, "tel:")), F.when(dom.text_of(n).rlike("[0-9]"), dom.text_of(n)).otherwise(""))))
    prop = lambda p: F.transform(dom.select_nodes(lambda n: dom.attr(n, "itemprop") == p), lambda n: norm_ws(F.when(dom.attr(n, "content") != "", dom.attr(n, "content")).otherwise(dom.text_of(n))))
    zone = lambda n: n["tag"].isin("footer", "header") | dom.cls_has(n, *CONTACT_WORDS) | dom.id_has(n, *CONTACT_WORDS) | dom.has_class(n, "widget") | dom.attr(n, "itemtype").rlike("LocalBusiness|Organization")
    hints = F.array_join(F.filter(F.transform(dom.select_nodes(zone), dom.text_of), lambda x: x != ""), "\n")
    keep = lambda a: F.slice(F.array_distinct(F.filter(a, lambda x: x != "")), 1, 20)
    return pages_dom.withColumns({"dom_emails": keep(F.concat(mails, prop("email"))), "dom_phones": keep(F.concat(calls, prop("telephone"))), "text_hints": hints})


def page_contacts(pages_dom: DataFrame) -> DataFrame:
    """(page_id, site, url, emails, phones): from elements first, then from the text and the contact zones."""
    c = dom_contacts(pages_dom)
    both = F.concat_ws("\n", "text", "text_hints")
    phones = F.filter(F.transform("dom_phones", contacts.normalize_phone), lambda x: x != "")
    return c.select("page_id", "site", "url", contacts.merge_contacts(F.col("dom_emails"), contacts.extract_emails(both)).alias("emails"), contacts.merge_contacts(phones, contacts.extract_phones(both)).alias("phones"))


def mine_payloads(payloads: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, payload_text): commercial JSON answers of the page's own site, each and all bounded by size."""
    joined = payloads.join(pages.select("page_id", "url"), "page_id")
    kind, length = F.lower(F.coalesce("content_type", F.lit(""))), F.coalesce("content_length", F.lit(0))
    host, base = urls.hostname(F.col("resp_url")), urls.hostname(F.col("url"))
    own = (host == base) | F.endswith(host, F.concat(F.lit("."), F.regexp_replace(base, r"\Awww\.", "")))
    good = joined.filter((kind.contains("json") | kind.contains("graphql")) & own & (length <= 3 * PAYLOAD_ONE) & dom.like(F.col("body"), PAYLOAD_WORDS))
    cut = good.select("page_id", "seq", F.substring("body", 1, PAYLOAD_ONE).alias("body"))
    before = F.coalesce(F.sum(F.length("body")).over(Window.partitionBy("page_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    admitted = cut.withColumn("before", before).filter(F.col("before") < PAYLOAD_ALL)
    return admitted.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "body"))), lambda x: x["body"]), "\n").alias("payload_text"))


def is_readable() -> Column:
    """Is a page no placeholder? ``page_docs`` with ``keep_all`` keeps these pages and no other."""
    return ~text.is_challenge_page(F.col("title"), F.col("text"))


def page_docs(pages_dom: DataFrame, specs_text: DataFrame | None = None, payload_text: DataFrame | None = None, keep_all: bool = False) -> DataFrame:
    """(page_id, site, url, title, page_type, content, word_count, status, partial): one row a kept page.

    Kept are service and product pages and those of ``MIN_WORDS`` words; unparsed pages are salvaged by
    their plain text; placeholder pages go. Everything is within the row but the two optional joins on page_id.
    """
    built = section_parts(pages_dom.filter(is_readable()))
    built = built.withColumn("page_type", urls.page_type(F.col("url"), F.col("title")))
    joined = lambda a, sep: F.array_join(a, sep)
    details = let(details_texts(), lambda d: F.when(F.size(d) > 0, F.concat(F.lit("DETAILS_CONTENT\n"), joined(d, "\n\n"))).otherwise(""))
    raw = F.array_join(F.filter(F.array(details, joined(icon_feature_texts(), "\n"), _sections_text(F.col("parts")), joined(main_texts(F.col("free")), "\n"), joined(overlay_texts(), "\n")), lambda x: x != ""), "\n\n")
    built = built.withColumn("structured", text.strip_footer_dedup(raw))
    shadow = F.when(dom.like(F.col("url"), FULL_TEXT_URL), full_text()).otherwise("")
    built = built.withColumns({"shadow": shadow, "dialog": dialog_text()}).drop("parts", "free")
    for side, name in ((specs_text, "specs_text"), (payload_text, "payload_text")):
        built = built.join(side.select("page_id", name), "page_id", "left") if side is not None else built.withColumn(name, F.lit(None).cast("string"))
    labelled = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label + "\n"), F.col(c)))
    whole = F.concat_ws(
        "\n\n", F.when(F.col("structured") != "", F.col("structured")), labelled("SHADOW_CONTENT", "shadow"), labelled("API_PAYLOADS", "payload_text"), labelled("DIALOG_CONTENT", "dialog"), F.when(F.coalesce("specs_text", F.lit("")) != "", F.col("specs_text"))
    )
    rows = built.withColumn("content", text.dedupe_lines(whole))
    plain = F.concat_ws("\n", F.col("title"), F.col("text"))
    rows = rows.withColumns({"partial": F.col("parse_error"), "content": F.when(F.col("parse_error"), text.clean(text.strip_footer_dedup(plain))).otherwise(F.col("content"))})
    names = ("page_id", "site", "url", "title", "page_type", "content", "partial")
    row = let(F.struct(*names), lambda r: F.struct(*[r[n].alias(n) for n in names[:-1]], text.word_count(r["content"]).alias("word_count"), F.lit("ok").alias("status"), r["partial"].alias("partial")))
    keep = lambda r: F.lit(keep_all) | (r["page_type"].isin("services", "product_detail") & ~r["partial"]) | (r["word_count"] >= MIN_WORDS)
    # the rule is applied inside the generator: as a filter it would be pushed below and build every text twice
    return rows.select(F.explode(F.filter(F.array(row), keep)).alias("r")).select("r.*")


def strip_long_documents(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, text): ``text.strip_footer_dedup`` over rows of lines, for documents of so many lines that one is not a row's work.

    Each line is a row; the first of equal long lines is found with map-side aggregation by (document, MD5 of the line),
    so a document with most of the lines is dealt over many tasks until its kept lines are put in order again. ``key``
    must be unique; a null text stays null, and the empty text stays empty.
    """
    lines = docs.select(F.col(key), F.posexplode_outer(F.split(text.cut_at_marker(F.col(column)), "\n")).alias("at", "line"))
    same = F.when(F.length(trim_ws(F.col("line"))) >= text.LONG_LINE, F.md5(trim_ws(F.col("line")))).otherwise(F.col("at").cast("string"))
    first = lines.groupBy(F.col(key), same.alias("same")).agg(F.min(F.struct("at", "line")).alias("f"))
    kept = F.transform(F.sort_array(F.collect_list("f")), lambda x: x["line"])
    return first.groupBy(key).agg(kept.alias("lines")).select(key, F.when(F.get("lines", F.lit(0)).isNotNull(), F.array_join("lines", "\n")).alias(column))


def boilerplate_text(pages_dom: DataFrame) -> DataFrame:
    """(page_id, site, part, text): texts over five characters of headers, footers, navs and elements with a navigation role on home pages."""
    home = pages_dom.filter(urls.path(F.col("url")) == "/")
    fixed = dom.select_nodes(lambda n: n["tag"].isin("header", "footer", "nav") | (dom.attr(n, "role") == "navigation"))
    rows = home.select("page_id", "site", F.explode(F.transform(fixed, lambda n: F.struct(n["tag"].alias("part"), dom.text_of(n).alias("text")))).alias("x"))
    return rows.select("page_id", "site", "x.part", "x.text").filter(F.length("text") > 5)
