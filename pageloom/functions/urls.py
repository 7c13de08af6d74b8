"""URL columns: canonical forms, resolution, classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.binding import let
from pageloom.functions.regexes import WS, ci, matches

_PARTS = r"(?is)\A([A-Za-z][A-Za-z0-9+.-]*):[/\\]*(?:[^/\\?#@]*@)?([^/\\?#:]+)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#.*)?\z"

#: URLs that are not followed. Fixed value.
SKIP = (
    r"wp-content/uploads|wp-json|/feed/?\z|/rss/?\z|sitemap\.xml|/attachment/|/author/|/tag/|/category/|/comment|/trackback|/xmlrpc|/wp-admin|/wp-login"
    r"|privacy|terms|cookies|gdpr|impressum|datenschutz|disclaimer|legal|politica|politique|blog/|news/|article/|archive/"
    r"|login|register|signup|sign-up|sign-in|cart|checkout|wishlist|basket|warenkorb|panier"
)
#: URLs that are visited first. Fixed value.
PRIORITY = (
    r"/(about|service|pricing|price|plans?|tariff|contact|faq|product|portfolio|team|feature|offer|package|rate|shop|store|catalog|menu"
    r"|za-nas|uslugi|ceni|tseni|kontakt|vuprosi|proekt|leistungen|preise|uber-uns|servizio|prezzi|chi-siamo|servicios|precios|sobre"
    r"|iletisim|hakkimizda|o-nas|cennik)\b"
)
#: Page types by URL and title: (type, pattern over "url title", pattern over the title). Fixed values.
PAGE_TYPES = (
    ("about", r"/(about|za-nas|uber-uns|a-propos|sobre|chi-siamo|o-nas|hakkimizda|om-oss)\b", r"\babout\b"),
    ("services", r"/(service|pricing|price|plans?|tariff|paket|packages?|rates?|uslugi|ceni|tseni|leistungen|preise|servicios|precios|servizi|prezzi)\b", None),
    ("contact", r"/(contact|kontakt|kontakti|contatto|contacto|kontakty|iletisim)\b", r"\bcontact\b"),
    ("faq", r"/(faq|questions|vuprosi|hilfe|ayuda|domande|pomoc)\b", r"\bfaq\b"),
    ("blog", r"/(blog|news|article|novini|actualites|noticias|notizie|aktuelles)\b", None),
)
PRODUCT_DETAIL = r"[?&]id=[0-9]|/id[-_][0-9]|/detail/|/product/|/item/|[0-9]{4,}-[a-z]"
#: Third-party hosts (with path) whose resources hold no text. Fixed values.
THIRD_PARTY = (
    r"google-analytics\.com", r"googletagmanager\.com", r"googlesyndication\.com", r"doubleclick\.net", r"googleadservices\.com", r"adservice\.google\.",
    r"connect\.facebook\.net", r"facebook\.com/tr", r"fbcdn\.net", r"youtube\.com", r"youtube-nocookie\.com", r"ytimg\.com", r"googlevideo\.com",
    r"vimeo\.com", r"player\.vimeo\.com", r"dailymotion\.com", r"tourmkr\.com", r"kuula\.co", r"matterport\.com", r"my\.matterport",
    r"hotjar\.com", r"clarity\.ms", r"mouseflow\.com", r"fullstory\.com", r"cloudflareinsights\.com", r"sentry\.io", r"bugsnag\.com", r"newrelic\.com",
    r"tawk\.to", r"crisp\.chat", r"intercom\.io", r"livechatinc\.com", r"smartsupp\.com", r"zopim\.com", r"drift\.com", r"tidio\.co", r"messenger\.com",
    r"fonts\.gstatic\.com", r"fonts\.googleapis\.com", r"use\.typekit\.net", r"criteo\.", r"taboola\.com", r"outbrain\.com", r"hs-scripts\.com",
    r"snap\.licdn\.com", r"analytics\.tiktok\.com", r"bat\.bing\.com", r"jnn-pa\.googleapis\.com", r"recaptcha\.net/recaptcha", r"gstatic\.com/recaptcha",
)
TEXTLESS_TYPES = ("image", "media", "font", "websocket", "eventsource")


def _parsed(u: Column) -> Column:
    """[scheme, host, port, path, query] of an absolute URL by one pass; one element for anything else."""
    return F.split(F.regexp_replace(F.coalesce(u, F.lit("")), _PARTS, "$1\x01$2\x01$3\x01$4\x01$5"), "\x01")


def _ok(p: Column) -> Column:
    return F.size(p) == 5


def _scheme(p: Column) -> Column:
    return F.lower(F.get(p, F.lit(0)))


def _host(p: Column) -> Column:
    return F.lower(F.get(p, F.lit(1)))


def _bare(p: Column) -> Column:
    return F.regexp_replace(_host(p), r"\Awww\.", "")


def _port(p: Column) -> Column:
    """``:port``, empty for the default of the scheme."""
    number = F.get(p, F.lit(2))
    default = ((_scheme(p) == "http") & (number == "80")) | ((_scheme(p) == "https") & (number == "443")) | (number == "")
    return F.when(default, "").otherwise(F.concat(F.lit(":"), number))


def _path(p: Column) -> Column:
    return F.when(F.get(p, F.lit(3)) == "", "/").otherwise(F.get(p, F.lit(3)))


def _origin(p: Column) -> Column:
    return F.concat(_scheme(p), F.lit("://"), _host(p), _port(p))


def is_url(u: Column) -> Column:
    """Absolute, with a host."""
    return _ok(_parsed(u))


def hostname(u: Column) -> Column:
    """Lower-case host; null for what is no URL."""
    return let(_parsed(u), lambda p: F.when(_ok(p), _host(p)))


def path(u: Column) -> Column:
    """Path, ``/`` if empty; null for what is no URL."""
    return let(_parsed(u), lambda p: F.when(_ok(p), _path(p)))


def origin(u: Column) -> Column:
    """scheme://host[:port]; null for what is no URL."""
    return let(_parsed(u), lambda p: F.when(_ok(p), _origin(p)))


def normalize_url(u: Column) -> Column:
    """Without fragment, query and one ``www.``; path case and a final slash stay; else unchanged."""
    return let(_parsed(u), lambda p: F.when(_ok(p), F.concat(_scheme(p), F.lit("://"), _bare(p), _port(p), _path(p))).otherwise(u))


def url_key(u: Column) -> Column:
    """Key of a page: as ``normalize_url``, https, no final slash, lower case."""

    def body(p: Column) -> Column:
        way = F.when(_path(p) == "/", "/").otherwise(F.regexp_replace(_path(p), r"/\z", ""))
        kept_port = F.when(_port(p) == ":443", "").otherwise(_port(p))
        return F.when(_ok(p), F.lower(F.concat(F.lit("https://"), _bare(p), kept_port, way))).otherwise(F.lower(F.coalesce(u, F.lit(""))))

    return let(_parsed(u), body)


def normalize_domain(u: Column) -> Column:
    """Host without ``www.``; empty for what is no URL."""
    return let(_parsed(u), lambda p: F.when(_ok(p), _bare(p)).otherwise(F.lit("")))


def _no_dots(way: Column) -> Column:
    steps = F.split(way, "/")
    ended = F.when(way.rlike(r"/\.\.?\z"), F.concat(steps, F.array(F.lit("")))).otherwise(steps)
    kept = F.aggregate(
        ended,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    return F.when(way.rlike(r"(?:/|\A)\.\.?(?:/|\z)"), F.array_join(kept, "/")).otherwise(way)


def absolute(href: Column, base: Column) -> Column:
    """``href`` against the page ``base``, as a canonical URL with its query and without fragment; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(href, rf"^{WS}+|{WS}+\z|[\t\n\r]", ""), r"#.*", "")

    def joined(h: Column, b: Column) -> Column:
        return (
            F.when(h.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), h)
            .when(h.startswith("//"), F.concat(_scheme(b), F.lit(":"), h))
            .when(h.startswith("/"), F.concat(_origin(b), h))
            .when(h.startswith("?"), F.concat(_origin(b), _path(b), h))
            .when(h == "", F.concat(_origin(b), _path(b), F.get(b, F.lit(4))))
            .otherwise(F.concat(_origin(b), F.regexp_replace(_path(b), r"[^/]*\z", ""), h))
        )

    def canonical(p: Column) -> Column:
        return F.when(_ok(p), F.concat(_origin(p), let(_path(p), _no_dots), F.get(p, F.lit(4))))

    return let(_parsed(base), lambda b: let(bare, lambda h: F.when(_ok(b) & h.isNotNull(), let(_parsed(joined(h, b)), canonical))))


def resolve_href(href: Column, base: Column) -> Column:
    """``absolute``, kept if its origin is the page's own; null otherwise."""
    return let(absolute(href, base), lambda a: F.when(origin(a) == origin(base), a))


def is_skippable_url(u: Column) -> Column:
    return matches(u, SKIP)


def is_priority_url(u: Column) -> Column:
    return matches(u, PRIORITY)


def page_type(u: Column, title: Column) -> Column:
    """First type whose pattern occurs in the URL or title, else general."""
    u, title = F.coalesce(u, F.lit("")), F.coalesce(title, F.lit(""))
    both = F.lower(F.concat_ws(" ", u, title))
    chain = None
    for kind, pattern, in_title in PAGE_TYPES:
        test = both.rlike(ci(pattern)) if in_title is None else both.rlike(ci(pattern)) | title.rlike(ci(in_title))
        chain = F.when(test, kind) if chain is None else chain.when(test, kind)
    return chain.when(u.rlike(ci(PRODUCT_DETAIL)), "product_detail").otherwise("general")


def third_party_class(resource: Column, kind: Column, base: Column) -> Column:
    """own_document, textless, third_party or kept, for a row of a resource log."""

    def body(host: Column, own: Column) -> Column:
        is_own = (own != "") & ((host == own) | F.endswith(host, F.concat(F.lit("."), own)))
        listed = matches(F.concat(host, path(resource)), "|".join(THIRD_PARTY))
        return (
            F.when((kind == "document") & is_own, "own_document")
            .when(kind.isin(*TEXTLESS_TYPES), "textless")
            .when(~is_own & (host != "") & listed, "third_party")
            .otherwise("kept")
        )

    return let(normalize_domain(resource), lambda host: let(normalize_domain(base), lambda own: body(host, own)))
