"""Prices, periods, badges and specification lines in text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.binding import let
from pageloom.functions.regexes import WS, ci, matches, norm_ws, trim_ws

_SIGN_FIRST = r"€|\$|£|¥|₹|₽|₺|zł|Kč|kr|лв\.?"
_SIGN_LAST = r"лв\.?|BGN|EUR|€|\$|USD|GBP|£|¥|₹|CHF|PLN|zł|CZK|Kč|SEK|kr|NOK|DKK|RON|lei|RUB|₽|TRY|₺|лева|руб|грн|UAH"
#: A mention of a price: sign and number, either first. Fixed value.
MENTION = rf"(?:(?:{_SIGN_FIRST}){WS}*[0-9]+(?:{WS}|[,.])?[0-9]*|[0-9]+(?:{WS}|[,.])?[0-9]*{WS}*(?:{_SIGN_LAST}))"
#: Currency words of the wide pattern, and the period words after a slash. Fixed values.
CURRENCY = (
    r"(?:лв\.?|лева|bgn|eur|€|\$|usd|gbp|£|¥|₹|chf|pln|zł|czk|kč|sek|kr|nok|dkk|ron|lei|rub|₽|руб|try|₺|lv|грн|uah|brl|r\$|aud|cad|huf|ft|hrk|kn|jpy|cny|元|inr|mxn)"
)
PERIOD = "(?:месец|month|mo|jahr|año|mese|monat|rok|ay|luna|месяц)"
NUMBER = rf"[0-9]{{1,6}}(?:(?:{WS}|[,.])[0-9]{{1,3}})*(?:[.,][0-9]{{1,2}})?"
MONEY = rf"(?:{CURRENCY}{WS}*{NUMBER}|(?:(?:from|от|ab|desde|da){WS}*)?{NUMBER}{WS}*{CURRENCY})(?:{WS}*/?{WS}*{PERIOD})?"
#: What every place where ``MONEY`` matches has ahead of it: at most five characters and white space, then a digit. Most places fail it at once.
_NEAR_NUMBER = rf"(?=[^0-9]{{0,5}}+(?:{WS}{{2}}|{WS}?[0-9]))"
ON_REQUEST = "по договаряне|on request|auf anfrage|sur demande|a consultar|price on request|call for price"
ON_REQUEST_NODE = ON_REQUEST + "|su richiesta|contact for price"
PERIODS = (
    ("monthly", rf"/{WS}*(месец|month|mo|monat|mese|mes|mois)|per month|на месец|pro monat|al mese|por mes|par mois"),
    ("yearly", rf"/{WS}*(year|год|jahr|anno|año|an\b)|per year|на година|pro jahr|all'anno|por año|par an"),
    ("one_time", rf"еднократно|one(?:-|{WS})?time|einmalig|una tantum|pago único|paiement unique"),
)
INSTALLMENT = r"месец|month|monat|mese|mes|mois|mo\b|/mo|per month"
BADGE_HINT = "popular|best|recommended|most|top|special|featured|популярен|най-|empfohlen|beliebt|recomendado|consigliato|recommandé"
BADGE = "(most popular|best value|recommended|популярен|най-популярен|special offer|best seller|top pick|featured)"
#: Icon words by status, in order of test: (status, pattern, where). Fixed values.
ICON_CLASS = (
    ("excluded", r"\blucide-x\b(?![a-z])"), ("included", r"\blucide-check\b"), ("excluded", r"\blucide-[a-z-]*x(-|\z)|\blucide-x-"), ("included", r"\blucide-[a-z-]*check"),
)
ICON_TEXT = (
    ("excluded", r"close|cross|x-mark|xmark|times|remove|cancel|minus|exclude|unavailable|not.?included|disabled|unchecked|fa-times|fa-xmark|fa-close|fa-remove|fa-minus|icon-x\b|icon-close|icon-cross|heroicon.*x-mark|bi-x\b"),
    ("included", r"\bcheck\b|tick|correct|done|success|verified|included|available|enabled|approved|fa-check|fa-tick|icon-check|icon-tick|heroicon.*check|bi-check"),
)
ICON_COLOUR = (
    ("excluded", "text-muted|text-destructive|text-danger|text-gray|text-red|text-disabled|opacity-50|opacity-40"), ("included", "text-primary|text-success|text-green|text-brand"),
)
ICON_IMAGE = (
    ("excluded", r"cross|xmark|x-mark|times|no\b|not.?included|excluded|close|remove|cancel|minus|unavailable|disabled|false|fail|error|danger|destructive|red"),
    ("included", r"check|checkmark|tick|yes\b|included|done|success|verified|available|enabled|approved|true|ok\b|green"),
)
ICON_FONT = (
    ("included", "fa-check|fa-tick|icon-check|icon-tick|material.*check|material.*done"),
    ("excluded", "fa-times|fa-close|fa-xmark|fa-remove|fa-minus|icon-x|icon-close|icon-cross|material.*close|material.*clear"),
)
MARKS_IN, MARKS_OUT = "[✓✔☑✅]", "[✕✗✘☒✖❌]"


def price_mentions(t: Column) -> Column:
    """All prices in a text, in order."""
    return F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(ci(MENTION)), 0)


def money_match(t: Column) -> Column:
    """The first amount of the wide currency list, with "from" and period; empty if none."""
    return norm_ws(F.regexp_extract(F.coalesce(t, F.lit("")), ci(_NEAR_NUMBER + MONEY), 0))


def has_money(t: Column) -> Column:
    return matches(t, _NEAR_NUMBER + MONEY)


def price_text_or_on_request(t: Column) -> Column:
    return let(money_match(t), lambda m: F.when(m != "", m).when(matches(t, ON_REQUEST), "On request").otherwise(""))


def billing_period(t: Column) -> Column:
    """monthly, yearly, one_time or null."""
    chain = None
    for kind, pattern in PERIODS:
        chain = F.when(matches(t, pattern), kind) if chain is None else chain.when(matches(t, pattern), kind)
    return chain.otherwise(F.lit(None).cast("string"))


def badge(badge_text: Column, card_text: Column) -> Column:
    """Short text of a badge element, else a badge phrase of the card, else empty."""
    own = norm_ws(F.coalesce(badge_text, F.lit("")))
    return F.when(F.length(own).between(1, 40), own).when(matches(card_text, BADGE_HINT), F.regexp_extract(card_text, ci(BADGE), 1)).otherwise("")


def is_installment(period: Column, title: Column, price: Column) -> Column:
    return F.coalesce(period == "monthly", F.lit(False)) | matches(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(price, F.lit(""))), INSTALLMENT)


def installment_title(title: Column) -> Column:
    return norm_ws(F.regexp_replace(title, ci(rf"\A((?:.|\n)*?)/{WS}*(?:месец|month|monat|mo)"), "$1"))


def _first(c: Column, rules) -> Column:
    chain = None
    for status, pattern in rules:
        chain = F.when(matches(c, pattern), status) if chain is None else chain.when(matches(c, pattern), status)
    return chain


def icon_status(svg_class: Column, parent_class: Column, hints: Column, href: Column) -> Column:
    """included, excluded or null of an svg icon: class, then names and hints, then colours, then what it refers to."""
    e = lambda c: F.lower(F.coalesce(c, F.lit("")))
    words = F.concat_ws(" ", e(svg_class), e(parent_class), e(hints))
    return F.coalesce(
        _first(e(svg_class), ICON_CLASS), _first(words, ICON_TEXT), _first(F.concat_ws(" ", e(svg_class), e(parent_class)), ICON_COLOUR),
        _first(e(href), (("included", "check|tick|success|done|correct|approved"), ("excluded", "close|cross|times|xmark|remove|cancel|minus"))),
    )


def image_status(meta: Column) -> Column:
    """Status of an image icon by its attributes ("red" also occurs in "featured")."""
    return _first(F.lower(F.coalesce(meta, F.lit(""))), ICON_IMAGE)


def font_status(cls: Column, content: Column) -> Column:
    content = F.coalesce(content, F.lit(""))
    return F.coalesce(F.when(content.rlike(MARKS_IN), "included"), F.when(content.rlike(MARKS_OUT), "excluded"), _first(F.lower(F.coalesce(cls, F.lit(""))), ICON_FONT))


def mark_status(t: Column) -> Column:
    """Status by a leading tick or cross."""
    return F.when(t.rlike(rf"\A{MARKS_IN}"), "included").when(t.rlike(rf"\A{MARKS_OUT}"), "excluded")


def with_mark(status: Column, t: Column) -> Column:
    return F.when(status == "included", F.concat(F.lit("✓ "), t)).when(status == "excluded", F.concat(F.lit("✗ "), t)).otherwise(t)


SPEC_LINE = rf"\A[►▸•\-]?{WS}*(.{{2,50}}?){WS}*[:\-–]{WS}*(.{{1,200}})\z"


def split_spec(line: Column) -> Column:
    """struct(key, value) of a "key: value" line; null if it is none or the key is too long."""

    def body(t: Column) -> Column:
        parts = F.struct(norm_ws(F.regexp_extract(t, SPEC_LINE, 1)).alias("key"), norm_ws(F.regexp_extract(t, SPEC_LINE, 2)).alias("value"))
        return let(parts, lambda p: F.when((F.length(t) <= 200) & F.length(p["key"]).between(2, 49) & (p["value"] != ""), p))

    return let(norm_ws(line), body)


def area_m2(t: Column) -> Column:
    """The first "n кв.м"; null if none."""
    found = F.regexp_extract(F.coalesce(t, F.lit("")), rf"([0-9]+){WS}*кв\.?{WS}*м", 1)
    return F.when(found != "", found).try_cast("int")


def compact_title(title: Column) -> Column:
    return trim_ws(F.regexp_replace(F.coalesce(title, F.lit("")), r"\|[^\n]*\z", ""))


def slug(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)
