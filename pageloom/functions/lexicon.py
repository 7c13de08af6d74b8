"""Keyword and class columns for buttons, fields and widgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.regexes import WS, ci, matches, trim_ws

#: Words that a text may contain, with the keywords they stand for. Fixed values.
KEYWORDS = (
    ("book", ("book", "reserve", "booking", "reservation")), ("reserve", ("book", "reserve", "reservation")), ("резерв", ("book", "reserve", "booking")),
    ("запази", ("book", "reserve")), ("buchen", ("book", "reserve")), ("prenota", ("book", "reserve")), ("réserver", ("book", "reserve")), ("reservar", ("book", "reserve")),
    ("search", ("search", "find", "lookup")), ("find", ("search", "find")), ("търси", ("search", "find")), ("suchen", ("search", "find")), ("buscar", ("search", "find")), ("chercher", ("search", "find")),
    ("submit", ("submit", "send")), ("send", ("send", "submit")), ("изпрати", ("send", "submit")), ("senden", ("send", "submit")), ("enviar", ("send", "submit")), ("envoyer", ("send", "submit")),
    ("contact", ("contact", "reach")), ("контакт", ("contact", "reach")), ("kontakt", ("contact",)),
    ("check-in", ("check-in", "checkin", "arrival")), ("check-out", ("check-out", "checkout", "departure")), ("настаняване", ("check-in", "arrival")), ("напускане", ("check-out", "departure")),
    ("arrival", ("check-in", "arrival")), ("departure", ("check-out", "departure")),
    ("price", ("prices", "rates", "cost")), ("service", ("services",)), ("цени", ("prices", "rates")), ("услуги", ("services",)),
)
#: Action classes of button texts, first match wins. Fixed values.
ACTIONS = (
    ("booking", r"\b(book|reserve|reserv|buchen|prenota|réserver|reservar|запис|резерв|запази|foglal|boka)\b"),
    ("contact", r"\b(contact|kontakt|contatto|contacto|связ|свърж|iletişim|kontakty)\b"),
    ("submit", r"\b(search|find|submit|send|check|filter|apply|go|enter|изпрати|търси|suchen|buscar|chercher|cerca|szukaj|ara)\b"),
    ("navigation", r"\b(about|service|room|gallery|portfolio|menu|home|faq|help)\b"),
)
#: Field texts with the keywords they stand for. Fixed values.
FIELDS = (
    (r"check-?in|checkin|arrival|from|start|anreise|arrivée|llegada|arrivo|пристигане|настаняване|приезд|giriş", ("check-in", "arrival", "from")),
    (r"check-?out|checkout|departure|to\b|end|abreise|départ|salida|partenza|напускане|заминаване|отъезд|çıkış", ("check-out", "departure", "to")),
    (r"guest|adult|person|people|pax|room|гост|човек|деца|child|kinder|enfant|huésped|ospite|гостей|misafir", ("guests", "adults", "persons")),
    (r"\bname\b|име|nom\b|nombre|nome|имя|isim|naam", ("name",)),
    (r"email|e-?mail|имейл|correo|courriel|почта|e-posta", ("email",)),
    (r"phone|tel|телефон|teléfono|téléphone|telefon|telefono", ("phone",)),
    (r"message|comment|note|съобщение|сообщение|nachricht|mensaje|messaggio|mesaj", ("message",)),
)
#: Booking vendors: (part of the text, vendor). Fixed values.
VENDORS = (
    ("quendoo", "quendoo"), ("cloudbeds", "cloudbeds"), ("simplybook", "simplybook"), ("calendly", "calendly"), ("bookero", "bookero"), ("amelia", "amelia"), ("hotelrunner", "hotelrunner"),
    ("beds24", "beds24"), ("synxis", "synxis"), ("mews", "mews"), ("sabeeapp", "sabeeapp"), ("littlehotelier", "littlehotelier"), ("bookingengine", "booking_engine"), ("booking-engine", "booking_engine"),
)
BOOKING_LIKE = r"(book|booking|reserve|reservation|availability|check-?in|check-?out|guest|adult|children|room)"


def keywords(text: Column) -> Column:
    """The lower-case text, its words of over two characters, and what contained words stand for; distinct, in order."""
    low = trim_ws(F.lower(text))
    words = F.filter(F.split(low, f"{WS}+"), lambda w: F.length(w) > 2)
    mapped = [F.when(low.contains(k), F.array(*[F.lit(v) for v in vs])).otherwise(F.array().cast("array<string>")) for k, vs in KEYWORDS]
    return F.filter(F.array_distinct(F.concat(F.array(low), words, *mapped)), lambda k: F.length(k) > 1)


def action_type(text: Column) -> Column:
    """booking, contact, submit, navigation or other."""
    low, chain = F.lower(text), None
    for kind, pattern in ACTIONS:
        chain = F.when(low.rlike(ci(pattern)), kind) if chain is None else chain.when(low.rlike(ci(pattern)), kind)
    return chain.otherwise("other")


def field_type(name: Column, kind: Column, placeholder: Column, label: Column) -> Column:
    """date, number, select or text."""
    both = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (name, kind, placeholder, label)]))
    return (
        F.when(kind == "date", "date").when(kind == "number", "number")
        .when(matches(both, "date|дата"), "date").when(matches(both, "guest|човек|брой|count|number"), "number")
        .when(matches(kind, "select"), "select").otherwise("text")
    )


def field_keywords(name: Column, placeholder: Column, label: Column) -> Column:
    """Keywords of a field, then its lower-case name; distinct."""
    name = F.coalesce(name, F.lit(""))
    both = F.lower(F.concat_ws(" ", name, F.coalesce(placeholder, F.lit("")), F.coalesce(label, F.lit(""))))
    found = [F.when(matches(both, p), F.array(*[F.lit(v) for v in vs])).otherwise(F.array().cast("array<string>")) for p, vs in FIELDS]
    return F.array_distinct(F.concat(*found, F.when(name != "", F.array(F.lower(name))).otherwise(F.array().cast("array<string>"))))


def vendor(text: Column, rollup: bool = False) -> Column:
    """First booking vendor named in a text; the roll-up variant also knows wordpress."""
    low, chain = F.lower(F.coalesce(text, F.lit(""))), None
    for part, name in (*VENDORS, *((("wordpress", "wordpress"),) if rollup else ())):
        chain = F.when(low.contains(part), name) if chain is None else chain.when(low.contains(part), name)
    return chain.otherwise("unknown")


def booking_like(text: Column) -> Column:
    return (vendor(text) != "unknown") | matches(text, BOOKING_LIKE)
