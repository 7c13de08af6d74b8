"""Column functions: one case per rule."""

from pyspark.sql import functions as F

from pageloom.functions import contacts, fingerprints, lexicon, money, text, urls


def values(spark, rows, schema, *columns):
    out = spark.createDataFrame(rows, schema).select(*columns).collect()
    return [tuple(r) if len(columns) > 1 else r[0] for r in out]


def each(spark, function, *inputs):
    return values(spark, [(i,) for i in inputs], "x string", function(F.col("x")))


def test_urls(spark):
    assert each(spark, urls.normalize_url, "HTTP://www.A.com:80/B/?q#f", "https://a.com", "nonsense", None) == ["http://a.com/B/", "https://a.com/", "nonsense", None]
    assert each(spark, urls.url_key, "http://www.A.com/B/?q", "https://a.com/", "Junk", "http://a.com/b//") == ["https://a.com/b", "https://a.com/", "junk", "https://a.com/b/"]
    keys = each(spark, urls.url_key, "http://www.A.com/B/?q", "https://x.y/z/")
    assert each(spark, urls.url_key, *keys) == keys
    assert each(spark, urls.normalize_domain, "https://www.a.b/c", "", None) == ["a.b", "", ""]


def test_resolve_href(spark):
    rows = [("/x?a=1#f",), ("y",), ("../z",), ("?q=2",), ("#top",), ("//a.com/p",), ("http://a.com/p",), ("https://b.com/",), ("mailto:x@y.z",), ("./a/../b/.",)]
    got = values(spark, rows, "h string", urls.resolve_href(F.col("h"), F.lit("https://a.com/d/e/f?k=1")))
    assert got == ["https://a.com/x?a=1", "https://a.com/d/e/y", "https://a.com/d/z", "https://a.com/d/e/f?q=2", "https://a.com/d/e/f?k=1", "https://a.com/p", None, None, None, "https://a.com/d/e/b/"]


def test_url_classes(spark):
    assert each(spark, urls.is_skippable_url, "https://a.b/cartoon", "https://a.b/illegal", "https://a.b/x", None) == [True, True, False, False]
    assert each(spark, urls.is_priority_url, "https://a.b/service", "https://a.b/services", "https://a.b/plans") == [True, False, True]
    assert each(spark, lambda u: urls.page_type(u, F.lit("")), "https://a.b/services", "https://a.b/service", "https://a.b/item/4", "https://a.b/za-nas", "https://a.b/1234-abc") == ["general", "services", "product_detail", "about", "product_detail"]
    assert each(spark, lambda u: urls.page_type(u, F.lit("About us")), "https://a.b/x") == ["about"]
    rows = [("https://a.b/", "document"), ("https://cdn.vimeo.com/x", "script"), ("https://i.a.b/p.png", "image"), ("https://other.org/", "xhr")]
    assert values(spark, rows, "u string, t string", urls.third_party_class(F.col("u"), F.col("t"), F.lit("https://www.a.b"))) == ["own_document", "third_party", "textless", "kept"]


def test_text(spark):
    assert each(spark, text.clean, " a\t b\r\n\n\n\nc ", None) == ["a b\n\nc", None]
    assert each(spark, text.word_count, "a  b c\n", "", None) == [3, 0, 0]
    assert each(spark, text.norm_ws, " a \n b﻿") == ["a b"]
    long39, long40 = "x" * 39, "y" * 40
    assert each(spark, text.strip_footer_dedup, f"{long39}\n{long39}\n{long40}\n {long40} \nz") == [f"{long39}\n{long39}\n{long40}\nz"]
    assert each(spark, text.strip_footer_dedup, "a\nTOP_CONTROLS\nb", "TOP_CONTROLS\nb") == ["a\n", "TOP_CONTROLS\nb"]
    assert each(spark, text.dedupe_lines, "a\nb\n\n\na\nc") == ["a\nb\nc"]
    assert each(spark, lambda t: text.is_challenge_page(F.lit(""), t), "x" * 590 + "ray id", "x" * 601 + "ray id", "Just a Moment") == [True, False, True]
    assert each(spark, text.total_steps, "Step 1 of 4", "стъпка 2 от 6", "none", None) == [4, 6, None, None]


def test_contacts(spark):
    assert each(spark, contacts.normalize_phone, "+359 88 123‑456", "10.12.2025", "12345", "1234567890123456", "152.143.123.131", None) == ["+35988123456", "", "", "", "152143123131", ""]
    assert each(spark, contacts.extract_phones, "call 0888 123 456 or 0888-123-456\n4785380592391139") == [["0888123456"]]
    assert each(spark, contacts.extract_emails, "A@b.co a@b.co A@b.co", None) == [["A@b.co", "a@b.co"], []]
    many = " ".join(f"u{k}@x.yz" for k in range(30))
    assert [len(x) for x in each(spark, contacts.extract_emails, many)] == [20]


def test_lexicon(spark):
    assert each(spark, lexicon.action_type, "Book now", "запази", "rebooking", "Search", "Home", "xyz") == ["booking", "other", "other", "submit", "navigation", "other"]
    assert each(spark, lexicon.keywords, " Book a Room ") == [["book a room", "book", "room", "reserve", "booking", "reservation"]]
    assert each(spark, lambda n: lexicon.field_type(n, F.lit("text"), F.lit(""), F.lit("")), "country", "дата", "x") == ["number", "date", "text"]
    assert each(spark, lambda n: lexicon.field_keywords(n, F.lit(""), F.lit("")), "Email", "") == [["email"], []]
    assert each(spark, lexicon.vendor, "x MEWS y", "wordpress", None) == ["mews", "unknown", "unknown"]
    assert each(spark, lambda t: lexicon.vendor(t, rollup=True), "wordpress") == ["wordpress"]


def test_money(spark):
    assert each(spark, money.price_mentions, "€350 or 99 лв, 5 apples", None) == [["€350 ", "99 лв"], []]
    assert each(spark, money.money_match, "from 1 200,50 EUR / month", "nothing") == ["from 1 200,50 EUR / month", ""]
    assert each(spark, money.price_text_or_on_request, "price on request", "€5", "x") == ["On request", "€5", ""]
    assert each(spark, money.billing_period, "5€ / month", "per year", "one-time", "x") == ["monthly", "yearly", "one_time", None]
    assert each(spark, lambda t: money.is_installment(F.lit(None).cast("string"), t, F.lit("")), "video games", "plan") == [True, False]
    assert each(spark, money.installment_title, "Basic / month") == ["Basic"]
    assert each(spark, money.split_spec, "► Colour : red", "well-known fact", "x" * 60 + ": y") == [("Colour", "red"), ("well", "known fact"), None]
    assert each(spark, money.area_m2, "about 120 кв.м", "none", None) == [120, None, None]
    assert each(spark, money.compact_title, "House | builder | x", None) == ["House", ""]
    e = F.lit("")
    assert each(spark, lambda c: money.icon_status(c, e, e, e), "lucide lucide-x", "lucide lucide-xray", "lucide lucide-check", "text-muted", "plain") == ["excluded", None, "included", "excluded", None]
    assert each(spark, money.image_status, "featured", "ok.png", "x") == ["excluded", "included", None]
    assert each(spark, lambda b: money.badge(b, F.lit("the best value deal")), "Top", "", None) == ["Top", "best value", "best value"]


def test_fingerprints(spark):
    a, b = '{"b":[1,{"z":1,"a":2}],"a":"x"}', '{"a":"x","b":[1,{"a":2,"z":1}]}'
    got = each(spark, lambda s: fingerprints.fingerprint(F.lit("form"), s), a, b, "broken")
    assert got[0] == got[1] and got[2] is None
    s1, s2, s3 = '{"name":"field_1","q":"#abc"}', '{"name":"field_22","q":"#x"}', '{"name":"other","q":"#x"}'
    t = each(spark, lambda s: fingerprints.template_fingerprint(F.lit("form"), s), s1, s2, s3)
    assert t[0] == t[1] != t[2]
    r = ['{"selector_candidates":["input[name=a]","x"]}', '{"selector_candidates":["input[name=b]","y"]}']
    u = each(spark, lambda s: fingerprints.template_fingerprint(F.lit("form"), s), *r)
    assert u[0] != u[1]  # the class ends at the first bracket, so residue tells the two apart
