"""Pages rendered from business tables by Spark expressions: what an extractor must give back is in the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def money_text(c: Column) -> Column:
    return c.cast("decimal(12,2)").cast("string")


def product_pages(part: DataFrame) -> DataFrame:
    """One product page a part: h1, price, dl, two-cell table, description."""
    html = F.concat(
        F.lit("<html><head><title>"), "p_name", F.lit(" | shop</title></head><body><nav><a href=\"/\">Home</a></nav><h1>"), "p_name",
        F.lit("</h1><span class=\"price\">€"), money_text(F.col("p_retailprice")), F.lit("</span><dl><dt>Brand</dt><dd>"), "p_brand", F.lit("</dd><dt>Type</dt><dd>"), "p_type",
        F.lit("</dd></dl><table><tr><td>Size</td><td>"), F.col("p_size").cast("string"), F.lit("</td></tr></table><article><p>About "), "p_name", F.lit("</p></article></body></html>"),
    )
    url = F.concat(F.lit("https://shop"), (F.col("p_partkey") % 7).cast("string"), F.lit(".example/product/"), F.col("p_partkey").cast("string"))
    return part.select(F.col("p_partkey").alias("page_id"), url.alias("url"), html.alias("html"))


def card_pages(part: DataFrame) -> DataFrame:
    """One pricing page a part with one card: monthly on odd keys, once on even ones, a mark on every feature."""
    odd = F.col("p_partkey") % 2 == 1
    html = F.concat(
        F.lit('<html><body><div class="tier-card"><h3>Plan '), F.col("p_partkey").cast("string"), F.lit('</h3><span class="cost">€'), money_text(F.col("p_retailprice")),
        F.when(odd, " /month").otherwise(" one-time"), F.lit("</span><ul><li>✓ "), "p_brand", F.lit("</li><li>✗ "), "p_type", F.lit('</li><li>Size '), F.col("p_size").cast("string"),
        F.lit('</li></ul><span class="badge">Best value</span></div></body></html>'),
    )
    url = F.concat(F.lit("https://shop"), (F.col("p_partkey") % 7).cast("string"), F.lit(".example/pricing/"), F.col("p_partkey").cast("string"))
    return part.select(F.col("p_partkey").alias("page_id"), url.alias("url"), html.alias("html"))


def card_source_pages(part: DataFrame) -> DataFrame:
    """One page a part with cards of all sources: price attributes, a price class, JSON-LD offers, an amount in a text, "on request", and repeats of them."""
    k = F.col("p_partkey").cast("string")
    price = money_text(F.col("p_retailprice"))
    attribute = F.concat(F.lit('<article><h3>Alpha '), k, F.lit('</h3><b data-price="'), price, F.lit('"></b><p>Made by '), "p_brand", F.lit(" each year</p></article>"))
    by_class = F.concat(F.lit('<div class="tier-card"><h3>Beta '), k, F.lit(' plan</h3><span class="cost">€'), price, F.lit("</span><ul><li>Type "), "p_type", F.lit("</li></ul></div>"))
    in_text = F.concat(F.lit('<section><h3>Gamma '), k, F.lit("</h3><p>only €"), F.col("p_size").cast("string"), F.lit(" per month</p></section>"))
    asked = F.concat(F.lit('<div class="offer-box"><h3>Delta '), k, F.lit("</h3><p>Price on request</p><em>Best value</em></div>"))
    offers = F.concat(F.lit('<script type="application/ld+json">{"name":"Epsilon '), k, F.lit('","offers":[{"price":"'), price, F.lit('"},{"price":"'), price, F.lit('"},{"price":"0"}]}</script>'))
    html = F.concat(F.lit("<html><body>"), offers, asked, in_text, F.repeat(by_class, 2), F.repeat(attribute, 2), F.lit("</body></html>"))
    url = F.concat(F.lit("https://shop"), (F.col("p_partkey") % 7).cast("string"), F.lit(".example/pricing/"), k)
    return part.select(F.col("p_partkey").alias("page_id"), url.alias("url"), html.alias("html"))


def jsonld_pages(part: DataFrame) -> DataFrame:
    """Offers as object (even keys) or array (odd), broken JSON on every fiftieth."""
    price = money_text(F.col("p_retailprice"))
    offer = F.concat(F.lit('{"price":"'), price, F.lit('"}'))
    many = F.when(F.col("p_partkey") % 2 == 0, offer).otherwise(F.concat(F.lit("["), offer, F.lit("]")))
    json = F.when(F.col("p_partkey") % 50 == 0, F.lit('{"name": broken')).otherwise(F.concat(F.lit('{"@type":"Product","name":"'), "p_name", F.lit('","offers":'), many, F.lit("}")))
    html = F.concat(F.lit('<html><body><script type="application/ld+json">'), json, F.lit("</script></body></html>"))
    url = F.concat(F.lit("https://shop"), (F.col("p_partkey") % 7).cast("string"), F.lit(".example/x/"), F.col("p_partkey").cast("string"))
    return part.select(F.col("p_partkey").alias("page_id"), url.alias("url"), html.alias("html"))


def extraction_pages(part: DataFrame) -> DataFrame:
    """One general page a part: headings, list items with svg, font and image icons, mined links, cards, a dialog; some are placeholders or have no html."""
    k = F.col("p_partkey").cast("string")
    card = F.concat(F.lit('<div class="tile-card"><a href="/thing/'), k, F.lit('?q=1">open</a></div>'))
    html = F.concat(
        F.lit("<html><head><title>"), F.when(F.col("p_partkey") % 7 == 0, "Just a moment").otherwise(F.col("p_name")), F.lit("</title></head><body><header><nav><a href=\"/n/"), k, F.lit("\">menu</a></nav></header><h1>First "), "p_name",
        F.lit("</h1><p>About the brand "), "p_brand", F.lit('</p><h2>Second</h2><ul class="features"><li><svg class="lucide-check"></svg>Brand '), "p_brand", F.lit('</li><li><i class="fa-xmark"></i>Type '), "p_type",
        F.lit('</li><li><img src="/check.png">Size '), F.col("p_size").cast("string"), F.lit('</li></ul><div data-href="/data/'), k, F.lit('x"></div><span onclick="location.href=\'/click/'), k, F.lit("'\"></span>"),
        F.repeat(card, F.col("p_size") % 6), F.lit('<div role="dialog">Dialog about the part '), k, F.lit(" that is long enough</div></body></html>"),
    )
    url = F.concat(F.lit("https://g"), (F.col("p_partkey") % 7).cast("string"), F.lit(".example/g"), k)
    return part.select(F.col("p_partkey").alias("page_id"), url.alias("url"), F.when(F.col("p_partkey") % 11 != 0, html).alias("html"))


def part_pages(part: DataFrame) -> DataFrame:
    """One page a part with a details element, icons beside features, an overlay, loose text in main, a header; even parts are home pages."""
    k = F.col("p_partkey").cast("string")
    html = F.concat(
        F.lit("<html><body><header>Top of "), "p_brand", F.lit('</header><div role="navigation">Steps '), k, F.lit(" here</div><main><h1>Head "), "p_name", F.lit("</h1><div>Loose "), "p_type",
        F.lit(" words</div></main><details><summary>Question "), k, F.lit("</summary><div><table><tr><td>Size</td><td>"), F.col("p_size").cast("string"), F.lit("</td></tr></table></div><p>Answer "), "p_brand",
        F.lit('</p></details><div class="pricing"><div><svg class="lucide-check"></svg><span>Feature '), k, F.lit('</span></div><div><img src="/red-cross.png"><span>Missing '), k,
        F.lit('</span></div></div><div class="popup-overlay">Overlay of '), "p_name", F.lit(" here</div><footer>ok</footer></body></html>"),
    )
    url = F.concat(F.lit("https://h"), k, F.lit(".example/"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("inner/x"))
    return part.select(F.col("p_partkey").alias("page_id"), url.alias("url"), html.alias("html"))


def icon_pages(part: DataFrame) -> DataFrame:
    """One page a part with a feature whose icon tells its status in one of eight ways, by key."""
    icons = (
        '<svg class="text-green-500"></svg>', '<svg class="text-muted"></svg>', '<svg><use href="#i-success"></use></svg>', '<svg><use href="#i-times"></use></svg>',
        '<svg aria-label="unavailable"></svg>', '<i class="fa-check"></i>', '<span class="icon">✗</span>', '<img alt="yes" src="/a.png">',
    )
    icon = F.element_at(F.array(*map(F.lit, icons)), (F.col("p_partkey") % 8 + 1).cast("int"))
    html = F.concat(F.lit('<html><body><h2>Plans</h2><ul class="features"><li>'), icon, F.lit(" Feature "), "p_brand", F.lit("</li></ul></body></html>"))
    url = F.concat(F.lit("https://i"), (F.col("p_partkey") % 7).cast("string"), F.lit(".example/f/"), F.col("p_partkey").cast("string"))
    return part.select(F.col("p_partkey").alias("page_id"), url.alias("url"), html.alias("html"))


def mapped_pages(part: DataFrame) -> DataFrame:
    """One page a part with a button and a priced card; pages of every third part have no button, so their prices do not count."""
    k = F.col("p_partkey").cast("string")
    html = F.concat(F.lit('<html><body><div class="tier-card"><h3>Plan '), k, F.lit('</h3><span class="cost">€'), money_text(F.col("p_retailprice")), F.lit(" one-time</span></div>"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("<button>Buy plan "), k, F.lit("</button>"))), F.lit("</body></html>"))
    url = F.concat(F.lit("https://m"), (F.col("p_partkey") % 90).cast("string"), F.lit(".example/pricing/"), k)
    return part.select(F.col("p_partkey").alias("page_id"), url.alias("url"), html.alias("html"))


def option_pages(customer: DataFrame) -> DataFrame:
    """One form a customer with pressed buttons, sibling option buttons under a label, and a submit button."""
    k = F.col("c_custkey").cast("string")
    html = F.concat(
        F.lit('<html><body><form><input name="who"><div aria-label="Room"><button aria-pressed="true">Single '), k, F.lit('</button><button aria-pressed="false">Double</button></div><div><span>Segment *</span><div><button type="button">'),
        "c_mktsegment", F.lit('</button><button type="button">Other</button><button type="button">Next</button></div></div><p><button type="submit">Send</button></p></form></body></html>'),
    )
    return customer.select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("https://o"), F.col("c_nationkey").cast("string"), F.lit(".example/x/"), k).alias("url"), html.alias("html"))


def wizard_pages(customer: DataFrame) -> DataFrame:
    """One page a customer with inputs that make a wizard by a step class, a step indicator or a next button, in turn; within a form on every fifth page."""
    k = F.col("c_custkey").cast("string")
    by_class = F.concat(F.lit('<div class="sign-up wizard"><div class="step">Step 1 of '), (F.col("c_nationkey") + 2).cast("string"), F.lit('</div><p><input name="a_'), k, F.lit('"></p><button>Back</button><button>Continue</button></div>'))
    by_mark = F.concat(F.lit('<div><div><b class="step-number">Part '), k, F.lit('</b></div><p><input name="b_'), k, F.lit('"></p></div>'))
    by_turn = F.concat(F.lit('<div><p><input name="c_'), k, F.lit('"><select name="segment"><option>'), "c_mktsegment", F.lit("</option></select></p><p><a class=\"btn\">Next</a></p></div>"))
    body = F.when(F.col("c_custkey") % 3 == 0, by_class).when(F.col("c_custkey") % 3 == 1, by_mark).otherwise(by_turn)
    html = F.concat(F.lit("<html><body><main>"), F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("<form>"), body, F.lit("</form>"))).otherwise(body), F.lit("</main></body></html>"))
    return customer.select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("https://w"), F.col("c_nationkey").cast("string"), F.lit(".example/x/"), k).alias("url"), html.alias("html"))


def supplier_phone(k: Column) -> Column:
    return F.concat(F.lit("+359"), F.lpad(k.cast("string"), 8, "0"))


def contact_pages(supplier: DataFrame) -> DataFrame:
    """A footer with tel and mailto links, the number in other spelling, a date that is no number."""
    k = F.col("s_suppkey")
    digits = F.lpad(k.cast("string"), 8, "0")
    html = F.concat(
        F.lit("<html><body><p>Opened 10.12.2025</p><footer><a href=\"tel:"), supplier_phone(k), F.lit("\">call</a> <a href=\"mailto:supplier"), k.cast("string"),
        F.lit("@mail.example?subject=hi\">write</a> Phone: +359 "), F.substring(digits, 1, 2), F.lit(" "), F.substring(digits, 3, 3), F.lit("-"), F.substring(digits, 6, 3), F.lit("</footer></body></html>"),
    )
    url = F.concat(F.lit("https://www.nation"), F.col("s_nationkey").cast("string"), F.lit(".example/contact/"), k.cast("string"))
    return supplier.select(k.alias("page_id"), url.alias("url"), html.alias("html"))


def form_pages(customer: DataFrame) -> DataFrame:
    """One form a customer; only the numbers in a field's name differ, so a site has one template."""
    k = F.col("c_custkey").cast("string")
    html = F.concat(
        F.lit('<html><body><form action="/book" method="POST"><label for="nm">Your name *</label><input id="nm" name="field_'), k,
        F.lit('"><label>Email <input type="email" name="email"></label><input type="date" name="arrival" required><select name="segment"><option value="">choose</option><option value="'), "c_mktsegment", F.lit('">'), "c_mktsegment",
        F.lit('</option></select><input type="radio" name="kind" value="a"><input type="radio" name="kind" value="b"><input type="hidden" name="h"><button type="submit">Book now '), "c_mktsegment",
        F.lit('</button></form><iframe src="https://app.cloudbeds.com/w/'), (F.col("c_nationkey") % 3).cast("string"), F.lit('"></iframe></body></html>'),
    )
    url = F.concat(F.lit("https://n"), F.col("c_nationkey").cast("string"), F.lit(".example/rooms/"), k)
    return customer.select(F.col("c_custkey").alias("page_id"), url.alias("url"), html.alias("html"))


def control_pages(customer: DataFrame) -> DataFrame:
    """One form a customer whose controls are told by a lone id, a lone class or their place, and labelled in three ways or not at all."""
    k = F.col("c_custkey").cast("string")
    html = F.concat(
        F.lit('<html><body><form id="f'), k, F.lit('"><label for="u'), k, F.lit('">Name '), "c_mktsegment", F.lit('</label><input id="u'), k,
        F.lit('" name="who"><label>Mail <input class="mail wide" name="mail"></label><span><label>Phone</label><input class="wide" name="phone"></span><input aria-label="Extra" name="extra" id="dup">'
              '<input id="dup" name="last"><button class="go" type="submit">Send it</button></form></body></html>'),
    )
    return customer.select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("https://k"), F.col("c_nationkey").cast("string"), F.lit(".example/x/"), k).alias("url"), html.alias("html"))


def booking_pages(customer: DataFrame) -> DataFrame:
    """One page a customer with a booking bar, a dated form, a calendar and a booking frame."""
    k = F.col("c_custkey").cast("string")
    html = F.concat(
        F.lit('<html><body><div class="bar"><input name="checkin" placeholder="Check-in"><input placeholder="Check-out"><input placeholder="Guests"><button>Book now</button></div><form><label for="d">Day '), k,
        F.lit('</label><input id="d" type="date" name="day_'), k, F.lit('"></form><div class="calendar-box">May '), "c_mktsegment",
        F.lit('</div><iframe title="Booking" src="https://app.cloudbeds.com/w/'), (F.col("c_nationkey") % 3).cast("string"), F.lit('"></iframe></body></html>'),
    )
    return customer.select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("https://b"), F.col("c_nationkey").cast("string"), F.lit(".example/x/"), k).alias("url"), html.alias("html"))


def portfolio_pages(orders: DataFrame) -> DataFrame:
    """Page rows under /portfolio/, one an order, site by customer; areas in the text."""
    k = F.col("o_orderkey").cast("string")
    return orders.select(
        F.col("o_orderkey").alias("page_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(".example")).alias("site"),
        F.concat(F.lit("https://c"), F.col("o_custkey").cast("string"), F.lit(".example/portfolio/"), k).alias("url"), F.concat(F.lit("House "), k, F.lit(" | builder")).alias("title"),
        F.lit("general").alias("page_type"), F.concat(F.lit("Built with "), (F.col("o_orderkey") % 300).cast("string"), F.lit(" кв.м of floor")).alias("content"), F.lit(6).alias("word_count"), F.lit("ok").alias("status"), F.lit(False).alias("partial"),
    )


def tree_links(nation: DataFrame, customer: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(home, links): one site a region; home -> nations -> customers -> orders, and back home; carts are on the way."""
    site = lambda r: F.concat(F.lit("region"), r.cast("string"), F.lit(".example"))
    page = lambda r, *p: F.concat(F.lit("https://region"), r.cast("string"), F.lit(".example/"), *p)
    r = F.col("n_regionkey")
    n = F.col("n_nationkey").cast("string")
    c = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    o = orders.join(c, F.col("o_custkey") == F.col("c_custkey"))
    k, ok = F.col("c_custkey").cast("string"), F.col("o_orderkey").cast("string")
    row = lambda df, src, dst, order: df.select(site(r).alias("site"), src.alias("src"), dst.alias("dst"), order.cast("long").alias("ord"))
    links = (
        row(nation, page(r, F.lit("")), page(r, F.lit("n/"), n), F.col("n_nationkey"))
        .unionAll(row(nation, page(r, F.lit("")), page(r, F.lit("cart/"), n), F.col("n_nationkey") + 100))
        .unionAll(row(c, page(r, F.lit("n/"), n), page(r, F.lit("c/"), k), F.col("c_custkey")))
        .unionAll(row(c, page(r, F.lit("c/"), k), page(r, F.lit("")), F.lit(0)))
        .unionAll(row(o, page(r, F.lit("c/"), k), page(r, F.lit("o/"), ok), F.col("o_orderkey")))
    )
    from pageloom.functions import urls

    links = links.select("site", urls.url_key(F.col("src")).alias("src_key"), F.col("dst").alias("dst_url"), urls.url_key(F.col("dst")).alias("dst_key"), "ord")
    home = nation.select(site(r).alias("site"), page(r, F.lit("")).alias("url")).distinct()
    return home, links


def tagged_links(nation: DataFrame, customer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(home, links with their source): shops, which come first, and plain pages of nations, a third of them linked outside the home's navigation only; customers beneath."""
    from pageloom.functions import urls

    site = F.concat(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit(".example"))
    page = lambda *p: F.concat(F.lit("https://"), site, F.lit("/"), *p)
    n = F.col("n_nationkey")
    of_nation = page(F.when(n % 2 == 1, "shop/").otherwise("n/"), n.cast("string"))
    c = customer.join(nation, F.col("c_nationkey") == n)
    row = lambda df, src, dst, order, source: df.select(site.alias("site"), urls.url_key(src).alias("src_key"), dst.alias("dst_url"), urls.url_key(dst).alias("dst_key"), order.cast("long").alias("ord"), source.alias("source"))
    links = (
        row(nation, page(F.lit("")), of_nation, n, F.lit("all"))
        .unionAll(row(nation.filter(n % 3 == 1), page(F.lit("")), of_nation, n, F.lit("nav")))
        .unionAll(row(nation.filter(n % 3 == 2), page(F.lit("")), of_nation, n, F.lit("card")))
        .unionAll(row(c, of_nation, page(F.lit("c/"), F.col("c_custkey").cast("string")), F.col("c_custkey"), F.lit("all")))
    )
    return nation.select(site.alias("site"), page(F.lit("")).alias("url")).distinct(), links
