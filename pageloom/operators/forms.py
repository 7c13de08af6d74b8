"""Buttons, forms, choices and booking capabilities of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import lexicon, text, urls
from pageloom.functions.binding import let
from pageloom.functions.regexes import trim_ws
from pageloom.operators import dom

MOST_BUTTONS, MOST_FORMS = 30, 10
#: Verbs of submit buttons; step words; parts of a booking bar. Fixed values.
SUBMIT = "submit|send|book|reserve|save|go|apply|confirm|order|buy|purchase|изпрати|запази|резерв|senden|buchen|prenota|réserver|reservar|enviar|envoyer|bestellen|comprar|acheter|acquista"
NOT_OPTIONS = "next|back|prev|forward|submit|send|cancel|close|continue|save|book|reserve|confirm|order|buy|напред|назад|изпрати|запази|резерв|затвори|отказ|weiter|zurück|siguiente|anterior|suivant|précédent|avanti|indietro|dalej|wstecz|ileri|geri"
NEXT = "submit|send|next|forward|continue|book|reserve|save|confirm|go|apply|изпрати|напред|запази|резерв|weiter|siguiente|suivant|avanti|dalej|ileri"
TURNS = "next|back|prev|forward|continue|step|напред|назад|стъпка|weiter|zurück|siguiente|anterior|suivant|précédent|avanti|indietro|dalej|wstecz|ileri|geri"
#: Parts of class names of steps, of what holds them, and of step indicators. Fixed values.
STEPS = ("step", "wizard")
STEP_HOLDERS = ("wizard", "step-container", "form-wrapper", "multistep", "multi-step", "stepper")
STEP_MARKS = ("step-indicator", "progress-step", "step-nav", "stepper", "step-number", "form-progress")
BAR = {
    "check_in": r"check\s*-?in|arrival|checkin|пристигане|настаняване|anreise|arrivée|llegada|arrivo|приезд|giriş",
    "check_out": r"check\s*-?out|departure|checkout|напускане|заминаване|abreise|départ|salida|partenza|отъезд|çıkış",
    "guests": r"adults?|guests?|persons?|people|rooms?|children|kids|pax|гости|възрастни|деца|стаи?|gäste|invités|huéspedes|ospiti|гостей|misafir|promo\s*code|промо\s*код|coupon|gutschein",
    "action": r"book(?:\s*now)?|reserve|search|availability|check|find|резервирай|резервация|провери|търси|buchen|réserver|reservar|prenota|забронировать|ara|boka",
}


def css_escape(c: Column) -> Column:
    """A class or id as a CSS identifier: other characters get a backslash, a leading digit its code."""
    escaped = F.regexp_replace(c, r"([^\-A-Za-z0-9_\x{80}-\x{10FFFF}])", r"\\\\$1")
    digit = F.concat(F.lit("\\3"), F.substring(c, 1, 1), F.lit(" "), F.regexp_replace(F.substring(c, 2, 1_000_000), r"([^\-A-Za-z0-9_\x{80}-\x{10FFFF}])", r"\\\\$1"))
    return F.when(c.rlike("^[0-9]"), digit).otherwise(escaped)


def unique_selector(n: Column) -> Column:
    """``#id`` if the page has it once, else its first class that the page has once, else tag and place among like siblings."""
    return (
        F.when(n["lone_id"], F.concat(F.lit("#"), css_escape(n["id"])))
        .when(n["lone_class"] != "", F.concat(F.lit("."), css_escape(n["lone_class"])))
        .otherwise(F.concat(n["tag"], F.lit(":nth-of-type("), n["nth"].cast("string"), F.lit(")")))
    )


def selector_candidates(n: Column) -> Column:
    """Up to six selectors of an element, from the most to the least specific."""
    quoted = lambda a: F.when(dom.attr(n, a) != "", F.concat(n["tag"], F.lit(f'[{a}="'), dom.attr(n, a), F.lit('"]')))
    by_id = F.when(n["id"] != "", F.concat(F.lit("#"), css_escape(n["id"])))
    place = F.concat(n["tag"], F.lit(":nth-of-type("), n["nth"].cast("string"), F.lit(")"))
    every = F.array(by_id, quoted("name"), quoted("aria-label"), quoted("placeholder"), quoted("type"), unique_selector(n), place)
    return F.slice(F.array_distinct(F.filter(every, lambda x: x.isNotNull())), 1, 6)


def field_label(n: Column, with_aria: bool = False) -> Column:
    """Label by ``for``, else the enclosing label, else (capabilities) aria-label, else the label before it."""
    around = dom.node(dom.nearest_ancestor(n, lambda m: m["tag"] == "label"))
    before = let(dom.node(n["prev"]), lambda m: F.when(m["tag"] == "label", m))
    words = lambda m: F.when(m.isNotNull(), trim_ws(dom.raw_text(m)))
    aria = F.when(dom.attr(n, "aria-label") != "", dom.attr(n, "aria-label")) if with_aria else F.lit(None).cast("string")
    return F.coalesce(let(dom.node(n["label"]), words), let(around, words), aria, let(before, words), F.lit(""))


def with_controls(pages_dom: DataFrame) -> DataFrame:
    """``pages_dom`` with ``selectors`` (of controls) and ``labels``, one entry an element; capabilities look them up."""
    control = lambda n: n["tag"].isin("input", "select", "textarea", "button", "option") | (dom.attr(n, "role") != "")
    selectors = F.transform(F.col("nodes"), lambda n: F.when(control(n), selector_candidates(n)))
    return pages_dom.withColumns({"selectors": selectors, "labels": F.transform(F.col("nodes"), lambda n: field_label(n, True))})


def _selectors(n: Column) -> Column:
    return F.get(F.col("selectors"), n["nid"])


def _label(n: Column) -> Column:
    return F.get(F.col("labels"), n["nid"])


def _shown(n: Column) -> Column:
    return let(trim_ws(dom.raw_text(n)), lambda t: F.when(t != "", t).otherwise(dom.attr(n, "value")))


def buttons_of_page() -> Column:
    """Array of (ord, text, selector): button-like elements with a text and no foreign or script target, 30 a page."""
    like_button = lambda n: (
        (n["tag"] == "button") | ((n["tag"] == "a") & dom.has_attr(n, "href")) | (dom.attr(n, "role") == "button")
        | ((n["tag"] == "input") & dom.attr(n, "type").isin("submit", "button")) | dom.has_class(n, "btn") | dom.has_class(n, "button")
    )

    def target_ok(n: Column) -> Column:
        href = dom.attr(n, "href")
        same_host = F.coalesce(urls.absolute(href, F.col("url")).contains(urls.hostname(F.col("url"))), F.lit(False))
        return (n["tag"] != "a") | (href == "") | (~href.rlike("^(?:javascript|mailto|tel):") & same_host)

    button = lambda n: F.struct(n["nid"].alias("ord"), F.substring(_shown(n), 1, 100).alias("text"), unique_selector(n).alias("selector"))
    found = F.transform(dom.select_nodes(lambda n: like_button(n) & ~n["hidden"] & target_ok(n)), button)
    return F.slice(F.filter(found, lambda x: F.length(x["text"]) >= 2), 1, MOST_BUTTONS)


def extract_buttons(pages_dom: DataFrame) -> DataFrame:
    """(page_id, site, ord, text, selector): a row for each of ``buttons_of_page``."""
    return pages_dom.select("page_id", "site", F.explode(buttons_of_page()).alias("b")).select("page_id", "site", "b.*")


def _fields(form: Column) -> Column:
    return F.filter(dom.below(form), lambda m: (((m["tag"] == "input") & ~F.lower(dom.attr(m, "type")).isin("hidden", "submit")) | m["tag"].isin("select", "textarea")) & ~m["hidden"])


def forms_of_page() -> Column:
    """Array of (ord, selector, submit_button, fields): visible forms with a field, 10 a page."""

    def field(m: Column, i: Column) -> Column:
        name = F.coalesce(F.nullif(dom.attr(m, "name"), F.lit("")), F.nullif(m["id"], F.lit("")), F.concat(F.lit("field_"), i.cast("string")))
        kind = F.when(m["tag"] == "select", "select-one").when(m["tag"] == "textarea", "textarea").when(dom.attr(m, "type") == "", "text").otherwise(F.lower(dom.attr(m, "type")))
        return F.struct(name.alias("name"), unique_selector(m).alias("selector"), kind.alias("type"), dom.attr(m, "placeholder").alias("placeholder"), field_label(m).alias("label"))

    sends = lambda m: (m["tag"].isin("button", "input") & (dom.attr(m, "type") == "submit")) | ((m["tag"] == "button") & ~dom.has_attr(m, "type"))
    submit = lambda f: let(dom.first_of(F.filter(dom.below(f), sends)), lambda b: F.when(b.isNotNull(), unique_selector(b)).otherwise(""))
    row = lambda f: F.struct(f["nid"].alias("ord"), unique_selector(f).alias("selector"), submit(f).alias("submit_button"), F.transform(_fields(f), field).alias("fields"))
    found = F.filter(F.transform(dom.select_nodes(lambda n: (n["tag"] == "form") & ~n["hidden"]), row), lambda x: F.size(x["fields"]) > 0)
    return F.slice(found, 1, MOST_FORMS)


def extract_forms(pages_dom: DataFrame) -> DataFrame:
    """(page_id, site, ord, selector, submit_button, fields): a row for each of ``forms_of_page``."""
    return pages_dom.select("page_id", "site", F.explode(forms_of_page()).alias("f")).select("page_id", "site", "f.*")


def enrich_buttons(buttons: DataFrame) -> DataFrame:
    return buttons.withColumns({"keywords": lexicon.keywords(F.col("text")), "action_type": lexicon.action_type(F.col("text"))})


def rich_field(f: Column) -> Column:
    """A form field as (name, selector, type, keywords)."""
    return F.struct(
        f["name"].alias("name"), f["selector"].alias("selector"), lexicon.field_type(f["name"], f["type"], f["placeholder"], f["label"]).alias("type"),
        lexicon.field_keywords(f["name"], f["placeholder"], f["label"]).alias("keywords"),
    )


def enrich_forms(forms: DataFrame) -> DataFrame:
    """Fields as (name, selector, type, keywords)."""
    return forms.withColumn("fields", F.transform("fields", rich_field))


def _required(m: Column, label: Column) -> Column:
    return dom.has_attr(m, "required") | (dom.attr(m, "aria-required") == "true") | dom.like(label, r"\*|задължително|required")


def _button_groups(root: Column, option) -> Column:
    """Pressed, radio-role and segmented buttons by the label of their parent, then sibling buttons with short option texts."""
    inner = dom.below(root)
    said = lambda m: trim_ws(dom.raw_text(m))
    parent = lambda m: F.get(F.col("nodes"), m["pid"])
    marked = lambda m: ((m["tag"] == "button") & dom.has_attr(m, "aria-pressed")) | (dom.attr(m, "role") == "radio")
    segmented = lambda m: (m["tag"] == "button") & dom.inside(m, lambda a: dom.has_class(a, "segmented"))
    pressed = F.filter(inner, lambda m: (marked(m) | segmented(m)) & ~m["hidden"] & (F.length(said(m)) >= 2))
    titled = F.transform(pressed, lambda m: F.struct(let(parent(m), lambda p: F.when(p.isNotNull(), _label(p)).otherwise("")).alias("label"), option(said(m), said(m), m).alias("option")))
    group = lambda label, options, needed, name: F.struct(name.alias("name"), label.alias("label"), needed.alias("required"), F.lit("button_group").alias("type"), options.alias("options"))
    own = lambda t, label: F.transform(F.filter(t, lambda x: x["label"] == label), lambda x: x["option"])
    first = let(titled, lambda t: F.transform(F.array_distinct(F.transform(t, lambda x: x["label"])), lambda label: group(label, own(t, label), F.lit(False), F.when(label != "", label).otherwise("button_group"))))

    plain = lambda m: (m["tag"] == "button") & ~m["hidden"]
    starts = F.filter(inner, lambda m: plain(m) & ~marked(m))
    boxes = F.array_distinct(F.transform(starts, lambda m: m["pid"]))

    def box(i: Column) -> Column:
        p = F.get(F.col("nodes"), i)
        beside = F.filter(dom.below(p), lambda m: plain(m) & ((m["pid"] == i) | (parent(m)["pid"] == i)))
        options = F.filter(beside, lambda m: F.length(said(m)).between(1, 30) & ~dom.like(said(m), NOT_OPTIONS))
        spoken = let(dom.node(p["prev"]), lambda b: F.when(b.isNotNull() & F.length(said(b)).between(2, 60), said(b)))
        label = F.coalesce(spoken, _label(p))
        clean = trim_ws(F.regexp_replace(label, r"\s*\*\s*$", ""))
        made = group(clean, F.transform(options, lambda m: option(said(m), said(m), m)), dom.like(label, r"\*|задължително|required"), F.when(clean != "", clean).otherwise("button_choice"))
        return F.when((F.size(beside) >= 2) & (F.size(options) >= 2), made)

    # of groups with one name the first stays
    second = F.filter(F.transform(boxes, box), lambda g: g.isNotNull())
    once = let(second, lambda s: F.filter(s, lambda g, i: ~F.exists(F.slice(s, 1, i), lambda o: o["name"] == g["name"])))
    return let(first, lambda f: F.concat(f, F.filter(once, lambda g: ~F.exists(f, lambda o: o["name"] == g["name"]))))


def choices_of(root: Column) -> Column:
    """Radio groups by name, button groups, then selects without their placeholder options: (name, label, required, type, options)."""
    inner = dom.below(root)
    option = lambda v, label, m: F.struct(v.alias("value"), label.alias("label"), _selectors(m).alias("selector_candidates"))
    radios = F.filter(inner, lambda m: (m["tag"] == "input") & (F.lower(dom.attr(m, "type")) == "radio") & (dom.attr(m, "name") != ""))

    def group(name: Column) -> Column:
        own = F.filter(radios, lambda m: dom.attr(m, "name") == name)
        legend = dom.first_of(F.filter(F.flatten(F.transform(F.filter(dom.ancestors(dom.first_of(own)), lambda a: a["tag"] == "fieldset"), dom.below)), lambda m: m["tag"] == "legend"))
        label = let(legend, lambda g: F.when(g.isNotNull(), dom.text_of(g)).otherwise(name))
        return F.struct(name.alias("name"), label.alias("label"), F.exists(own, lambda m: dom.has_attr(m, "required")).alias("required"), F.lit("radio").alias("type"), F.transform(own, lambda m: option(dom.attr(m, "value"), _label(m), m)).alias("options"))

    def select(m: Column) -> Column:
        options = F.filter(dom.below(m), lambda o: (o["tag"] == "option") & (F.when(dom.has_attr(o, "value"), dom.attr(o, "value")).otherwise(dom.text_of(o)) != ""))
        name = F.coalesce(F.nullif(dom.attr(m, "name"), F.lit("")), m["id"])
        return F.struct(name.alias("name"), _label(m).alias("label"), dom.has_attr(m, "required").alias("required"), F.lit("select").alias("type"), F.transform(options, lambda o: option(F.when(dom.has_attr(o, "value"), dom.attr(o, "value")).otherwise(dom.text_of(o)), dom.text_of(o), o)).alias("options"))

    return F.concat(F.transform(F.array_distinct(F.transform(radios, lambda m: dom.attr(m, "name"))), group), _button_groups(root, option), F.transform(F.filter(inner, lambda m: m["tag"] == "select"), select))


def extract_choices(pages_dom: DataFrame) -> DataFrame:
    """(page_id, site, name, label, required, type, options) of the choices of every form."""
    every = F.flatten(F.transform(dom.select_nodes(lambda n: n["tag"] == "form"), choices_of))
    return with_controls(pages_dom).select("page_id", "site", F.explode(every).alias("c")).select("page_id", "site", "c.*")


def _schema(root: Column, says) -> Column:
    """struct(fields, choices, submit) of a form-like element; the first button whose text ``says`` so, else the first button."""

    def field(m: Column) -> Column:
        kind = F.lower(F.coalesce(F.nullif(dom.attr(m, "type"), F.lit("")), m["tag"]))
        name = F.coalesce(F.nullif(dom.attr(m, "name"), F.lit("")), m["id"])
        return let(_label(m), lambda w: F.struct(
            m["tag"].alias("tag"), kind.alias("type"), name.alias("name"), w.alias("label"), dom.attr(m, "placeholder").alias("placeholder"), _required(m, w).alias("required"),
            dom.attr(m, "autocomplete").alias("autocomplete"), dom.attr(m, "aria-label").alias("aria_label"), dom.attr(m, "aria-describedby").alias("aria_describedby"), _selectors(m).alias("selector_candidates"),
        ))

    buttons = F.filter(dom.below(root), lambda m: ((m["tag"] == "button") | ((m["tag"] == "input") & (dom.attr(m, "type") == "submit")) | (dom.attr(m, "role") == "button")) & ~m["hidden"])
    labelled = F.filter(F.transform(buttons, lambda m: F.struct(F.substring(_shown(m), 1, 80).alias("text"), _selectors(m).alias("selector_candidates"))), lambda b: b["text"] != "")
    best = let(labelled, lambda b: F.coalesce(dom.first_of(F.filter(b, lambda x: says(x["text"]))), dom.first_of(b)))
    return F.struct(F.transform(F.filter(_fields(root), lambda m: F.lower(dom.attr(m, "type")) != "radio"), field).alias("fields"), choices_of(root).alias("choices"), best.alias("submit"))


def _meaningful(s: Column) -> Column:
    return F.exists(s["fields"], lambda f: ~f["type"].isin("hidden", "submit", "button", "reset", "image"))


def _schema_rows(*kinds: str) -> Column:
    """Structs (kind, ord, schema_json, dom_snapshot) of the page's forms with a meaningful field and wizards with a field or a choice.

    The schema of a wizard also has its number of steps and up to ten texts of step indicators.
    """
    root_of = lambda kind, i: F.struct(F.lit(kind).alias("kind"), i.alias("ord"))
    found = {
        "form": lambda: F.transform(dom.select_nodes(lambda n: (n["tag"] == "form") & ~n["hidden"]), lambda n: root_of("form", n["nid"])),
        "wizard": lambda: F.transform(_wizard_roots(), lambda i: root_of("wizard", i)),
    }

    def said(root: Column) -> Column:
        parts = F.filter(dom.below(root), lambda m: dom.cls_has(m, "step", "progress") | dom.has_attr(m, "data-step"))
        texts = F.filter(F.transform(parts, lambda m: trim_ws(dom.raw_text(m))), lambda t: F.length(t).between(2, 79))
        return F.slice(F.array_distinct(texts), 1, 10)

    def row(r: Column) -> Column:
        return let(dom.node(r["ord"]), lambda root: made(r, root))

    def made(r: Column, root: Column) -> Column:
        is_form = r["kind"] == "form"
        says = lambda t: F.when(is_form, dom.like(t, SUBMIT)).otherwise(dom.like(t, NEXT))
        parts = lambda s: [s["fields"].alias("fields"), s["choices"].alias("choices"), s["submit"].alias("submit")]
        as_form = lambda s: F.struct(*parts(s), dom.attr(root, "action").alias("action"), F.lower(F.coalesce(F.nullif(dom.attr(root, "method"), F.lit("")), F.lit("get"))).alias("method"))
        as_wizard = lambda s: F.struct(
            *parts(s), F.lit(True).alias("is_multi_step"), text.total_steps(dom.raw_text(root)).alias("total_steps"), said(root).alias("step_indicators"), F.lit("").alias("action"), F.lit("post").alias("method")
        )

        def whole(s: Column) -> Column:
            good = F.when(is_form, _meaningful(s)).otherwise((F.size(s["fields"]) > 0) | (F.size(s["choices"]) > 0))
            json = F.when(is_form, F.to_json(as_form(s))).otherwise(F.to_json(as_wizard(s)))
            return F.when(good, F.struct(r["kind"].alias("kind"), r["ord"].alias("ord"), json.alias("schema_json"), F.substring(dom.text_of(root), 1, 4000).alias("dom_snapshot")))

        return let(_schema(root, says), whole)

    return F.transform(F.concat(*[found[k]() for k in kinds]), row)


def _wizard_roots() -> Column:
    """Numbers of the roots of wizards outside forms, in document order.

    A root is what holds a step (else the step itself) if an input is seen in it; the nearest of five
    containers of a step indicator with one such input; the nearest of six of a next or back button with two.
    """
    node = lambda i: F.get(F.col("nodes"), i)
    free = lambda n: ~n["hidden"] & ~dom.within(n, lambda a: a["tag"] == "form")
    inputs = lambda i: F.size(_fields(node(i)))
    nearest = lambda n, most, least: dom.first_of(F.filter(dom.up(n, most), lambda i: inputs(i) >= least))
    holder = lambda n: F.coalesce(dom.first_of(F.filter(F.concat(F.array(n["nid"]), dom.up(n)), lambda i: dom.cls_has(node(i), *STEP_HOLDERS))), n["nid"])

    steps = dom.select_nodes(lambda n: (dom.cls_has(n, *STEPS) | dom.has_attr(n, "data-step")) & free(n))
    by_step = F.filter(F.array_distinct(F.transform(steps, holder)), lambda i: inputs(i) >= 1)
    marks = dom.select_nodes(lambda n: dom.cls_has(n, *STEP_MARKS) & free(n))
    turns = dom.select_nodes(lambda n: ((n["tag"] == "button") | (dom.attr(n, "role") == "button") | ((n["tag"] == "a") & dom.cls_has(n, "btn"))) & free(n) & dom.like(dom.raw_text(n), TURNS))
    every = F.concat(by_step, F.transform(marks, lambda n: nearest(n, 5, 1)), F.transform(turns, lambda n: nearest(n, 6, 2)))
    return F.array_sort(F.array_distinct(F.filter(every, lambda i: i.isNotNull())))


def _widget_rows() -> Column:
    """Iframes with a source: vendor and whether they look like booking."""

    def row(n: Column) -> Column:
        said = F.concat_ws(" ", dom.attr(n, "src"), dom.attr(n, "title"), dom.attr(n, "name"))
        vendor = lexicon.vendor(said)
        hint = F.when(n["id"] != "", F.concat(F.lit("#"), css_escape(n["id"]))).when(vendor != "unknown", F.concat(F.lit('iframe[src*="'), vendor, F.lit('"]'))).otherwise("iframe")
        schema = F.struct(dom.attr(n, "src").alias("src"), dom.attr(n, "title").alias("title"), dom.attr(n, "name").alias("name"), vendor.alias("vendor"), (~n["hidden"]).alias("visible"), lexicon.booking_like(said).alias("booking_like"), F.array(hint).alias("selector_candidates"))
        return F.struct(n["nid"].alias("ord"), F.to_json(schema).alias("schema_json"), F.lit(None).cast("string").alias("dom_snapshot"))

    return F.transform(dom.select_nodes(lambda n: (n["tag"] == "iframe") & (dom.attr(n, "src") != "")), row)


def _availability_rows() -> Column:
    """Availability: visible booking iframes, date inputs, calendar containers."""
    said = lambda n: F.concat_ws(" ", dom.attr(n, "src"), dom.attr(n, "title"), dom.attr(n, "name"))
    as_row = lambda o, s: F.struct(o.alias("ord"), F.to_json(s).alias("schema_json"), F.lit(None).cast("string").alias("dom_snapshot"))

    def frame(n: Column) -> Column:
        vendor = let(lexicon.vendor(said(n)), lambda v: F.when(v == "unknown", "iframe_booking").otherwise(v))
        return as_row(n["nid"], F.struct(F.lit("iframe_booking_widget").alias("ui_type"), vendor.alias("booking_vendor"), dom.attr(n, "src").alias("iframe_src"), F.lit(True).alias("detection_grade"), F.lit(False).alias("execution_grade")))

    frames = F.transform(dom.select_nodes(lambda n: (n["tag"] == "iframe") & (dom.attr(n, "src") != "") & ~n["hidden"] & lexicon.booking_like(said(n))), frame)
    dates = F.slice(dom.select_nodes(lambda n: (n["tag"] == "input") & (F.lower(dom.attr(n, "type")) == "date") & ~n["hidden"]), 1, 10)
    dated = F.transform(dates, lambda m: F.struct(F.coalesce(F.nullif(dom.attr(m, "name"), F.lit("")), m["id"]).alias("name"), _label(m).alias("label"), _selectors(m).alias("selector_candidates"), _required(m, F.lit("")).alias("required")))
    calendars = F.slice(dom.select_nodes(lambda n: (dom.cls_has(n, "calendar", "datepicker") | dom.id_has(n, "calendar", "datepicker")) & ~n["hidden"]), 1, 8)
    boxes = F.transform(calendars, lambda n: F.struct(selector_candidates(n).alias("selector_candidates"), F.substring(trim_ws(dom.raw_text(n)), 1, 120).alias("text_hint")))
    some = lambda a, o, s: F.when(F.size(a) > 0, F.array(as_row(F.lit(o), s))).otherwise(F.array().cast("array<struct<ord:int,schema_json:string,dom_snapshot:string>>"))
    return F.concat(frames, some(dates, 1_000_000, F.struct(dated.alias("date_inputs"))), some(calendars, 1_000_001, F.struct(boxes.alias("calendar_containers"))))


def _bars() -> Column:
    """Structs (ord, score, execution_grade, signals, good): containers of a call to action that look like a booking bar, six a page.

    Up to eight containers above each action are scored: check-in 2, check-out 2, guests 1, action 2, three or
    more signals 1, two or more controls 1, an action and two inputs 2 more. Needed are check-in, check-out or
    guests, an action, and a score of 5.
    """
    spoken = lambda m: F.concat_ws(" ", dom.raw_text(m), dom.attr(m, "aria-label"), dom.attr(m, "placeholder"), dom.attr(m, "value"), dom.attr(m, "title"))
    calls = dom.select_nodes(lambda n: ((n["tag"] == "button") | ((n["tag"] == "input") & dom.attr(n, "type").isin("submit", "button")) | (dom.attr(n, "role") == "button") | (n["tag"] == "a")) & ~n["hidden"] & dom.like(spoken(n), BAR["action"]) & (F.length(spoken(n)) <= 80))
    places = F.array_distinct(F.flatten(F.transform(calls, lambda n: dom.up(n, 8))))

    def scored(i: Column) -> Column:
        root = F.get(F.col("nodes"), i)
        inner = dom.below(root)
        controls = F.filter(inner, lambda m: m["tag"].isin("input", "select", "button", "textarea") | (dom.attr(m, "role") == "button"))
        every = F.concat_ws(" ", dom.raw_text(root), F.array_join(F.transform(inner, lambda m: F.concat_ws(" ", dom.attr(m, "aria-label"), dom.attr(m, "placeholder"), dom.attr(m, "name"))), " "))
        has = lambda k: dom.like(every, BAR[k])
        acts = F.exists(controls, lambda m: (m["tag"] == "button") & dom.like(spoken(m), BAR["action"])) | F.exists(inner, lambda m: (m["tag"] == "a") & dom.like(spoken(m), BAR["action"]))
        flags = F.struct(has("check_in").alias("check_in"), has("check_out").alias("check_out"), has("guests").alias("guests"), acts.alias("action"), F.size(controls).alias("controls"), F.size(F.filter(inner, lambda m: m["tag"].isin("input", "select"))).alias("inputs"))

        def total(f: Column) -> Column:
            one = lambda c, k: F.when(c, k).otherwise(0)
            signals = one(f["check_in"], 1) + one(f["check_out"], 1) + one(f["guests"], 1) + one(f["action"], 1)
            ready = f["action"] & (f["inputs"] >= 2)
            score = one(f["check_in"], 2) + one(f["check_out"], 2) + one(f["guests"], 1) + one(f["action"], 2) + one(signals >= 3, 1) + one(f["controls"] >= 2, 1) + one(ready, 2)
            return F.struct(i.alias("ord"), score.alias("score"), ready.alias("execution_grade"), f.alias("signals"), (f["check_in"] & (f["check_out"] | f["guests"]) & f["action"] & (score >= 5)).alias("good"))

        return let(flags, total)

    best = F.sort_array(F.transform(F.filter(F.transform(places, scored), lambda x: x["good"]), lambda x: F.struct((-x["score"]).alias("s"), x["ord"].alias("ord"), x.alias("x"))))
    return F.transform(F.slice(best, 1, 6), lambda b: b["x"])


def score_booking_bars(pages_dom: DataFrame) -> DataFrame:
    """(page_id, site, url, ord, score, execution_grade, signals) of the booking bars of each page."""
    rows = pages_dom.select("page_id", "site", "url", F.explode(_bars()).alias("b"))
    return rows.select("page_id", "site", "url", "b.ord", "b.score", "b.execution_grade", "b.signals")


def _bar_rows() -> Column:
    fields = lambda b: F.struct(*[b["signals"][k].alias(k) for k in ("check_in", "check_out", "guests")])
    schema = lambda b: F.to_json(F.struct(F.lit("booking_bar").alias("ui_type"), b["score"].alias("score"), b["execution_grade"].alias("execution_grade"), fields(b).alias("detected_fields")))
    return F.transform(_bars(), lambda b: F.struct((b["ord"] + 2_000_000).alias("ord"), schema(b).alias("schema_json"), F.lit(None).cast("string").alias("dom_snapshot")))


def _of_kind(kind: str, rows: Column) -> Column:
    return F.transform(rows, lambda x: F.struct(F.lit(kind).alias("kind"), x["ord"].alias("ord"), x["schema_json"].alias("schema_json"), x["dom_snapshot"].alias("dom_snapshot")))


def _capabilities(pages_dom: DataFrame, *rows: Column) -> DataFrame:
    """(page_id, site, url, kind, ord, schema_json, dom_snapshot): the arrays of all kinds are made in one pass over the page."""
    typed = [F.transform(F.filter(a, lambda x: x.isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["ord"].cast("int").alias("ord"), x["schema_json"].alias("schema_json"), x["dom_snapshot"].alias("dom_snapshot"))) for a in rows]
    found = with_controls(pages_dom).select("page_id", "site", "url", F.explode(F.concat(*typed)).alias("c"))
    return found.select("page_id", "site", "url", "c.*")


def cap_forms(pages_dom: DataFrame) -> DataFrame:
    """Capabilities of kind form."""
    return _capabilities(pages_dom, _schema_rows("form"))


def cap_wizards(pages_dom: DataFrame) -> DataFrame:
    """Capabilities of kind wizard."""
    return _capabilities(pages_dom, _schema_rows("wizard"))


def cap_widgets(pages_dom: DataFrame) -> DataFrame:
    """Capabilities of kind booking_widget."""
    return _capabilities(pages_dom, _of_kind("booking_widget", _widget_rows()))


def cap_availability(pages_dom: DataFrame) -> DataFrame:
    """Capabilities of kind availability: booking frames, date inputs, calendars, booking bars."""
    return _capabilities(pages_dom, _of_kind("availability", F.concat(_availability_rows(), _bar_rows())))


def page_capabilities(pages_dom: DataFrame) -> DataFrame:
    """All capabilities of each page."""
    availability = _of_kind("availability", F.concat(_availability_rows(), _bar_rows()))
    return _capabilities(pages_dom, _schema_rows("form", "wizard"), _of_kind("booking_widget", _widget_rows()), availability)
