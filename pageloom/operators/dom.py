"""HTML to node tables: the one Arrow-batched helper, and Column helpers over its rows.

A page becomes one row: its text, and its elements in document order as an array of structs.
``pid`` is its parent, ``depth`` the number of its ancestors, ``last`` the number of its last descendant, so that an
element with its descendants is the interval from ``nid`` to ``last``; ``prev`` is the element before it under the same
parent, ``t0``/``t1`` bound its text. From one index of the page's ids, classes and labels each element knows
whether its id is the page's only one (``lone_id``), its first class that no other has (``lone_class``, else
empty) and the first label for its id (``label``, else -1). An element takes the same room however deep it lies;
ancestors are found by climbing. Everything else is Column functions over that array.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import urls
from pageloom.functions.binding import let
from pageloom.functions.regexes import ci, norm_ws

NODE = "struct<nid:int,pid:int,last:int,depth:int,prev:int,tag:string,nth:int,cls:string,id:string,attrs:map<string,string>,t0:int,t1:int,own:string,hidden:boolean,lone_id:boolean,lone_class:string,label:int>"
SCHEMA = f"page_id long, url string, title string, text string, nodes array<{NODE}>, parse_error boolean"

#: Elements without content, elements that start a line, and what a start tag ends. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
ENDS = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    **{t: {"p"} for t in ("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul")},
}
#: A start tag ends none of the above beyond these.
WALLS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
UNSEEN = frozenset(("script", "style", "template", "noscript", "head", "title"))


#: What the start of an element closes, and where the search for it ends; elements that close nothing are not named.
_CLOSES = {tag: (ended, WALLS.get(tag, {"td", "th", "li", "div", "section", "article"} | ({"button"} if tag != "p" else set()))) for tag, ended in ENDS.items()}
#: Tags without attributes, and the elements for which nothing else is to be looked at in them.
_PLAIN_START, _PLAIN_END = re.compile("<([a-zA-Z][a-zA-Z0-9]*)>"), re.compile("</([a-zA-Z][a-zA-Z0-9]*)>")
_PLAIN = BLOCK | frozenset("a b body br button em head html i label s small span strong sub sup u".split())
#: The fields of an element that the parser collects, each in a list of its own, and those that follow from them.
COLLECTED = ("pid", "last", "depth", "prev", "tag", "nth", "cls", "id", "attrs", "t0", "t1", "own", "hidden")
INDEXED = ("lone_id", "lone_class", "label")


class _Builder(HTMLParser):
    """Collects text and, if asked for, elements, field by field; a tree is never built."""

    def __init__(self, elements: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.elements = elements
        self.fields: dict[str, list] = {f: [] for f in COLLECTED}
        self.pid, self.last, self.depth, self.prev, self.tag, self.nth, self.cls, self.id, self.attrs, self.t0, self.t1, self.own, self.hidden = self.fields.values()
        self.open: list[int] = []
        self.unseen = self.titles = 0  # open elements of these kinds
        self.parts: list[str] = []
        self.size = 0
        self.title: list[str] = []
        self.kinds: dict[tuple[int, str], int] = {}
        self.youngest: dict[int, int] = {}

    def updatepos(self, i, j):
        """Lines and columns are not asked for, so they are not counted."""
        return j

    def parse_starttag(self, i):
        """A plain tag needs no search for attributes; any other is left to the base class."""
        found = _PLAIN_START.match(self.rawdata, i)
        if found and (tag := found[1].lower()) in _PLAIN:
            self.handle_starttag(tag, ())
            return found.end()
        return super().parse_starttag(i)

    def parse_endtag(self, i):
        found = _PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if found:
            self.handle_endtag(found[1].lower())
            return found.end()
        return super().parse_endtag(i)

    def _line(self) -> None:
        if self.parts and not self.parts[-1].endswith("\n"):
            self.parts.append("\n")
            self.size += 1

    def _close(self, depth: int) -> None:
        while len(self.open) > depth:
            nid = self.open.pop()
            tag = self.tag[nid]
            if self.elements:
                self.last[nid], self.t1[nid] = len(self.tag) - 1, self.size
            if tag in BLOCK:
                self._line()
            elif tag in UNSEEN:
                self.unseen -= 1
                self.titles -= tag == "title"

    def handle_starttag(self, tag, attrs) -> None:
        if tag in _CLOSES:
            ended, wall = _CLOSES[tag]
            for depth in range(len(self.open) - 1, -1, -1):
                name = self.tag[self.open[depth]]
                if name in ended:
                    self._close(depth)
                    if tag not in ("tr", "td", "th"):
                        break
                elif name in wall:
                    break
        if tag in BLOCK or tag == "br":
            self._line()
        if self.elements:
            self._element(tag, attrs)
        self.tag.append(tag)
        if tag not in VOID:
            self.open.append(len(self.tag) - 1)
            if tag in UNSEEN:
                self.unseen += 1
                self.titles += tag == "title"

    def _element(self, tag: str, attrs) -> None:
        pid = self.open[-1] if self.open else -1
        self.kinds[pid, tag] = nth = self.kinds.get((pid, tag), 0) + 1
        named = {k: v if v is not None else "" for k, v in reversed(attrs)} if attrs else {}
        style = named["style"].replace(" ", "").lower() if "style" in named else ""
        nid = len(self.tag)
        self.pid.append(pid)
        self.last.append(nid)
        self.depth.append(len(self.open))
        self.prev.append(self.youngest.get(pid, -1))
        self.nth.append(nth)
        self.cls.append(named.get("class", ""))
        self.id.append(named.get("id", ""))
        self.attrs.append(named)
        self.t0.append(self.size)
        self.t1.append(self.size)
        self.own.append("")
        self.hidden.append((pid >= 0 and self.hidden[pid]) or "hidden" in named or "display:none" in style or "visibility:hidden" in style or tag in UNSEEN)
        self.youngest[pid] = nid

    def handle_endtag(self, tag) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.tag[self.open[depth]] == tag:
                self._close(depth)
                return

    def handle_data(self, data) -> None:
        if self.titles:
            self.title.append(data)
        if self.elements and self.open:
            self.own[self.open[-1]] += data
        if not self.unseen and data:
            self.parts.append(data)
            self.size += len(data)


def _index(fields: dict[str, list]) -> None:
    """Ids, classes and labels of the page are counted once; each element takes from the counts what concerns it."""
    classes = [[c for c in re.split(r"[ \t\n\x0b\f\r]+", cls) if c] if cls else () for cls in fields["cls"]]
    ids, held, labels = Counter(i for i in fields["id"] if i), Counter(), {}
    for own in classes:
        if own:
            held.update(set(own))
    for nid, tag in enumerate(fields["tag"]):
        if tag == "label":
            labels.setdefault(fields["attrs"][nid].get("for", ""), nid)
    fields["lone_id"] = [i != "" and ids[i] == 1 for i in fields["id"]]
    fields["lone_class"] = [next((c for c in own if held[c] == 1), "") for own in classes]
    fields["label"] = [labels.get(i, -1) if i else -1 for i in fields["id"]]


def _parse(html: str | None, elements: bool = True) -> tuple[str, str, dict[str, list], bool]:
    """(title, text, fields of the elements, failed) of a page."""
    builder = _Builder(elements)
    try:
        builder.feed(html or "")
        builder.close()
        builder._close(0)
        if elements:
            _index(builder.fields)
    except Exception:  # a page that no parser can read is reported, not fatal
        return "", "", {f: [] for f in COLLECTED + INDEXED}, True
    return " ".join("".join(builder.title).split()), "".join(builder.parts), builder.fields, html is None


def parse(html: str | None) -> tuple[str, str, list[dict], bool]:
    """(title, text, nodes, failed) of a page."""
    title, text, fields, failed = _parse(html)
    nodes = [{"nid": nid, **dict(zip(fields, values, strict=True))} for nid, values in enumerate(zip(*fields.values(), strict=True))]
    return title, text, [n | {"attrs": list(n["attrs"].items())} for n in nodes], failed


def parse_pages(pages: DataFrame, elements: bool = True) -> DataFrame:
    """page_id, site, url, base_origin, title, text, nodes, parse_error of every page.

    Null html is a parse error with no nodes; rows are independent, so repeated rows repeat. Without ``elements`` the
    column ``nodes`` is left out, for jobs that ask for titles and texts only.
    """

    def work(batches):
        import pyarrow as pa

        kinds = {"tag": pa.string(), "cls": pa.string(), "id": pa.string(), "own": pa.string(), "lone_class": pa.string(), "hidden": pa.bool_(), "lone_id": pa.bool_()}

        def upto(counts):
            at = [0]
            for n in counts:
                at.append(at[-1] + n)
            return pa.array(at, pa.int32())

        def lists(pages_fields):
            # the fields of all elements of some pages, one flat array each
            arrays = {"nid": pa.array([k for f in pages_fields for k in range(len(f["tag"]))], pa.int32())}
            for name in COLLECTED + INDEXED:
                if name != "attrs":
                    arrays[name] = pa.array([v for f in pages_fields for v in f[name]], kinds.get(name, pa.int32()))
                    continue
                named = [v for f in pages_fields for v in f[name]]
                arrays[name] = pa.MapArray.from_arrays(upto(map(len, named)), pa.array([k for v in named for k in v], pa.string()), pa.array([x for v in named for x in v.values()], pa.string()))
            return pa.ListArray.from_arrays(upto(len(f["tag"]) for f in pages_fields), pa.StructArray.from_arrays(list(arrays.values()), names=list(arrays)))

        for batch in batches:
            for first in range(0, batch.num_rows, 64):  # long pages: few at a time
                part = batch.slice(first, 64)
                titles, texts, fields, failed = zip(*[_parse(h, elements) for h in part.column(2).to_pylist()], strict=True)
                columns = {"page_id": part.column(0), "url": part.column(1), "title": pa.array(titles, pa.string()), "text": pa.array(texts, pa.string())}
                if elements:
                    columns["nodes"] = lists(fields)
                yield pa.record_batch(columns | {"parse_error": pa.array(failed, pa.bool_())})

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    parsed = rows.mapInArrow(work, SCHEMA if elements else SCHEMA.replace(f"nodes array<{NODE}>, ", ""))
    return parsed.select(
        "page_id", urls.normalize_domain(F.col("url")).alias("site"), "url", urls.origin(F.col("url")).alias("base_origin"), "title", "text", *(["nodes"] if elements else []), "parse_error"
    )


# Columns over a node struct ``n``; the row's ``text`` and ``nodes`` are taken by name.


def raw_text(n: Column) -> Column:
    """Text of an element and all below it."""
    return F.substring(F.col("text"), n["t0"] + 1, n["t1"] - n["t0"])


def text_of(n: Column) -> Column:
    """``raw_text`` with single spaces."""
    return norm_ws(raw_text(n))


def attr(n: Column, name: str) -> Column:
    """Attribute value; empty if absent."""
    return F.coalesce(F.try_element_at(n["attrs"], F.lit(name)), F.lit(""))


def has_attr(n: Column, name: str) -> Column:
    return F.map_contains_key(n["attrs"], F.lit(name))


def tagged(n: Column, *tags: str) -> Column:
    return n["tag"].isin(*tags)


def cls_has(n: Column, *parts: str) -> Column:
    """[class*=...] of any part."""
    test = n["cls"].contains(parts[0])
    for p in parts[1:]:
        test = test | n["cls"].contains(p)
    return test


def id_has(n: Column, *parts: str) -> Column:
    test = n["id"].contains(parts[0])
    for p in parts[1:]:
        test = test | n["id"].contains(p)
    return test


def has_class(n: Column, name: str) -> Column:
    return n["cls"].rlike(rf"(?:^|\s){name}(?:\s|\z)")


def node(i: Column) -> Column:
    """The element of a number; null for -1."""
    return F.get(F.col("nodes"), i)


def up(n: Column, most: int | None = None) -> Column:
    """Numbers of the ancestors from the parent up, by climbing; of the nearest ``most`` ones."""
    steps = n["depth"] if most is None else F.least(n["depth"], F.lit(most))
    start = F.struct(F.array().cast("array<int>").alias("ids"), n["pid"].alias("at"))
    climb = lambda s, _: F.struct(F.concat(s["ids"], F.array(s["at"])).alias("ids"), node(s["at"])["pid"].alias("at"))
    return F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), steps), start, climb, lambda s: s["ids"])).otherwise(F.array().cast("array<int>"))


def ancestors(n: Column, most: int | None = None) -> Column:
    """Ancestor structs from the parent up."""
    return F.transform(up(n, most), node)


def nearest_ancestor(n: Column, test) -> Column:
    """The number of the nearest ancestor that passes the test; -1 if none does."""
    start = F.struct(F.lit(False).alias("found"), n["pid"].alias("at"))

    def climb(s: Column, _: Column) -> Column:
        passes = F.coalesce(test(node(s["at"])), F.lit(False))
        return F.when(s["found"], s).otherwise(let(passes, lambda p: F.struct(p.alias("found"), F.when(p, s["at"]).otherwise(node(s["at"])["pid"]).alias("at"))))

    found = F.aggregate(F.sequence(F.lit(1), n["depth"]), start, climb, lambda s: F.when(s["found"], s["at"]).otherwise(-1))
    return F.when(n["depth"] > 0, found).otherwise(-1)


def inside(n: Column, test) -> Column:
    """Does an ancestor pass the test?"""
    return nearest_ancestor(n, test) >= 0


def within(n: Column, test) -> Column:
    """closest(): does the element or an ancestor pass the test?"""
    return test(n) | inside(n, test)


def below(n: Column) -> Column:
    """Descendant structs in document order."""
    return F.when(n["last"] > n["nid"], F.transform(F.sequence(n["nid"] + 1, n["last"]), lambda i: node(i))).otherwise(F.array().cast(f"array<{NODE}>"))  # F.slice copies the whole page each time


def children(n: Column) -> Column:
    return F.filter(below(n), lambda m: m["pid"] == n["nid"])


def select_nodes(test) -> Column:
    """Elements of the page that pass a test, in document order."""
    return F.filter(F.col("nodes"), test)


def first_of(array: Column) -> Column:
    return F.get(array, F.lit(0))


def like(c: Column, pattern: str) -> Column:
    return c.rlike(ci(pattern))
