"""Item and field extraction from stored HTML, to long and wide tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

# fixed values: elements without content, and elements that an opening tag closes
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSED_BY = {
    "p": {"p", "div", "ul", "ol", "table", "section", "article", "nav", "header", "footer", "form", "h1", "h2", "h3", "h4",
          "h5", "h6", "pre", "blockquote", "main", "aside", "address", "figure", "hr", "dl", "fieldset"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
}
# an implied end never crosses one of these
WALLS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"},
         "thead": {"table"}, "tbody": {"table"}, "p": {"div", "article", "section", "td", "li", "body", "button"}}
# fixed values: container selectors tried by the pattern detection, and its field selectors
PATTERNS = ["article", "[class*=card]", "[class*=item]", "[class*=product]", "[class*=story]", "li", "tr", ".athing"]
PATTERN_FIELDS = {"title": "h1, h2, h3, h4, [class*=title], .titleline a, a.storylink", "link": "a[href]", "score": "[class*=score], .score"}


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent", "nth", "tags")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.kids, self.tags = tag, attrs, parent, [], {}
        self.nth = 1
        if parent:
            self.nth = parent.tags[tag] = parent.tags.get(tag, 0) + 1

    def walk(self) -> Iterator["Node"]:
        stack = [k for k in reversed(self.kids) if isinstance(k, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(k for k in reversed(n.kids) if isinstance(k, Node))

    def text(self) -> str:
        out, stack = [], list(reversed(self.kids))
        while stack:
            k = stack.pop()
            if isinstance(k, Node):
                stack.extend(reversed(k.kids))
            else:
                out.append(k)
        return "".join(out)


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        n = self.here
        while n is not None and n.tag != "#root":
            if tag in CLOSED_BY.get(n.tag, ()):
                self.here = n.parent
                break
            if any(n.tag in WALLS.get(t, ()) for t in CLOSED_BY if tag in CLOSED_BY[t]):
                break
            n = n.parent
        node = Node(tag, {k: (v or "") for k, v in attrs}, self.here)
        self.here.kids.append(node)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        n = self.here
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.here = n.parent

    def handle_data(self, data):
        self.here.kids.append(data)


def parse(html: str) -> Node:
    b = TreeBuilder()
    b.feed(html or "")
    b.close()
    return b.root


_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([*^$~]?)=\"?'?([^\"'\]]*)\"?'?)?\]|:nth-of-type\((\d+)\)")


def compile_selector(sel: str) -> list[list[tuple[bool, list]]]:
    """Selector list to chains of (is_child, tests); tests are (kind, name, value)."""
    out = []
    for one in sel.split(","):
        chain, child = [], False
        for word in re.sub(r"\s*>\s*", " > ", one.strip()).split():
            if word == ">":
                child = True
                continue
            tests = []
            for m in _SIMPLE.finditer(word):
                tag, cls, ident, attr, op, val, nth = m.groups()
                if tag:
                    tests.append(("tag", tag.lower(), None))
                elif cls:
                    tests.append(("class", cls, None))
                elif ident:
                    tests.append(("id", ident, None))
                elif attr:
                    tests.append(("attr" + (op or "") + ("=" if val is not None else ""), attr.lower(), val))
                else:
                    tests.append(("nth", int(nth), None))
            chain.append((child, tests))
            child = False
        if chain:
            out.append(chain)
    return out


def _fits(n: Node, tests: list) -> bool:
    for kind, name, val in tests:
        if kind == "tag":
            ok = name == "*" or n.tag == name
        elif kind == "class":
            ok = name in n.attrs.get("class", "").split()
        elif kind == "id":
            ok = n.attrs.get("id") == name
        elif kind == "nth":
            ok = n.nth == name
        else:
            have = n.attrs.get(name)
            ok = have is not None and {"attr": True, "attr=": have == val, "attr*=": val is not None and val in (have or ""),
                                       "attr^=": (have or "").startswith(val or ""), "attr$=": (have or "").endswith(val or ""),
                                       "attr~=": (val or "") in (have or "").split()}[kind]
        if not ok:
            return False
    return True


def _matches(n: Node, chain: list, i: int) -> bool:
    if n.tag == "#root" or not _fits(n, chain[i][1]):
        return False
    if i == 0:
        return True
    up = n.parent
    while up is not None:
        if _matches(up, chain, i - 1):
            return True
        if chain[i][0]:
            return False
        up = up.parent
    return False


def select(root: Node, chains: list) -> Iterator[Node]:
    for n in root.walk():
        if any(_matches(n, c, len(c) - 1) for c in chains):
            yield n


FIELD = "field_name string, raw string, href string, src string, css_class string, found boolean"


def _items(pages: DataFrame, container: str, item: str, fields: Sequence[dict]) -> DataFrame:
    """(page_id, url, position, fields): one row per item with an array of its fields."""
    items_sel = compile_selector(f"{container} {item}".strip())
    specs = [(f["name"], compile_selector(f["selector"])) for f in fields]

    def run(batches):
        names = ["page_id", "url", "position", "fields"]
        for pdf in batches:
            out = []
            for pid, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
                for pos, node in enumerate(select(parse(html), items_sel)):
                    row = []
                    for name, chains in specs:
                        el = next(select(node, chains), None) if chains else node
                        if el is None:
                            row.append({"field_name": name, "raw": None, "href": None, "src": None, "css_class": None, "found": False})
                        else:
                            a = el.attrs
                            src = a.get("src") or a.get("data-src") or a.get("data-lazy") or ""
                            row.append({"field_name": name, "raw": el.text(), "href": a.get("href", ""), "src": src, "css_class": a.get("class", ""), "found": True})
                    out.append((pid, url, pos, row))
                if len(out) >= 2_000:  # not a whole batch of pages at once
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    parts = FIELD.replace(" ", ":").replace(",:", ",")
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id long, url string, position long, fields array<struct<{parts}>>")


def extract_fields(pages: DataFrame, container: str, item: str, fields: Sequence[dict]) -> DataFrame:
    """(page_id, url, position, field_name, raw, href, src, css_class, found) per item and field.

    Parsing is the only Python step; typed values are column expressions on its output.
    """
    return _items(pages, container, item, fields).select("page_id", "url", "position", F.inline("fields"))


def field_value(types: dict[str, str], get: Callable[[str], Column] = F.col) -> Column:
    """Typed value of an extracted field: text, image, link, price; rating words become digits."""
    kind = F.element_at(F.create_map(*[x for k, v in types.items() for x in (F.lit(k), F.lit(v))]), get("field_name"))
    full = lambda c: F.when(c != "", X.resolve_url(F.col("url"), c)).otherwise("")
    val = (F.when(kind == "image", full(get("src"))).when(kind == "link", full(get("href")))
           .when(kind == "price", X.clean_price(get("raw")))
           .otherwise(F.coalesce(X.star_rating(get("css_class")), X.strip(get("raw")))))
    return F.nullif(val, F.lit(""))


def extract_items(pages: DataFrame, container: str, item: str, fields: Sequence[dict]) -> DataFrame:
    """Long table (page_id, position, field_name, value, kept); an item is kept when a field has a value."""
    types = {f["name"]: f.get("type", "text") for f in fields}
    typed = F.transform("fields", lambda f: F.struct(f["field_name"].alias("field_name"), field_value(types, lambda n: f[n]).alias("value")))
    d = _items(pages, container, item, fields).withColumn("fields", typed)
    d = d.withColumn("kept", F.exists("fields", lambda f: f["value"].isNotNull()))
    return d.select("page_id", "url", "position", F.inline("fields"), "kept")


def number_items(long: DataFrame, limit: int = 0) -> DataFrame:
    """Give kept items a dense index over all pages (from 0); `limit` 0 keeps all.

    Pages get their offset from a running sum over page counts, items their place inside the
    page, so no window spans the corpus rows.
    """
    from .ranks import running_totals

    items = long.where("kept").select("page_id", "position").distinct()
    per_page = items.groupBy("page_id").agg(F.count("*").alias("c")).withColumn("g", F.lit("all"))
    n_pages = per_page.count()
    off = running_totals(per_page, "g", "page_id", ["c"], n_pages).select("page_id", (F.col("c_upto") - F.col("c")).alias("off"))
    inside = F.row_number().over(W.partitionBy("page_id").orderBy("position")) - 1
    idx = items.withColumn("in_page", inside).join(off, "page_id").select(
        "page_id", "position", (F.col("off") + F.col("in_page")).cast("long").alias("item_index"))
    if limit:
        idx = idx.where(F.col("item_index") < limit)
    return long.where("kept").join(idx, ["page_id", "position"]).select("page_id", "item_index", "field_name", "value")


def page_progress(long: DataFrame) -> DataFrame:
    """Items and failed items per page."""
    items = long.select("page_id", "position", "kept").distinct()
    return items.groupBy("page_id").agg(F.count_if("kept").alias("items"), F.count_if(~F.col("kept")).alias("failed"))


def long_to_wide(df: DataFrame, index: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """One column per field in selection order; fields without rows become empty columns."""
    return df.groupBy(*index).pivot(name, list(names)).agg(F.min(value)).select(*index, *names)


def fill_rate(long: DataFrame) -> DataFrame:
    good = F.col("value").isNotNull() & ~F.col("value").isin("", "N/A")
    return long.agg(F.count("*").alias("cells"), F.count_if(good).alias("filled"),
                    F.round(100.0 * F.count_if(good) / F.count("*"), 0).cast("long").alias("fill_pct"))


def detect_field_types(df: DataFrame, name: str = "field_name") -> DataFrame:
    """Type per field by majority over all its values: image, link, price or text."""
    v = F.col("raw")
    kind = (F.when(X.looks_like_price(v), "price").when(F.col("src") != "", "image")
            .when(F.col("href") != "", "link").otherwise("text"))
    counts = df.where("found").groupBy(name, kind.alias("kind")).agg(F.count("*").alias("n"))
    return counts.groupBy(name).agg(F.max_by("kind", F.struct("n", "kind")).alias("field_type"), F.sum("n").alias("values"))


def detect_patterns(pages: DataFrame, least: int = 3) -> DataFrame:
    """Repeated item patterns over the corpus: selector, pages, items, detected fields."""
    sels = [(s, compile_selector(s)) for s in PATTERNS]
    parts = {k: compile_selector(v) for k, v in PATTERN_FIELDS.items()}

    def run(batches):
        for pdf in batches:
            out = []
            for pid, html in zip(pdf["page_id"], pdf["html"]):
                root = parse(html)
                for name, chains in sels:
                    found = list(select(root, chains))
                    if len(found) >= least:
                        have = [k for k, c in parts.items() if next(select(found[0], c), None) is not None]
                        if have:
                            out.append((pid, name, len(found), ",".join(have)))
            yield pd.DataFrame(out, columns=["page_id", "selector", "items", "fields"])

    hits = pages.select("page_id", "html").mapInPandas(run, "page_id long, selector string, items long, fields string")
    return (hits.groupBy("selector", "fields").agg(F.count("*").alias("pages"), F.sum("items").alias("items"))
            .orderBy(F.desc("items"), "selector", "fields"))


def run_record(long: DataFrame, method: str) -> DataFrame:
    """One row per host: pages, kept items, failed items and method."""
    d = long.withColumn("host", X.host_name(F.col("url"))).select("host", "page_id", "position", "kept").distinct()
    return d.groupBy("host").agg(F.count_distinct("page_id").alias("pages"), F.count_if("kept").alias("rows"),
                                 F.count_if(~F.col("kept")).alias("failed_items")).withColumn("method", F.lit(method))
