"""Fields out of pages by selectors that are compiled once a batch and tried on one parse of each page.

A selector is what a style sheet has: tags, classes, ids, attributes, first-child, nth-child and nth-of-type, joined by descent (a space) or by child (>), with
alternatives by commas. A path of the form //tag[@name='value']/tag is read as such a selector.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .markup import _Paths

_PART = re.compile(r"""(?P<tag>^[a-zA-Z][\w-]*|^\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[(?P<name>[\w:-]+)(?:(?P<op>[~^$*]?=)["']?(?P<value>[^"'\]]*)["']?)?\]|:(?P<place>first-child|nth-child|nth-of-type)(?:\((?P<n>\d+)\))?""")


#: Comments, scripts and styles, in which an & stands for itself, and an & elsewhere that no semicolon ends as a reference.
_LONE = re.compile(r"(?is)(<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\2\s*>|\Z))|&(?!(?:#[0-9]+|#x[0-9a-f]+|[a-z][a-z0-9]*);)")


class Page(HTMLParser):
    """The elements of a page in order: tag, attributes, parent, places among all and among like siblings, and texts. A reference without its semicolon is text, as one that was cut short is."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[tuple[str, dict, int, int, int]] = []
        self.texts: list[list[str]] = []
        self.stack: list[int] = []
        self.counts: dict[int, dict[str, int]] = {}
        self.feed(_LONE.sub(lambda m: m[1] or "&amp;", html))
        self.close()

    def handle_starttag(self, tag, attrs):
        parent = self.stack[-1] if self.stack else -1
        counts = self.counts.setdefault(parent, {})
        counts[tag] = counts.get(tag, 0) + 1
        self.elements.append((tag, dict(attrs), parent, sum(counts.values()), counts[tag]))
        self.texts.append([])
        if tag not in _Paths.VOID:
            self.stack.append(len(self.elements) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _Paths.VOID:
            self.stack.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.elements[self.stack[k]][0] == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        for k in self.stack:
            self.texts[k].append(data)


def _compound(part: str) -> list[tuple]:
    tests, at = [], 0
    while at < len(part):
        m = _PART.match(part, at) if at else _PART.match(part)
        if not m:
            raise ValueError(f"no selector: {part}")
        g = m.groupdict()
        if g["tag"] and g["tag"] != "*":
            tests.append(("tag", g["tag"].lower()))
        elif g["cls"]:
            tests.append(("~=", "class", g["cls"]))
        elif g["id"]:
            tests.append(("=", "id", g["id"]))
        elif g["name"]:
            tests.append((g["op"] or "has", g["name"].lower(), g["value"] or ""))
        elif g["place"]:
            tests.append((g["place"], int(g["n"] or 1)))
        at = m.end()
    return tests


@lru_cache(maxsize=4096)
def compiled(selector: str) -> tuple:
    """The alternatives of a selector: its compounds from the right, each with how it is joined to the one before."""
    if selector.startswith("/"):
        selector = re.sub(r"\[@([\w:-]+)=", r"[\1=", selector.lstrip("/")).replace("//", " ").replace("/", " > ")
    out = []
    for one in selector.split(","):
        steps, joined = [], " "
        for token in re.sub(r"\s*>\s*", " > ", one.strip()).split():
            if token == ">":
                joined = ">"
            else:
                steps.append((joined, _compound(token)))
                joined = " "
        if not steps:
            raise ValueError(f"no selector: {selector}")
        out.append(tuple(reversed(steps)))
    return tuple(out)


def _passes(element: tuple, tests: list[tuple]) -> bool:
    tag, attrs, _, place, of_type = element
    for t in tests:
        if t[0] == "tag":
            good = tag == t[1]
        elif t[0] in ("first-child", "nth-child"):
            good = place == t[1]
        elif t[0] == "nth-of-type":
            good = of_type == t[1]
        else:
            have = attrs.get(t[1])
            good = t[1] in attrs and (t[0] == "has" or have is not None and {"=": have == t[2], "~=": t[2] in have.split(), "^=": have.startswith(t[2]), "$=": have.endswith(t[2]), "*=": t[2] in have}[t[0]])
        if not good:
            return False
    return True


def _fits(page: Page, at: int, steps: tuple) -> bool:
    """Whether the element matches the first compound and those before it, in reverse, its ancestors."""
    if not _passes(page.elements[at], steps[0][1]):
        return False
    if len(steps) == 1:
        return True
    up = page.elements[at][2]
    if steps[0][0] == ">":
        return up >= 0 and _fits(page, up, steps[1:])
    while up >= 0:
        if _fits(page, up, steps[1:]):
            return True
        up = page.elements[up][2]
    return False


def found(page: Page, selector: str, take: str) -> str | None:
    """The text of the last element that the selector finds, or one of its attributes; null without one."""
    options = compiled(selector)
    for at in range(len(page.elements) - 1, -1, -1):
        if any(_fits(page, at, steps) for steps in options):
            return "".join(page.texts[at]) if take == "text" else page.elements[at][1].get(take)
    return None


#: What a table of extraction settings holds: fields of a site, alternatives in order. how: fixed, css, xpath or meta.
CONFIG = "site string, field string, ord int, how string, search string, take string, remove array<string>, split_by string, split_elem int"


def _value(page: Page, c: dict) -> str | None:
    if c["how"] == "fixed":
        return c["search"]
    if c["how"] == "meta":
        raw = found(page, f"meta[property=\"{c['search']}\"], meta[name=\"{c['search']}\"]", c["take"] or "content")
    else:
        raw = found(page, c["search"], c["take"] or "text")
    return raw if raw is None else cut(raw, c["remove"] or [], c["split_by"], c["split_elem"])


def cut(raw: str, remove: list[str], split_by: str | None, elem: int | None) -> str | None:
    """What is configured after selecting: trim, split and take one part, remove strings."""
    out = raw.strip()
    if split_by:
        parts = out.split(split_by)
        if not -len(parts) <= (elem or 0) < len(parts):
            return None
        out = parts[elem or 0]
    for r in remove:
        out = out.replace(r, "")
    return out.strip()


def extracted(pages: DataFrame, config: DataFrame, key: str) -> DataFrame:
    """(key, site, values, errors) of pages (key, site, html): values maps fields to the first alternative that gives something, errors lists (field, ord) of
    those before it that gave nothing or aren't selectors. A site's settings are one row beside each of its pages; a page without markup has no values."""
    own = [f.split()[0] for f in CONFIG.split(", ") if not f.startswith("site ")]
    of_site = config.groupBy("site").agg(F.array_sort(F.collect_list(F.struct(*own))).alias("config"))
    rows = pages.select(key, "site", "html").join(of_site, "site").select(key, "site", "html", "config")

    def one(html: str | None, config: list[dict]):
        values: dict[str, str] = {}
        errors: list[dict] = []
        if html is None:
            return values, errors
        page = Page(html)
        for c in sorted(config, key=lambda c: (c["field"], c["ord"])):
            if c["field"] in values:
                continue
            try:
                value = _value(page, c)
            except ValueError:
                value = None
            if value:
                values[c["field"]] = value
            else:
                errors.append({"field": c["field"], "ord": c["ord"]})
        return values, errors

    kinds = pa.map_(pa.string(), pa.string()), pa.list_(pa.struct([("field", pa.string()), ("ord", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(k, 64) for k in range(0, batch.num_rows, 64)):
                out = [one(h, c) for h, c in zip(some.column("html").to_pylist(), some.column("config").to_pylist())]
                yield pa.RecordBatch.from_arrays([some.column(key), some.column("site"), pa.array([list(v.items()) for v, _ in out], kinds[0]), pa.array([e for _, e in out], kinds[1])], [key, "site", "values", "errors"])

    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, site string, values map<string,string>, errors array<struct<field:string,ord:int>>")


def typed(values) -> list:
    """The columns of an offer out of a map of fields, each with its type: names in lower case, numbers as numbers (null where they aren't), codes without leading zeros, stock cut to
    twenty letters, and a price with the quantity that it is for."""
    get = lambda c: F.trim(F.element_at(values, c))
    low = lambda c: F.lower(get(c))
    price = get("price")
    single = F.when(price.rlike("^[0-9]+[xX]"), F.regexp_replace(price, "^[0-9]+[xX]", "")).otherwise(price)
    return [
        *[low(c).alias(c) for c in ("name", "description", "brand", "category", "kind", "supplier", "measure_unit")], F.substring(low("stock"), 1, 20).alias("stock"),
        get("ref_price").try_cast("long").alias("ref_price"), get("units").try_cast("double").alias("units"), get("measure").try_cast("double").alias("measure"),
        F.coalesce(low("code").try_cast("long").cast("string"), low("code")).alias("code"), get("image").alias("image"),
        T.price_text(single).alias("price"), T.price_quantity(F.lower(price)).alias("price_quantity"),
    ]
