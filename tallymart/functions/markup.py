"""Fields out of pages and structured data."""

from __future__ import annotations

from collections.abc import Sequence
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag_text(html: Column, tag: str) -> Column:
    """What stands in the first element of a name, or ''."""
    return F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)


def meta(html: Column, name: str) -> Column:
    """The content of a meta element with the name or property."""
    return F.regexp_extract(html, rf"""(?is)<meta[^>]*(?:name|property)=["']?{name}["']?[^>]*content=["']([^"']*)""", 1)


def charset(html: Column) -> Column:
    return F.regexp_extract(html, r"""(?i)<meta[^>]*charset=["']?([A-Za-z0-9_-]+)""", 1)


def links(html: Column) -> Column:
    """The href of each a element, in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a [^>]*href=["']([^"']*)["']"""), 1)


def unescaped(text: Column) -> Column:
    """Character references as characters."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else unescape(t))

    return run(text)


class _Texts(HTMLParser):
    """Texts of elements with a name and, if it is given, a class."""

    def __init__(self, tag: str, cls: str | None):
        super().__init__(convert_charrefs=True)
        self.tag, self.cls, self.depth, self.found = tag, cls, 0, []

    def handle_starttag(self, tag, attrs):
        if self.depth:
            self.depth += tag == self.tag
        elif tag == self.tag and (self.cls is None or self.cls in (dict(attrs).get("class") or "").split()):
            self.depth = 1
            self.found.append("")

    def handle_endtag(self, tag):
        if self.depth and tag == self.tag:
            self.depth -= 1

    def handle_data(self, data):
        if self.depth:
            self.found[-1] += data


def selected(tag: str, cls: str | None = None, take: int = -1):
    """A function of a column of markup: the text of one element (the last, unless `take` says otherwise), or null."""

    @F.pandas_udf("string")
    def run(html: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            parser = _Texts(tag, cls)
            parser.feed(text)
            return parser.found[take] if parser.found else None

        return html.map(one)

    return run


def with_fallbacks(*alternatives: Column) -> Column:
    """The first that isn't null or blank."""
    return F.coalesce(*[F.nullif(F.trim(a), F.lit("")) for a in alternatives])


def product_node(json: Column) -> Column:
    """The node of type Product: the document itself, or the first such in its @graph; null without one, for lists and for broken text."""
    at = F.get_json_object(json, "$['@type']")
    graph = F.from_json(F.get_json_object(json, "$['@graph']"), "array<string>")
    inside = F.get(F.filter(graph, lambda n: F.get_json_object(n, "$['@type']") == "Product"), F.lit(0))
    return F.when(at == "Product", json).otherwise(inside)


def product_fields(node: Column) -> list[Column]:
    """name, brand, sku, image, price and availability of a Product, whatever shape its offers have."""
    get = lambda *paths: F.coalesce(*[F.get_json_object(node, p) for p in paths])
    return [
        get("$.name").alias("name"),
        get("$.brand.name", "$.brand").alias("brand"),
        get("$.gtin13", "$.sku").alias("code"),
        get("$.image.url", "$.image[0]", "$.image").alias("image"),
        get("$.offers.offers[0].price", "$.offers[0].price", "$.offers.price", "$.offers.lowPrice").alias("price"),
        get("$.offers.offers[0].availability", "$.offers[0].availability", "$.offers.availability").alias("availability"),
    ]


def breadcrumbs(df: DataFrame, json: str, keep: Sequence[str]) -> DataFrame:
    """A row for each crumb of a BreadcrumbList, alone or in @graph: position, name (of the crumb or of its item), item."""
    graph = F.from_json(F.get_json_object(json, "$['@graph']"), "array<string>")
    is_list = lambda n: F.get_json_object(n, "$['@type']") == "BreadcrumbList"
    node = F.when(is_list(F.col(json)), F.col(json)).otherwise(F.get(F.filter(graph, is_list), F.lit(0)))
    crumbs = F.from_json(F.get_json_object(node, "$.itemListElement"), "array<string>")
    rows = df.select(*keep, F.explode(crumbs).alias("_c"))
    get = lambda p: F.get_json_object("_c", p)
    return rows.select(*keep, get("$.position").cast("long").alias("position"), F.coalesce(get("$.name"), get("$.item.name")).alias("name"), F.coalesce(get("$.item['@id']"), get("$.item")).alias("item"))


class _Paths(HTMLParser):
    """Texts with the path of elements that they stand in, each step with its place among its kind."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []
        self.counts: list[dict[str, int]] = [{}]
        self.found: dict[str, str] = {}

    def handle_starttag(self, tag, attrs):
        n = self.counts[-1][tag] = self.counts[-1].get(tag, 0) + 1
        if tag not in self.VOID:
            self.stack.append((tag, n))
            self.counts.append({})

    def handle_endtag(self, tag):
        names = [t for t, _ in self.stack]
        if tag in names:  # unclosed elements inside end with it
            keep = len(names) - 1 - names[::-1].index(tag)
            del self.stack[keep:], self.counts[keep + 1 :]

    def handle_data(self, data):
        if data.strip():
            path = "/".join(f"{t}[{n}]" for t, n in self.stack)
            self.found[path] = (self.found.get(path, "") + " " + data.strip()).strip()


def text_paths(html: Column) -> Column:
    """A map of the path of each element that holds text to that text."""

    @F.pandas_udf("map<string,string>")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            parser = _Paths()
            parser.feed(text)
            return parser.found

        return texts.map(one)

    return run(html)
