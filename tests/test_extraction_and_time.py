"""Selectors on pages, values as of a time, bounded crawls, and files that hold their pages."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallymart.functions.selectors import CONFIG, Page, compiled, cut, extracted, found, typed
from tallymart.operators.intervals import as_of, validity
from tallymart.operators.tables import crawled
from tallymart.sources import files

HTML = """<html lang="es"><head><meta property="og:price" content="$1.990"><meta name='sku' content='007'></head><body><ul id="list"><li class="a first">one</li><li class="b">two <b>bold</b></li><li>three<br>x</li></ul>
<div class="ad box" data-k="v1"><p>first<p>second <a href="/x?y=1">link &amp; more</a></div><script>var t="</p>";track(7);</script><img src="i.png"/></body></html>"""


@pytest.mark.parametrize("selector,take,expected", [
    ("li", "text", "threex"), ("li.a", "text", "one"), ("li.first.a", "text", "one"), ("#list > li:nth-of-type(2)", "text", "two bold"), ("ul li:first-child", "text", "one"), ("ul>li:nth-child(3)", "text", "threex"), ("div.ad a", "text", "link & more"),
    ("a[href^='/x']", "href", "/x?y=1"), ("div[data-k=v1] p a, h9", "text", "link & more"), ("[data-k$=1]", "class", "ad box"), ("[class~=box]", "data-k", "v1"), ("body > a", "text", None), ("//div/p/p/a", "text", "link & more"), ("//meta[@name='sku']", "content", "007"), ("img", "src", "i.png"), ("html[lang]", "lang", "es"),
    ("script", "text", 'var t="</p>";track(7);'), ("li[title]", "text", None), ("*", "src", "i.png"), ("a[href*='y=']", "nothing", None),
])
def test_selectors(selector, take, expected):
    assert found(Page(HTML), selector, take) == expected


@pytest.mark.parametrize("selector", ["", "b[", "li:odd", "a..b", ","])
def test_what_is_no_selector(selector):
    with pytest.raises(ValueError):
        compiled(selector)


def test_cut():
    assert cut(" a, b , c ", [" "], ",", 1) == "b" and cut("a|b", [], "|", -1) == "b" and cut("a|b", [], "|", 2) is None and cut("x$", ["$"], None, None) == "x"


def test_fields_with_alternatives_and_errors(spark):
    config = spark.createDataFrame([
        ("s", "price", 1, "css", "span.price", "text", None, None, None), ("s", "price", 2, "meta", "og:price", None, None, None, None), ("s", "price", 3, "fixed", "9", None, None, None, None), ("s", "code", 1, "xpath", "//meta[@name='sku']", "content", None, None, None),
        ("s", "bad", 1, "css", "b[", "text", None, None, None), ("t", "name", 1, "css", "b", "text", ["l"], "o", 0), ("t", "image", 1, "css", "img", "src", None, None, None), ("t", "price", 1, "fixed", "2x1990", None, None, None, None), ("t", "stock", 1, "fixed", "IN STOCK AND MUCH OF IT", None, None, None, None),
    ], CONFIG)
    pages = spark.createDataFrame([(1, "s", HTML), (2, "t", HTML), (3, "s", None), (4, "s", ""), (5, "unknown", HTML)], "k long, site string, html string")
    rows = {r["k"]: r for r in extracted(pages, config, "k").select("k", "errors", *typed(F.col("values"))).collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    assert (rows[1]["price"], rows[1]["price_quantity"], rows[1]["code"]) == (1990, 1, "7")
    assert sorted((e["field"], e["ord"]) for e in rows[1]["errors"]) == [("bad", 1), ("price", 1)]
    assert (rows[2]["name"], rows[2]["image"], rows[2]["price"], rows[2]["price_quantity"], rows[2]["stock"]) == ("b", "i.png", 1990, 2, "in stock and much of")
    assert rows[3]["price"] is None and rows[3]["errors"] == []
    assert rows[4]["price"] == 9 and len(rows[4]["errors"]) == 4


def test_as_of_equals_looking_back(spark):
    rng = random.Random(3)
    t0 = datetime.datetime(2024, 1, 1)
    at = lambda h: t0 + datetime.timedelta(hours=h)
    history = sorted({(rng.choice("ab"), at(rng.randint(0, 3000)), rng.randint(1, 4)) for _ in range(80)}) + [("a", None, 1), ("b", at(5), None), ("c", at(100), 7)]
    asked = [(rng.choice("abcd"), at(rng.randint(-50, 4000)), k) for k in range(150)] + [(None, at(1), 900), ("a", None, 901)]
    df = spark.createDataFrame(history, "k string, ts timestamp, v long")
    spans = validity(df, ["k"], "v")
    found_ = {r["id"]: r["v"] for r in as_of(spark.createDataFrame(asked, "k string, ts timestamp, id long"), spans, ["k"], days=3).collect()}
    expected = {}
    for k, ts, i in asked:
        before = sorted((t, v) for key, t, v in history if key == k and ts is not None and t is not None and v is not None and t <= ts)
        if before:
            expected[i] = before[-1][1]
    assert found_ == expected
    rows = sorted((r for r in spans.collect() if r["k"] == "a"), key=lambda r: r["since"])
    assert all(x["until"] == y["since"] and x["v"] != y["v"] for x, y in zip(rows, rows[1:])) and rows[-1]["until"] is None


def test_crawl(spark):
    edges = spark.createDataFrame([("/a", "/b"), ("/b", "/c"), ("/c", "/a"), ("/a", "/login"), ("/login", "/d"), ("/a", "http://x"), ("/c", "/e"), ("/e", "/f"), ("/a", "/a2")], "src string, dst string")
    start = spark.createDataFrame([("/a",), ("no",), ("/a",)], "node string")
    got = lambda **o: [tuple(r) for r in crawled(edges, start, **o).orderBy("level", "node").collect()]
    assert got(depth=3, prefix="/", avoid=["login"]) == [("/a", 0), ("/a2", 1), ("/b", 1), ("/c", 2), ("/e", 3)]
    assert got(depth=9, prefix="/", avoid=["login"], most=3) == [("/a", 0), ("/a2", 1), ("/b", 1)]
    assert got(depth=9, prefix="/", avoid=["login"], most=1) == [("/a", 0)]
    assert got(depth=0, prefix="/zzz") == []


def test_sitemap_pages(spark, tmp_path):
    df = spark.range(1, 48).select(F.col("id"), F.concat(F.lit("https://e/"), F.col("id").cast("string")).alias("loc"), F.lit("2024-02-03").cast("date").alias("lastmod")).repartition(5)
    assert files.write_sitemap_pages(df, str(tmp_path), "id", 10) == 5
    maps = [r["loc"] for r in files.read_sitemap_index(spark, f"{tmp_path}/index").collect()]
    counts = sorted(files.read_sitemap(spark, m).count() for m in maps)
    assert counts == [7, 10, 10, 10, 10]
    assert {r["loc"] for r in files.read_sitemaps(spark, f"{tmp_path}/index").collect()} == {f"https://e/{k}" for k in range(1, 48)}


def test_references_that_were_cut_short_are_text():
    page = Page('<h1 title="a &amp; b">a &amp; b&amp</h1><p>x &lt y &copy z && &#38; &#38</p><!-- &amp --><script>if (a && b) f("&amp");</script><p>end</p>')
    assert found(page, "h1", "text") == "a & b&amp"
    assert found(page, "h1", "title") == "a & b"
    assert found(page, "p:nth-of-type(1)", "text") == "x &lt y &copy z && & &#38"
    assert found(page, "script", "text") == 'if (a && b) f("&amp");'
    assert found(page, "p:nth-of-type(2)", "text") == "end"
