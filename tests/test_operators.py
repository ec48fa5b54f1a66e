"""Table operators, rules, mining, files and streams on small tables."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from tallymart.operators import tables as O
from tallymart.operators.mining import mine
from tallymart.operators.rules import apply_rules, rule_hits, rule_upsert
from tallymart.plans import baskets, catalog, matching
from tallymart.plans.catalog import redirected
from tallymart.plans.history import price_matrix
from tallymart.plans.normalise import named_in
from tallymart.plans.reports import freshness
from tallymart.session import shared_folder
from tallymart.sources import files
from tallymart.streaming.changes import streamed_changes
from tallymart.streaming.run import drained


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_without_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id long, x string")
    assert got(O.without(df, x="a"), "id") == [(2,), (3,)]
    assert got(O.without(df, x="a", id=9), "id") == [(1,), (2,), (3,)]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (None, "n", 1)], "k long, t string, n long")
    new = spark.createDataFrame([(2, "", 0), (3, "c", 7), (None, "m", 2)], "k long, t string, n long")
    assert got(O.upsert(old, new, ["k"]), "k", "t", "n") == sorted([(1, "a", 5), (2, "", 0), (3, "c", 7), (None, "m", 2)], key=str)
    assert got(rule_upsert(old, new, ["k"]), "k", "t", "n") == sorted([(1, "a", 5), (2, "b", 6), (3, "c", 7), (None, "m", 2)], key=str)


def test_pages(spark):
    df = spark.range(25)
    assert [r["id"] for r in O.page(df, 3, 10, F.col("id")).collect()] == [20, 21, 22, 23, 24]
    assert O.page(df, 4, 10, F.col("id")).count() == 0
    assert O.page(df, 9, 10, F.col("id"), past_end="last").count() == 5
    pages = O.global_pages(df, 10, "id").groupBy("page").count().collect()
    assert sorted(map(tuple, pages)) == [(1, 10), (2, 10), (3, 5)]


def test_numbered_within(spark):
    """Ties of the key that fall on a border, a group that holds most rows, and a null group."""
    data = [(i, "a" if i % 10 else ("b" if i % 20 else None), i // 7) for i in range(500)]
    df = spark.createDataFrame(data, "i long, g string, t long").repartition(7)
    expected, seen = [], {}
    for i, g, _ in data:
        seen[g] = seen.get(g, 0) + 1
        expected.append((i, seen[g]))
    assert sorted((r["i"], r["id"]) for r in O.numbered_within(df, "g", "t", "t", "i").collect()) == expected


class Shop:
    """Views of a few articles and offers."""

    def __init__(self, spark, articles, sold):
        self.spark = spark
        self.article = spark.createDataFrame([(i, n, b, 1, "780000000000") for i, n, b in articles], "article_id long, name string, brand string, units long, ean string")
        self.usable = spark.createDataFrame([(i, s, 100 + s) for i in sold for s in (1, 2)], "article_id long, shop_id long, price long")
        self.listing = self.usable.select("article_id", "shop_id")


def test_search_by_brands(spark):
    """All brands that are so named, whatever their case and however many words they have; none is cut off."""
    v = Shop(spark, [(1, "ring", "Acme"), (2, "ring", "ACME"), (3, "ring", "Red Star"), (4, "red star ring", "Other"), (5, "acme bolt", "Other"), (6, "bolt ring", "Acme")], range(1, 7))
    found = lambda text: sorted(r["article_id"] for r in catalog.search(v, text).collect())
    assert found("acme") == [1, 2, 6] and found("acme ring") == [1, 2] and found("ring acme") == [1, 2]
    assert found("red star ring") == [3] and found("red ring star") == [3] and found("star red ring") == []
    assert found("acme bolt") == [6] and found("bolt") == [6] and found("nothing") == [] and found("") == [1, 2, 3, 4, 5, 6]


def test_articles_without_sellers(spark):
    v = Shop(spark, [(1, "a", "x"), (2, "b", "x"), (3, "c", "y")], [1])
    assert got(catalog.articles_without_sellers(v), "article_id") == [(2,), (3,)]
    assert got(catalog.sellers_per_article(v), "article_id", "sellers") == [(1, 2), (2, 0), (3, 0)]
    assert got(catalog.brands_with_articles(v), "brand", "articles") == [("x", 1)]


def test_named_by_subsets(spark):
    texts = spark.createDataFrame([(1, "old red big star ring ring"), (2, "star red"), (3, "red"), (4, "")], "id long, text string")
    names = spark.createDataFrame([("red star",), ("star",), ("ring ring",), ("old red big star ring ring",), ("red red",)], "name string")
    from itertools import combinations

    expected = sorted({(r["id"], n["name"]) for r in texts.collect() for n in names.collect() if tuple(n["name"].split()) in {c for k in range(1, 7) for c in combinations(r["text"].split(), k)}})
    assert got(named_in(texts, names, "id"), "id", "name") == expected


def test_disjoint_sellers(spark):
    v = Shop(spark, [(1, "a", "x"), (2, "a", "x"), (3, "a", "x"), (4, "b", "x")], [])
    v.usable = spark.createDataFrame([(1, 1, 10), (2, 1, 10), (2, 2, 10), (3, 3, 900)], "article_id long, shop_id long, price long")
    assert got(matching.disjoint_sellers(v), "article_id", "other_id") == [(1, 3), (2, 3)]


def test_stream_changes_with_nulls(spark, tmp_path):
    """As the batch form: a leading null and a null after a null are no changes."""
    rows_ = [(k, t, x) for k, values in ((1, [None, None, 5, 5, None, None, 5, 6]), (2, [7, None]), (3, [None])) for t, x in enumerate(values)]
    df = spark.createDataFrame(rows_, "k long, t long, v long")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    found = drained(streamed_changes(stream, "k", ("t",), "v"), str(tmp_path / "out"))
    assert got(found, "k", "t") == got(O.changes_only(df, "k", ("t",), "v"), "k", "t") == [(1, 2), (1, 4), (1, 6), (1, 7), (2, 0), (2, 1)]


def test_shared_folder():
    """A setting, then a checkpoint folder; without either a local folder on one machine and an error on a cluster."""
    from types import SimpleNamespace as Some

    def made(master, conf=None, chosen=None):
        option = Some(isDefined=lambda: chosen is not None, get=lambda: chosen)
        return Some(conf=Some(get=lambda k, d: conf), sparkContext=Some(master=master, _jsc=Some(sc=lambda: Some(getCheckpointDir=lambda: option))))

    assert shared_folder(made("spark://host:7077", "hdfs://a/b/", "x")) == "hdfs://a/b"
    assert shared_folder(made("yarn", None, "hdfs://c")) == "hdfs://c"
    assert os.path.isdir(shared_folder(made("local[4]")))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_folder(made(master))


def test_overlap_with_empty_list(spark):
    df = spark.createDataFrame([(1, [1], [1, 2]), (2, [1], [2]), (3, [], [2])], "id long, a array<long>, b array<long>")
    assert got(df.select("id", O.overlapping(F.col("a"), F.col("b")).alias("o")), "id", "o") == [(1, True), (2, False), (3, True)]


def test_changes_have_no_equal_neighbours(spark):
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate([5, 5, 6, None, None, 6, 5])], "k long, t long, v long")
    assert got(O.changes_only(df, "k", ("t",), "v"), "t") == [(0,), (2,), (3,), (5,), (6,)]


def test_price_matrix(spark):
    df = spark.createDataFrame([(1, 1, 10, 100), (1, 2, 11, 200), (1, 1, 12, 110)], "a long, shop_id long, ts long, price long")
    rows = got(price_matrix(df, "a"), "ts", "shop_id", "last_price")
    assert rows == sorted([(10, 1, 100), (10, 2, None), (11, 1, 100), (11, 2, 200), (12, 1, 110), (12, 2, 200)], key=str)
    assert (10, 2, 200) in got(price_matrix(df, "a", backfill="final"), "ts", "shop_id", "last_price")


def test_freshness_boundaries(spark):
    df = spark.sql("SELECT 1L shop_id, d ts FROM VALUES (date'2000-01-01'), (date'1999-12-31'), (date'1999-12-22') t(d)")
    half = freshness(df).where("shop_id = 1").first()
    assert (half["from_0"], half["from_1"], half["from_10"]) == (1, 1, 1)
    both = freshness(df, inclusive=True).where("shop_id = 1").first()
    assert (both["from_0"], both["from_1"]) == (2, 1)


def test_rules_chain_and_cycle(spark):
    rules = spark.createDataFrame([(1, "a", None, "b", "x"), (2, "b", "x", "c", "x"), (3, "c", "x", "d", "x"), (4, "d", "x", "e", "x"), (5, "p", "q", "q", "q"), (6, "q", "q", "p", "q")], "rule_id long, if_brand string, if_name string, then_brand string, then_name string")
    rows = spark.createDataFrame([(1, "a", None), (2, "d", "X"), (3, "p", "q"), (4, "z", "z")], "id long, brand string, name string")
    out = apply_rules(rows, rules, ("brand", "name"))
    assert got(out, "id", "brand", "used") == [(1, "d", 3), (2, "e", 1), (3, "q", 3), (4, "z", 0)]
    assert (1, 1) in got(rule_hits(rows, rules, ("brand", "name")), "rule_id", "hits")


def test_redirect_cycle_ends(spark):
    brands = spark.createDataFrame([("a",), ("b",), ("z",)], "brand string")
    rules = spark.createDataFrame([("a", "b"), ("b", "a")], "brand string, target string")
    assert got(redirected(brands, rules), "brand", "target") == [("a", "b"), ("b", "a"), ("z", "z")]


def test_mined_sellers_are_disjoint(spark):
    schema = "article_id long, brand string, name string, measure double, degrees double, units long, package string, size string, shops array<long>"
    rows = [(1, "b", "red ring large", 1.0, 0.0, 1, "box", "m", [1, 2]), (2, "b", "large red ring", 1.0, 5.0, 1, "box", "m", [3]), (3, "b", "red ring large", 1.0, 5.0, 1, "box", "m", [2]), (4, "b", "x", 1.0, 0.0, 1, "box", "m", None), (5, "c", "red ring large", 1.0, 5.0, 1, "box", "m", [9])]
    out = mine(spark.createDataFrame(rows, schema)).collect()
    assert [(r["article_id"], r["into_id"], r["reason"]) for r in out if r["reason"] == "fill degrees"] == [(1, 2, "fill degrees")]
    assert mine(spark.createDataFrame([], schema)).count() == 0


def test_crawl_levels(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert got(O.reachable(edges, start, 2), "node", "level") == [("a", 0), ("b", 1), ("c", 2)]
    assert got(O.reachable(edges, start, 0), "node", "level") == [("a", 0)]


def test_facets(spark):
    df = spark.createDataFrame([(1, "x", 0), (1, "x", 2), (2, None, 2)], "id long, c string, n long")
    out = O.facets(df, {"c": ("c", F.col("c").isNotNull()), "n": ("n", F.col("n") != 0)}, "id")
    assert got(out, "facet", "value", "n") == [("c", "x", 1), ("n", "2", 2)]


def test_files(spark, tmp_path):
    (tmp_path / "maps").mkdir()
    with gzip.open(tmp_path / "maps" / "a.xml.gz", "wt") as f:
        f.write("<urlset><url><loc> u1 </loc><lastmod>2023-02-03T10:00:00Z</lastmod></url><url><loc>u2</loc><lastmod>odd</lastmod></url></urlset>")
    rows = got(files.read_sitemap(spark, str(tmp_path / "maps")), "loc", "lastmod")
    assert [(a, str(b)) for a, b in rows] == [("u1", "2023-02-03"), ("u2", files.DEFAULT_LASTMOD)]
    files.write_sitemap(files.read_sitemap(spark, str(tmp_path / "maps")), str(tmp_path / "out"))
    assert files.read_sitemap(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "robots.txt").write_text("# c\nUser-agent: *\nDisallow: /x # y\n\nSitemap: https://a/b.xml\n")
    assert got(files.read_robots(spark, str(tmp_path / "robots.txt")), "directive", "content") == [("disallow", "/x"), ("sitemap", "https://a/b.xml"), ("user-agent", "*")]
    df = spark.createDataFrame([("s", "u", False, 5, "n", None, "b", None)], files.UPLOAD_SCHEMA)
    df.write.option("header", True).csv(str(tmp_path / "up"))
    assert got(files.read_upload(spark, str(tmp_path / "up")), "site", "price") == [("s", 5)]
    files.write_csv(df, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_text(encoding="utf-8")
    assert text.startswith("﻿site,")
    files.write_json(df, str(tmp_path / "json"))
    assert files.read_crawl(spark, str(tmp_path / "json"), files.UPLOAD_SCHEMA, 1).count() == 1


def test_sessions_stream(spark, tmp_path, sf_dir):
    from tallymart.plans.streams import event_stream
    from tallymart.sources.views import Views
    from tallymart.streaming.changes import sessions
    from tallymart.streaming.run import drained

    out = drained(sessions(event_stream(Views(spark, sf_dir)), "user_id"), str(tmp_path))
    total = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert 0 < out.agg(F.sum("events")).first()[0] <= total


def test_jdbc_needs_a_driver(spark):
    with pytest.raises(Exception):
        files.read_jdbc(spark, "jdbc:none://x", "t").count()


def test_probe(spark, tmp_path):
    from tallymart.plans.onboarding import probe

    (tmp_path / "robots.txt").write_text("User-agent: *\nDisallow: /cart\nDisallow:\n")
    (tmp_path / "map.xml").write_text("<urlset><url><loc>https://s/p/1</loc></url><url><loc>https://s/cart/2</loc></url></urlset>")
    pages = spark.createDataFrame([("https://s/p/1", '{"@type":"Product","name":"a","sku":"7","offers":{"price":"10"}}')], "url string, json string")
    out = {r["loc"]: r for r in probe(spark, str(tmp_path / "robots.txt"), str(tmp_path / "map.xml"), pages).collect()}
    assert out["https://s/p/1"]["allowed"] and out["https://s/p/1"]["price"] == "10" and out["https://s/p/1"]["code"] == "7"
    assert not out["https://s/cart/2"]["allowed"] and not out["https://s/cart/2"]["fetched"]


def test_rebuild_keeps_every_listing(spark, sf_dir):
    from tallymart.plans.matching import m14_full_rebuild
    from tallymart.sources.views import Views

    v = Views(spark, sf_dir)
    out = m14_full_rebuild(v).collect()
    shops = v.usable.select("shop_id").distinct().count()
    assert out and all(1 <= r["sellers"] <= shops for r in out)
    assert not {r["brand"] for r in out} & {"Brand#10", "Brand#11"}


def test_text_paths(spark):
    from tallymart.functions.markup import text_paths

    got = spark.range(1).select(text_paths(F.lit("<div><p>a<br>b</p><p>c</p></div>")).alias("x")).first()["x"]
    assert got == {"div[1]/p[1]": "a b", "div[1]/p[2]": "c"}


def test_rebuild_and_mining_see_every_listing(spark, sf_dir, monkeypatch):
    from tallymart.plans import matching
    from tallymart.sources.views import Views

    v, seen = Views(spark, sf_dir), []
    monkeypatch.setattr(matching, "rebuild", lambda articles, listing, redirects: seen.append(listing) or (articles, None))
    monkeypatch.setattr(matching, "mine_rules", lambda rows: seen.append(rows.select("article_id", F.explode("shops").alias("shop_id"))))
    matching.m14_full_rebuild(v)
    matching.mine_rules_per_brand(v)
    sold = {tuple(r) for r in v.usable.select("article_id", "shop_id").distinct().collect()}
    assert {tuple(r) for r in seen[0].collect()} == sold
    articles = {r[0] for r in v.article.select("article_id").collect()}
    assert {tuple(r) for r in seen[1].collect()} == {r for r in sold if r[0] in articles}


def repairable(spark, rows_, sold):
    """Views of articles of one brand, with the sellers and prices of each."""
    v = Shop(spark, [(1, "a", "x")], [])
    v.article = spark.createDataFrame([(i, n, "x", p, 1, m, d) for i, n, p, m, d in rows_], "article_id long, name string, brand string, package string, units long, measure double, degrees double")
    v.usable = spark.createDataFrame([(i, s, p) for i, of, p in sold for s in of], "article_id long, shop_id long, price long")
    return v


def test_degrees_repaired(spark):
    """A lone article without degrees takes those of the most similar name of its class of measure."""
    rows_ = [(1, "pisco sour", "botella", 75.0, 0.0), (2, "pisco sour especial", "lata", 70.0, 35.0), (3, "pisco sour", "lata", 71.0, 12.0), (4, "pisco sour", "lata", 5.0, 9.0), (5, "agua", "caja", 75.0, 0.0), (6, "agua", "caja", 75.0, 0.0)]
    assert got(matching.m10_degrees_repaired(repairable(spark, rows_, [])), "article_id", "new_degrees", "score") == [(1, 12.0, 100)]


def test_names_repaired(spark):
    """A name that stands once is taken for a misspelling of one that other shops sell at a like price."""
    rows_ = [(1, "cerveza negra", "p", 1.0, 0.0), (2, "cervesa negra", "p", 1.0, 0.0), (3, "cerveza rubia", "p", 1.0, 0.0), (4, "cerveza negra", "p", 1.0, 5.0)]
    found = lambda sold: got(matching.m11_names_repaired(repairable(spark, rows_, sold)), "article_id", "new_name")
    assert found([(1, [1], 1990), (2, [2], 1990), (3, [1, 2], 1990)]) == [(2, "cerveza negra")]
    assert found([(1, [1, 2], 1990), (2, [2], 1990), (3, [1, 2], 1990)]) == [] and found([(1, [1], 9), (2, [2], 1990)]) == []


def test_basket_of_quantities(spark):
    """Subtotals and units count how many are wanted; a shop that alone sells an item is required."""
    basket = spark.createDataFrame([(1, "a", 3, 2), (1, "b", 1, 6), (2, "a", 1, 2)], "basket_id long, item string, quantity long, units long")
    shelf = spark.createDataFrame([(1, "a", 10), (1, "b", 50), (2, "a", 9), (3, "a", 1)], "shop_id long, item string, price long")
    areas = spark.createDataFrame([(1, 5, 0), (2, 0, 20)], "shop_id long, fee long, minimum long")
    rows_ = got(baskets.ranked(basket, shelf, areas), "basket_id", "shop_id", "found", "units", "wanted_units", "subtotal", "total", "complete", "enough", "required", "rank")
    assert rows_ == [(1, 1, 2, 12, 12, 80, 85, True, True, True, 1), (1, 2, 1, 6, 12, 27, 27, False, True, False, 2), (2, 1, 1, 2, 2, 10, 15, True, True, False, 1), (2, 2, 1, 2, 2, 9, 9, True, False, False, 2)]
