"""Work that grows with copies of the articles: pairs in blocks, likes by classes, and joins that send no large side to the driver."""

import itertools

import pytest
from pyspark.sql import functions as F

from tallymart.operators.similar import pairs_of_rows
from tallymart.operators import mining
from tallymart.plans import catalog, details, matching, normalise, searches
from tallymart.sources.views import Views


@pytest.fixture(scope="module")
def copies(spark, sf_dir, tmp_path_factory):
    """The articles and their offers five times."""
    at = tmp_path_factory.mktemp("copies")
    each = lambda name, *keys: spark.read.parquet(f"{sf_dir}/{name}.parquet").crossJoin(spark.range(5).select(F.col("id").alias("k"))).withColumns({c: F.col(c) + F.col("k") * 1_000_000 for c in keys}).drop("k").write.parquet(f"{at}/{name}.parquet")
    each("part", "p_partkey")
    each("lineitem", "l_partkey")
    return Views(spark, str(at))


def test_pairs_of_rows_in_blocks(spark):
    rows = [("g", n, 10 * i + k) for i, n in enumerate("ab") for k in range(7)] + [("h", "a", 100), (None, "a", 101)]
    pairs = [("g", x, y, 1 if x == y else 2) for x in "ab" for y in "ab"]
    found = pairs_of_rows(spark.createDataFrame(rows, "g string, name string, id long"), spark.createDataFrame(pairs, "g string, x string, y string, score int"), ["g"], "id", "other", block=2, per_task=5)
    expected = [(i, j, 1 if m == n else 2) for (g, m, i), (h, n, j) in itertools.product(rows, rows) if g == h == "g" and i < j]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert found.rdd.getNumPartitions() >= len(expected) // 5


def test_articles_of_one_name_and_seller_count_are_one_node(copies, monkeypatch):
    seen, inner = [], details.components
    monkeypatch.setattr(details, "components", lambda edges: seen.append(edges.select(F.explode(F.array("a", "b")).alias("x")).distinct().count()) or inner(edges))
    found = details.m15_similar_groups(copies)
    n = copies.article.join(copies.listing, "article_id").select("article_id").distinct().count()
    assert found.count() == n and seen[0] <= n // 2


def test_names_are_broadcast_and_not_the_texts(copies, monkeypatch):
    from tallymart.operators import tables

    expected = sorted(map(tuple, normalise.token_subsets(copies).collect()))
    monkeypatch.setattr(normalise, "small", lambda df: tables.small(df, 0))
    large = normalise.token_subsets(copies)
    assert "BroadcastHashJoin" not in large._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, large.collect())) == expected


def test_wildcard_pairs_in_parts(copies, monkeypatch):
    whole = sorted(map(tuple, catalog.p10_wildcard_predicate(copies).collect()))
    monkeypatch.setattr(catalog, "PART", 1)
    assert sorted(map(tuple, catalog.p10_wildcard_predicate(copies).collect())) == whole and whole


def test_searches_of_equal_words_meet_equal_names_once(copies, spark, sf_dir, monkeypatch):
    seen, inner = [], searches.searched
    monkeypatch.setattr(searches, "searched", lambda asks, rows, *rest: seen.append((asks.count(), rows.count())) or inner(asks, rows, *rest))
    found = {r["search_id"]: r["found"] for r in searches.q01_many_searches(copies).collect()}
    once = {r["search_id"]: r["found"] for r in searches.q01_many_searches(Views(spark, sf_dir)).collect()}
    assert once and {k: found[k] for k in once} == {k: 5 * n for k, n in once.items()}
    assert seen[0][1] == seen[1][1] == copies.article.select(F.lower("name")).distinct().count()


def test_mining_links_copies_no_more_than_once(copies, spark, sf_dir, monkeypatch):
    monkeypatch.setitem(vars(copies), "shop", Views(spark, sf_dir).shop)
    seen, inner = [], mining.components
    monkeypatch.setattr(mining, "components", lambda edges: seen.append(edges.distinct().count()) or inner(edges))
    for v in (Views(spark, sf_dir), copies):
        matching.mine_rules_per_brand(v)
    assert seen[0] == seen[1] > 0


def test_rebuild_reads_listings_once(copies, spark, sf_dir, monkeypatch):
    """Articles follow their chains of rules, up to three, with the shops that they were put down with."""
    monkeypatch.setitem(vars(copies), "shop", Views(spark, sf_dir).shop)
    rule = "article_id long, into_id long, brand string"
    monkeypatch.setattr(matching, "mine_rules", lambda rows: spark.createDataFrame([], rule))
    assert not [f for f in matching.m14_full_rebuild(copies).inputFiles() if "/lineitem.parquet/" in f]
    monkeypatch.setattr(matching, "mine_rules", lambda rows: spark.createDataFrame([(k, k + 1, "b") for k in range(1, 5)], rule))
    articles = spark.createDataFrame([(k, "b", f"n{k}", 1.0, 0.0, 1, "p", "s") for k in range(1, 8)], "article_id long, brand string, name string, measure double, degrees double, units long, package string, size string")
    listing = spark.createDataFrame([(k, s) for k in range(1, 7) for s in (10 * k, 10 * k + 1)] + [(6, 60)], "article_id long, shop_id long")
    out, hits = matching.rebuild(articles, listing, spark.createDataFrame([("x", "y")], "brand string, target string"))
    assert {r["article_id"]: r["sellers"] for r in out.collect()} == {4: 2, 5: 8, 6: 2}
    assert {r["article_id"]: r["hits"] for r in hits.collect()} == {1: 2, 2: 2, 3: 2, 4: 2}
