"""Baskets against many sellers: equal contents are met once, and sellers in several parts give what they give at once."""

import pytest
from pyspark.sql import functions as F

from tallymart.plans import baskets
from tallymart.sources import views
from tallymart.sources.views import Views


@pytest.fixture(scope="module")
def copies(spark, sf_dir, tmp_path_factory):
    """Shops, articles and orders three times."""
    at = tmp_path_factory.mktemp("baskets")
    each = lambda name, *keys: spark.read.parquet(f"{sf_dir}/{name}.parquet").crossJoin(spark.range(3).select(F.col("id").alias("k"))).withColumns({c: F.col(c) + F.col("k") * 1_000_000 for c in keys}).drop("k").write.parquet(f"{at}/{name}.parquet")
    each("part", "p_partkey"), each("supplier", "s_suppkey"), each("lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    for name in ("nation", "region"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
    return Views(spark, str(at))


def test_pairs_of_baskets_and_shops_are_not_moved_and_equal_baskets_met_once(copies, monkeypatch):
    seen, inner = [], baskets._found
    monkeypatch.setattr(baskets, "_found", lambda lines, sold: seen.append((lines.select("basket_id").distinct().count(), inner(lines, sold)._jdf.queryExecution().executedPlan().toString())) or inner(lines, sold))
    whole = sorted(map(tuple, baskets.basket_ranking(copies).collect()))
    n = copies.basket.select("basket_id").distinct().count()
    assert whole and seen[0][0] <= n // 3
    assert seen[0][1].count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in seen[0][1] and "hashpartitioning(basket_id#" in seen[0][1]
    assert not any("shop_id" in line for line in seen[0][1].splitlines() if "Exchange hashpartitioning" in line)


@pytest.mark.parametrize("query", [baskets.basket_ranking, baskets.basket_cheapest_complete, baskets.basket_below_minimum])
def test_sellers_in_parts(copies, monkeypatch, query):
    whole = sorted(map(tuple, query(copies).collect()))
    monkeypatch.setattr(baskets, "SELLERS", 300)
    monkeypatch.setattr(baskets, "PAIRS", 500)
    assert sorted(map(tuple, query(copies).collect())) == whole and whole


def test_lists_are_put_together_in_more_tasks_as_they_grow(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(views, "ROWS", 100)
    v = Views(spark, sf_dir)
    assert "REPARTITION_BY_NUM" in (plan := v.basket._jdf.queryExecution().executedPlan().toString()) and f", {-(-v.table('lineitem').count() // 100)})" in plan
