"""Shops of baskets by tables of prices: what listing all pairs gives, without listing them."""

import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymart.operators import shelves
from tallymart.plans import baskets

QUERIES = [baskets.basket_ranking, baskets.basket_cheapest_complete, baskets.basket_below_minimum]


def tables(spark, odd=(), density=0.5, shops=70, n=300, seed=1):
    r = random.Random(seed)
    items = [f"i{k}" for k in range(12)]
    shelf = [(s * 7 % 501, i, r.choice((1, 2, 5, r.randint(1, 400)))) for s in range(shops) for i in items if r.random() < density]
    lines = [(b, i, r.choice((1, 2, r.randint(1, 40))), r.randint(1, 6)) for b in range(n) for i in r.sample([*items, "nobody's"], r.randint(1, 9))]
    lines += [(b + 1_000, i, q, u) for b, i, q, u in lines if b < 40]  # equal contents
    areas = [(s * 7 % 501, baskets.DISTRICT, s % 4 * 30, s % 5 * 300) for s in range(shops - 3)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).localCheckpoint()
    return SimpleNamespace(
        basket=frame([*lines, *odd], "basket_id long, item string, quantity long, units long"), shelf=frame(shelf, "shop_id long, item string, price long"), delivery_area=frame(areas, "shop_id long, district_id long, fee long, minimum long")
    )


ODD = [(5001, "i1", None, 2), (5001, "i2", 3, 2), (5002, "i3", 0, 1), (5003, "i4", 2, None), (5004, "i5", -3, 1), (5004, "i6", 9, 1), (5005, "i7", 1 << 52, 1), (None, "i1", 1, 1)]


@pytest.mark.parametrize("query", QUERIES)
@pytest.mark.parametrize("shape", [{"density": 0.85}, {"density": 0.2, "odd": ODD}, {"density": 0.5, "shops": 5}], ids=str)
def test_equals_all_pairs_and_lists_only_those_of_odd_baskets(spark, monkeypatch, query, shape):
    v = tables(spark, **shape)
    seen, inner = [], baskets._found
    monkeypatch.setattr(baskets, "_found", lambda lines, sold: seen.append(lines) or inner(lines, sold))
    got = query(v)
    rows = sorted(map(tuple, got.collect()))
    assert {r[0] for x in seen for r in x.select("basket_id").collect()} == {r[0] for r in shape.get("odd", ()) if r[0] is not None}
    monkeypatch.setattr(baskets, "_shelves", lambda sold, items: None)
    listed = query(v)
    assert rows == sorted(map(tuple, listed.collect())) and rows and got.dtypes == listed.dtypes


@pytest.mark.parametrize("query", QUERIES)
def test_parts_and_narrow_blocks_change_nothing(spark, monkeypatch, query):
    v = tables(spark, odd=ODD)
    whole = sorted(map(tuple, query(v).collect()))
    monkeypatch.setattr(baskets, "CELLS", 300)
    assert sorted(map(tuple, query(v).collect())) == whole


def test_shelves_with_something_twice_or_almost_empty_are_listed(spark):
    v = tables(spark)
    sold = v.shelf.join(baskets.areas_of(v), "shop_id").withColumn("alone", F.lit(False)).withColumn("item", F.substring("item", 2, 9).cast("int"))
    assert len(baskets._shelves(sold, 12)) == 1
    assert baskets._shelves(sold.unionByName(sold.limit(1)), 12) is None and baskets._shelves(sold, 12 * 64) is None and baskets._shelves(sold.limit(0), 0) is None


def test_contents_are_told_apart():
    size, items = np.array([2, 2, 1, 1, 2, 2]), np.array([1, 2, 1, 2, 1, 2, 1, 2, 1, 3])
    assert shelves.contents(np.append(0, np.cumsum(size)), [items]).tolist() == [0, 0, 1, 2, 3, 4]


@pytest.mark.parametrize("few", [1, 4, 64])
@pytest.mark.parametrize("density", [0.1, 0.5, 0.95])
def test_shops_within_a_budget_are_those_of_all_sums(monkeypatch, few, density):
    monkeypatch.setattr(shelves, "FEW", few)
    r, items, shops = np.random.default_rng(few), 30, 200
    item, shop = np.nonzero(r.random((items, shops)) < density)
    s = shelves.Shelves(items, item, shop, r.integers(1, 5, len(item)) ** r.integers(1, 6, len(item)), np.arange(shops) * 3, r.integers(0, 4, shops) * 50, r.integers(0, 4, shops) * 400, np.zeros(items, bool))
    for k in range(1, 9):
        m, q = np.sort(r.random((150, items + 1)).argsort(axis=1)[:, :k], axis=1), r.integers(1, 5, (150, k)) ** 2
        total, whole = s.added(m, q), (s.prices[m] > 0).all(axis=1)
        enough = total >= s.minimum
        keys = s.every(m, q, s.whole(m), 3)
        row, rank = np.nonzero(keys != shelves.NONE)
        assert [x.tolist() for x in s.ranked(m, q, 3)] == [row.tolist(), (keys[row, rank] & (1 << s.places) - 1).tolist(), (rank + 1).tolist()]
        have = np.flatnonzero((total > 0).any(axis=1))
        assert [x.tolist() for x in s.below(m, q)] == [have.tolist(), ((total > 0) & ~enough).sum(axis=1)[have].tolist(), whole.sum(axis=1)[have].tolist()]
        right = whole & enough
        row, a, b = np.flatnonzero(right.any(axis=1)), np.where(right, total + s.fee, shelves.NONE), np.where(right, total, shelves.NONE)
        assert [x.tolist() for x in s.cheapest(m, q)] == [x[row].tolist() for x in (np.arange(150), a.argmin(1), a.min(1), b.argmin(1), b.min(1))]
