"""Rules mined over components and in rounds against the sequential steps of each brand."""

import random

import numpy as np
import pandas as pd
import pytest

from tallymart.operators import mining
from tallymart.operators.graph import components

SCHEMA = "article_id long, brand string, name string, measure double, degrees double, units long, package string, size string, shops array<long>"


def articles(seed, n, brands=2, shops=12):
    rng = random.Random(seed)
    base = ["agua mineral", "agua tonica", "jugo naranja", "jugo de naranja", "vino tinto"]
    out = []
    for k in range(n):
        name = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            name[rng.randrange(len(name))] = rng.choice("abc ")
        sold = sorted(rng.sample(range(shops), rng.choice((0, 1, 1, 1, 2, 2, 3))))
        out.append((k, f"b{rng.randrange(brands)}", "".join(name), rng.choice((0.0, 0.0, 1.0, None)), rng.choice((0.0, 12.5)), rng.choice((1, 1, 6)), rng.choice(("", "", "box", None)), rng.choice((None, "", "xl")), sold or None))
    return out


def rules_of_brands(rows):
    """The sequential steps, one brand at a time, in this process."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    out = []
    for brand in sorted({r[1] for r in rows}):
        found = mining.Brand(pd.DataFrame([r for r in rows if r[1] == brand], columns=names)).mined()
        out += [tuple(None if x != x else x for x in r) for r in found.itertuples(index=False)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,most", [(1, 2_000), (2, 2_000), (3, 0)])
def test_rules_equal_the_sequential_steps(spark, monkeypatch, seed, most):
    """With no component small enough for one task, fewer levels, as each pass is several jobs there."""
    if most == 0:
        for name, levels in (("FILL_LEVELS", (70, 40)), ("AGAIN_LEVELS", ()), ("SELLER_LEVELS", (60,))):
            monkeypatch.setattr(mining, name, levels)
    rows = articles(seed, 100 if most == 0 else 160)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    expected = rules_of_brands(rows)
    assert len(expected) > 10 and len({r[3] for r in expected}) > 2
    assert sorted((tuple(r) for r in mining.mine_rules(df, most).collect()), key=str) == expected


@pytest.mark.parametrize("shops,tried", [(4, 32), (12, 1), (100, 1)])
def test_components_take_the_same_steps(monkeypatch, shops, tried):
    """With few targets tried one by one, the others are found by the shops that they hold."""
    monkeypatch.setattr(mining.Component, "TRIED", tried)
    rows = [r for r in articles(shops, 400, 1, shops) if r[8]]
    df = pd.DataFrame([(*r[:8], np.array(r[8]), mining.words_sorted(r[2])) for r in rows], columns=[*(c.split()[0] for c in SCHEMA.split(", ")), "sorted"])
    found = [tuple(None if x != x else x for x in r) for r in mining.Component(df).mined().itertuples(index=False)]
    assert sorted(found, key=str) == rules_of_brands(rows) and len(found) > 10


def test_links_grow_with_classes_and_not_with_pairs(spark, monkeypatch):
    seen, inner = [], mining.components
    monkeypatch.setattr(mining, "components", lambda edges: seen.append(edges.count()) or inner(edges))
    rows = [(k, "b", "agua", 1.0, 12.5, 1, ("", "box")[k % 2], "xl", [k]) for k in range(400)]
    found = sorted((tuple(r) for r in mining.mine_rules(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert found == rules_of_brands(rows) and len(found) == 399 and seen[0] < 20


def test_empty_names_are_alike(spark, monkeypatch):
    for name, levels in (("FILL_LEVELS", (70,)), ("AGAIN_LEVELS", ()), ("SELLER_LEVELS", (60,))):
        monkeypatch.setattr(mining, name, levels)
    rows = [(1, "b", None, 1.0, 12.5, 1, "", "xl", [1]), (2, "b", "!", 1.0, 12.5, 1, "box", "xl", [2])]
    for most in (2_000, 0):
        found = [tuple(r) for r in mining.mine_rules(spark.createDataFrame(rows, SCHEMA), most).collect()]
        assert found == rules_of_brands(rows) and len(found) == 1


def test_decisions_of_a_target():
    """Taken, refused because of what was taken, open behind a source that may still come, and taken beside it."""
    import pyarrow as pa

    rows = [(1, 10, 90, True, [1], [9]), (1, 11, 90, True, [1, 2], [9]), (1, 12, 90, False, [3], [9]), (1, 13, 90, True, [3, 4], [9]), (1, 14, 90, True, [5], [9]), (2, 10, 90, True, [1], [1])]
    batch = pa.RecordBatch.from_pylist([dict(zip(("t", "s", "score", "top", "mine", "theirs"), r)) for r in rows])
    (out,) = mining._decided([batch])
    assert out.column("says").to_pylist() == ["taken", "refused", "open", "open", "taken", "refused"]


def test_no_rules(spark):
    assert mining.mine_rules(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mining.mine_rules(spark.createDataFrame([(1, "b", "a", 0.0, 0.0, 1, "", "", [1]), (2, "c", "a", 1.0, 0.0, 1, "", "", [2])], SCHEMA)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(100 + k, 100) for k in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(300, 300), (None, 1)]
    root = {x: x for e in edges if None not in e for x in e}
    for _ in root:
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mined_query_equals_the_sequential_steps(spark, sf_dir):
    from tallymart.plans.rebuild import single_sellers
    from tallymart.registry import QUERIES
    from tallymart.sources.views import Views

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = [tuple(r) for r in single_sellers(Views(spark, sf_dir)).select(*names).collect()]
    found = QUERIES["m09_rules_mined"](spark, sf_dir).collect()
    assert sorted(map(tuple, found), key=str) == rules_of_brands(rows) and len(found) > 1


def test_rebuild_is_applied_once(spark, sf_dir):
    from tallymart.plans.rebuild import rebuild_tables, rebuilt
    from tallymart.sources.views import Views

    v = Views(spark, sf_dir)
    tables = rebuilt(v)
    before = tables.current()
    assert before["version"] == 2 and before["batches"] == {"rebuild": 1}
    assert not rebuild_tables(tables, v.article, 1) and tables.current() == before
    assert tables.read("rules").where("automatic and hits = 0").count() == 0 < tables.read("rules").where("not automatic and hits = 0").count()
