"""Searches over posting lists against scans, and what barcodes fill."""

import random

from pyspark.sql import functions as F

from tallymart.operators import postings
from tallymart.operators.postings import met, posting_lists, searched
from tallymart.plans.searches import barcodes_filled


def test_searches_equal_scans(spark, monkeypatch):
    monkeypatch.setattr(postings, "BUCKET", 7)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcÑ", k=rng.randint(1, 6)))
    rows = [(k, " ".join(word() for _ in range(rng.randint(1, 4)))) for k in range(150)] + [(200, None), (None, "abc"), (201, "")]
    asked = [(k, [w if rng.random() < 0.5 else w.upper() for w in (word()[: rng.randint(1, 4)] for _ in range(rng.randint(1, 3)))]) for k in range(80)] + [(900, []), (901, [""])]
    asked += [(300 + k, t.split()[:2]) for k, t in rows[:40]]
    df, ask = spark.createDataFrame(rows, "id long, name string"), spark.createDataFrame(asked, "s long, words array<string>")
    found = sorted(tuple(r) for r in searched(ask, df, posting_lists(df, "id", "name"), "s", "id", "name").collect())
    expected = []
    for s, words in asked:
        words = [w.lower() for w in words if w]
        expected += [(s, i) for i, n in rows if words and n is not None and i is not None and n.lower().startswith(words[0]) and all(w in n.lower() for w in words)]
    assert found == sorted(expected) and len(expected) > 60
    lists = posting_lists(df, "id", "name").collect()
    assert all(r["ids"] == sorted(set(r["ids"])) and max(r["ids"]) < 7 for r in lists)
    assert met(ask.where("s = 300"), posting_lists(df, "id", "name"), "s").count() < len(rows)


def test_barcodes_filled(spark):
    rows = [
        (1, "e", "short", 0.0, 1.0, None, "", [1]), (2, "e", "a longer name", 12.5, 3.0, "box", None, [2]), (3, "e", "other", 5.0, 2.0, "bag", "xl", [2, 3]), (4, "e", "tiny", 0.0, 2.0, "can", "s", [4]), (5, "e", "without", 9.0, 9.0, "x", "y", []),
        (6, "f", "alone", 0.0, 1.0, None, None, [1]), (7, "g", "one", 0.0, 1.0, None, None, [1]), (8, "g", "two", 1.0, 1.0, None, None, [1]), (9, "h", "none", 0.0, 1.0, None, None, []), (10, "h", "some name", 1.0, 1.0, None, None, [3]),
    ]
    df = spark.createDataFrame(rows, "article_id long, ean string, name string, degrees double, measure double, package string, size string, shops array<long>").orderBy(F.desc("article_id"))
    assert [tuple(r) for r in barcodes_filled(df).collect()] == [("e", 1, 12.5, 3.0, "box", "s", "a longer name", 3, 3)]
