"""Similarity joins of names against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymart.functions.text import likeness
from tallymart.operators import similar
from tallymart.operators.similar import Names, best_names, closest, distances, similar_names


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def score(a, b):
    return int(100.0 * (1.0 - edits(a, b) / max(len(a), len(b), 1)) + 0.5)


def misspelt(rng, n, letters="abcdefgh "):
    """Names, and others that a few edits part from them; very short and long ones too."""
    out = []
    while len(out) < n:
        base = "".join(rng.choices(letters, k=rng.choice((1, 2, 3, 6, 12, 18, 25))))
        out.append(base)
        for _ in range(rng.randint(0, 4)):
            s = list(base)
            for _ in range(rng.randint(1, 1 + len(base) // 6)):
                k = rng.randrange(len(s) + 1)
                s[k : k + rng.randint(0, 1)] = rng.choice(("", "x", rng.choice(letters)))
            out.append("".join(s))
    return out[:n]


def test_distances():
    rng = random.Random(1)
    x, y = misspelt(rng, 300, "abé日"), misspelt(rng, 300, "abé日")
    a, b = Names(x), Names(y)
    i = np.arange(300)
    assert distances(a.letters, a.length, b.letters, b.length).tolist() == [edits(p, q) for p, q in zip(x, y)]
    assert (a.bound(b)[i, i] >= [score(p, q) for p, q in zip(x, y)]).all()


@pytest.mark.parametrize("least", [100, 95, 90, 80, 79, 60, 1])
def test_pairs_equal_all_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(similar, "TILE", 16)
    rng = random.Random(least)
    left, right = [(rng.choice("PQ"), n) for n in misspelt(rng, 90) + [""]], [(rng.choice("PQ"), n) for n in misspelt(rng, 60) + ["", "a"]]
    right += [(b, n) for b, n in left[:40]] + [(b, n[:3] + "z" + n[3:]) for b, n in left[40:80]]
    rows = lambda x: spark.createDataFrame(x + [(None, "a"), ("P", None)], "brand string, name string")
    found = sorted(tuple(r) for r in similar_names(rows(left), rows(right), ["brand"], least).collect())
    assert found == sorted({(b, x, y, score(x, y)) for b, x in left for c, y in right if b == c and score(x, y) >= least})
    best = {(r["brand"], r["x"]): (r["score"], r["id"]) for r in best_names(rows(left), rows(right).withColumn("id", F.crc32("name").cast("long") % 50), ["brand"], least).collect()}
    import zlib

    expected = {}
    for b, x in left:
        near = [(score(x, y), -(zlib.crc32(y.encode()) % 50)) for c, y in right if b == c and score(x, y) >= least]
        if near:
            expected[(b, x)] = (max(near)[0], -max(near)[1])
    assert best == expected


def test_scores_are_those_of_the_expressions(spark):
    rng = random.Random(4)
    pairs = list(zip(misspelt(rng, 200), misspelt(rng, 200)))
    df = spark.createDataFrame(pairs, "x string, y string").select("x", "y", likeness(F.col("x"), F.col("y")).alias("s"))
    assert all(r["s"] == score(r["x"], r["y"]) for r in df.collect())


def test_brand_of_fifty_thousand_names(spark):
    """One group: names meet by rare pieces, so what is compared grows with the copies and not with the square of the names."""
    rng = random.Random(9)
    base = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=20)) for _ in range(25_000)})
    names = base + [n[:7] + "~" + n[8:] for n in base]
    df = spark.createDataFrame([("one", n) for n in names], "brand string, name string").repartition(8)
    found = similar_names(df, df, ["brand"], 90)
    assert found.count() == 100_000 and found.where("x = y").count() == 50_000
    ids = df.select("brand", "name", F.xxhash64("name").alias("id"))
    assert best_names(df.where("name like '%~%'"), ids.where("name not like '%~%'"), ["brand"], 90).where("score = 95").count() == 25_000


def test_closest_of_ties():
    x, y = Names(["abcd", "zzzz"]), Names(["abce", "abcf", "zzzz", "abcd x"])
    i, ids, scores = closest(x, y, np.array([9, 4, 2, 1]), 50)
    assert (i.tolist(), ids.tolist(), scores.tolist()) == ([0, 1], [4, 2], [75, 100])


@pytest.mark.parametrize("least", range(similar.PREFIX, 101))
def test_names_have_pieces_enough(least):
    """What the index rests on: a name has more pieces than the edits that its longest possible partner may need can destroy, and shorter ones need none."""
    share, size = (100.5 - least) / 100, similar.piece_length(least)
    for n in range(400):
        edits = int(share / (1 - share) * n + 1e-9)
        assert n - (size - 1) >= edits * size + 1 if n >= size else edits == 0
