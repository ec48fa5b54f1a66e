"""Phrase dictionaries and consuming scans against plain versions; staged tables under repeats and failures."""

import random

import pytest
from pyspark.sql import functions as F

from tallymart.functions import text as T
from tallymart.operators.phrases import Automaton, brands_recognised, phrases_in, phrases_replaced
from tallymart.operators.staged import Staging, StagedTables, replace_partitions

MANY = 0  # letters beyond which a dictionary is joined


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abc ", k=rng.randint(1, 6)))
    dictionary = [(k // 2, p, rng.choice((None, "", "b", word()))) for k, p in enumerate(sorted({word() for _ in range(60)}))] + [(3, None, "x"), (4, "", "x"), (None, "ab", "x")]
    texts = [(k, "".join(rng.choices("abc d", k=rng.randint(0, 30)))) for k in range(120)] + [(500, None), (501, ""), (502, "日本 abc")]
    frames = spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame(dictionary, "ord long, phrase string, replacement string")
    return texts, sorted(((o, p, r or "") for o, p, r in dictionary if p and o is not None), key=lambda x: x[:2]), *frames


def test_automaton():
    rng = random.Random(1)
    phrases = sorted({"".join(rng.choices("ab", k=rng.randint(1, 5))) for _ in range(30)})
    find = Automaton(phrases)
    for _ in range(200):
        text = "".join(rng.choices("abc", k=20))
        assert find.found(text) == {n for n, p in enumerate(phrases) if p in text}


@pytest.mark.parametrize("most", [MANY, 1_000_000])
def test_phrases_found(data, most):
    texts, dictionary, df, table = data
    found = {r["k"]: [(x["ord"], x["phrase"]) for x in r["found"]] for r in phrases_in(df, table, "k", most).collect()}
    expected = {k: [(o, p) for o, p, _ in dictionary if p in t] for k, t in texts if t}
    assert found == {k: v for k, v in expected.items() if v}


@pytest.mark.parametrize("padded", [False, True])
@pytest.mark.parametrize("most", [MANY, 1_000_000])
def test_phrases_replaced_in_order(spark, data, most, padded):
    texts, dictionary, df, table = data
    if most == MANY:  # a round for each phrase that a text holds
        texts, df = texts[:25], df.where("k < 25")
        texts = [t for t in texts if t[0] < 25]

    def plain(text):
        hits = []
        for o, p, r in dictionary:
            if p in text and (not padded or f" {p} " in f" {text} "):
                text = text.replace(p, r)
                hits.append(o)
        return text, hits

    found = {r["k"]: (r["text"], r["hits"]) for r in phrases_replaced(df, table, "k", padded, most).collect()}
    assert found == {k: (None, []) if t is None else plain(t) for k, t in texts}


@pytest.mark.parametrize("most", [MANY, 1_000_000])
def test_brands(spark, most):
    brands = spark.createDataFrame([(1, "sol", True), (2, "agua sol", True), (3, "luna", True), (4, "old", False), (5, "gone", False)], "ord long, brand string, enabled boolean")
    redirects = spark.createDataFrame([("old", "luna")], "brand string, target string")
    cases = [("pan sol xl", "sol", "sol", "pan  xl"), ("agua sol 1 lt", "?", "sol", "agua  1 lt"), ("girasol luna", None, "luna", "girasol "), ("girasoles", "", "sol", "giraes"), ("pan", "old", "luna", "pan"), ("pan", "gone", "gone", "pan"), ("pan", "new", "new", "pan"), ("pan", "n", None, "pan"), (None, "sol", "sol", None), (None, None, None, None)]
    names = spark.createDataFrame([(k, t, b) for k, (t, b, _, _) in enumerate(cases)], "k long, text string, brand string")
    found = {r["k"]: (r["brand"], r["name"]) for r in brands_recognised(names, brands, redirects, "k", most).collect()}
    assert found == {k: (b, n) for k, (_, _, b, n) in enumerate(cases)}


UNITS = ["ml", "lt", "gr", "kg"]


@pytest.mark.parametrize("text,expected", [
    ("agua 500 ml", ("500", "ml", "", "agua")), ("agua 500ml fria", ("500", "ml", "", "agua fria")), ("ron 1,5lt", ("1,5", "lt", "", "ron")), ("pan kg", ("1", "kg", "", "pan")), ("caja 10x20cm 3 kg x", ("3", "kg", "", "caja 10x20cm x")),
    ("3 kg caja 10x20cm", ("", "", "10x20cm", "3 kg caja")), ("a 2 lt b 3 lt", ("3", "lt", "", "a 2 lt b")), ("a b", ("", "", "", "a b")), ("", ("", "", "", "")), ("kg", ("1", "kg", "", "")), ("5 kg 5 kg", ("5", "kg", "", "5 kg")),
])
def test_measure_taken(spark, text, expected):
    (row,) = spark.createDataFrame([(text,)], "t string").select(T.measure_taken(F.col("t"), UNITS).alias("m")).collect()
    assert tuple(row["m"]) == expected


@pytest.mark.parametrize("text,expected", [
    ("pan 6 unidades y 2 unidades", (6, "pan  y")), ("12 huevos", (12, "huevos")), ("pan 3 packs x 2 packs x a", (3, "pan   a")), ("pan 1 unidad x 4", (4, "pan")), ("pan x 4", (4, "pan")), ("pan", (1, "pan")), ("", (1, "")),
])
def test_packs_taken(spark, text, expected):
    (row,) = spark.createDataFrame([(text,)], "t string").select(T.packs_taken(F.col("t")).alias("p")).collect()
    assert tuple(row["p"]) == expected


def test_units_taken(spark):
    rows = spark.createDataFrame([("pan 3 uds y 2 uds",), ("uds 3",), ("2,5 unidades pan",), ("",)], "t string").select(T.units_taken(F.col("t"), ["unidades", "uds"]).alias("u")).collect()
    assert [tuple(r["u"]) for r in rows] == [(3.0, "pan y 2 uds"), (1.0, "uds 3"), (2.5, "pan"), (1.0, "")]


def table(spark, tmp_path):
    return StagedTables(spark, str(tmp_path / "t"), {"one": "k long, v string, n long", "two": "k long"})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upserts_once(spark, tmp_path):
    t = table(spark, tmp_path)
    new = lambda *r: spark.createDataFrame(list(r), "k long, v string, n long")
    assert rows(t.read("one")) == []
    add = {"n": lambda o, n: o + n}
    assert t.upsert("one", new((1, "a", 1), (None, "z", 5)), ["k"], "w", 0, merge=add)
    assert t.upsert("one", new((1, "b", 2), (2, "c", 3), (None, "y", 1)), ["k"], "w", 1, merge=add)
    expected = [(1, "b", 3), (2, "c", 3), (None, "y", 6)]
    assert rows(t.read("one")) == sorted(expected, key=str)
    assert not t.upsert("one", new((1, "b", 2)), ["k"], "w", 1, merge=add) and not t.replace({"one": new()}, "w", 0)  # a batch that is tried again
    assert rows(t.read("one")) == sorted(expected, key=str)
    assert t.upsert("one", new((2, "d", 1)), ["k"], "other", 0, merge=add)  # another writer has its own numbers
    t.forget_old(1)
    assert rows(t.read("one")) == sorted([(1, "b", 3), (2, "d", 4), (None, "y", 6)], key=str)


def test_failure_leaves_the_old_rows(spark, tmp_path):
    t = table(spark, tmp_path)
    t.replace({"one": spark.createDataFrame([(1, "a", 1)], "k long, v string, n long"), "two": spark.range(2).withColumnRenamed("id", "k")})
    bad = spark.range(3).select(F.col("id").alias("k"), F.raise_error(F.lit("lost")).cast("string").alias("v"), F.lit(1).alias("n"))
    with pytest.raises(Exception, match="lost"):
        t.replace({"two": spark.range(9).withColumnRenamed("id", "k"), "one": bad})
    assert rows(t.read("one")) == [(1, "a", 1)] and t.read("two").count() == 2  # neither table changes
    before = t.current()
    t.replace({"one": spark.createDataFrame([(2, "b", 1)], "k long, v string, n long")})
    with pytest.raises(RuntimeError, match="another writer"):  # one that began from the older version
        t._publish(before, {"one": "data/none"}, None, None)
    assert rows(t.read("one")) == [(2, "b", 1)] and t.read("two").count() == 2


def test_stream_is_put_in_once(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, n long").write.parquet(source)
    t = table(spark, tmp_path)
    calls = []
    sink = t.sink("one", ["k"], "stream", merge={"n": lambda o, n: o + n})

    def twice(batch, number):  # as after a failure between the write and the stream's own note of it
        calls.append(number)
        sink(batch, number)
        sink(batch, number)

    for _ in range(2):
        q = spark.readStream.schema("k long, v string, n long").parquet(source).writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        spark.createDataFrame([(2, "c", 4)], "k long, v string, n long").write.mode("append").parquet(source)
    assert rows(t.read("one")) == [(1, "a", 1), (2, "c", 5)] and calls == [0, 1]


def test_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "p")
    new = lambda *r: spark.createDataFrame(list(r), "k long, day string")
    for _ in range(2):
        replace_partitions(new((1, "a"), (2, "b")), path, "day")
        replace_partitions(new((3, "b")), path, "day")
    assert rows(spark.read.parquet(path)) == [(1, "a"), (3, "b")]


def test_staging_cuts_lineage(spark):
    s = Staging(spark, "test")
    df = spark.range(5)
    for _ in range(4):
        df = s.put(df.withColumn("id", F.col("id") + 1))
    assert rows(df) == [(k,) for k in range(4, 9)] and "Project" not in df._jdf.queryExecution().executedPlan().toString()
