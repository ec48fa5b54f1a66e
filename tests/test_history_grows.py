"""Matrices and as-of joins whose rows are moved once."""

import datetime

from pyspark.sql import functions as F

from tallymart.operators import intervals
from tallymart.plans.history import price_matrix


def test_matrix_moves_rows_once(spark):
    """One exchange, by the key: the grid of events and shops isn't moved."""
    df = spark.range(2000).select((F.col("id") % 50).alias("a"), (F.col("id") % 7).alias("shop_id"), (F.col("id") * 37 % 101).alias("ts"), F.col("id").alias("price"))
    for backfill in (None, "final"):
        plan = price_matrix(df, "a", backfill).hint("merge")._jdf.queryExecution().executedPlan().toString()
        assert all("hashpartitioning(a#" in line and "shop_id" not in line.split("hashpartitioning")[1].split("]")[0] and "ts#" not in line.split("hashpartitioning")[1] for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_matrix_equals_looking_back(spark):
    """Null prices, shops and times too; a null time is behind all others."""
    rows = [(i % 3 or None, i * 7 % 5 or None, i * 37 % 11 or None, i * 13 % 9 or None) for i in range(90)]
    df = spark.createDataFrame(rows, "a long, shop_id long, ts long, price long")
    key = lambda t: float("inf") if t is None else t
    for backfill in (None, "final"):
        expected = []
        for a in (1, 2):
            mine = [r for r in rows if r[0] == a]
            for s in {r[1] for r in mine}:
                own = {t: max(r[3] for r in mine if r[1] == s and r[2] == t and r[3] is not None) for t in {r[2] for r in mine if r[1] == s and None not in (s, r[2], r[3])}}
                for t in {r[2] for r in mine}:
                    before = [x for x in own if x <= key(t)]
                    expected.append((a, t, s, own[max(before)] if before else own[max(own)] if own and backfill else None))
        assert sorted(map(tuple, price_matrix(df, "a", backfill).collect()), key=str) == sorted(expected, key=str)


def test_as_of_without_buckets_and_with(spark, monkeypatch):
    """Long intervals aren't copied into each bucket that they touch, unless their key has too many pairs; both ways give the same."""
    day = lambda n: datetime.datetime(2000, 1, 1) + datetime.timedelta(n)
    spans = spark.createDataFrame([(k, k * 10 + i, day(i * 40), day(i * 40 + 40 + 7 * k) if i < 8 else None) for k in range(5) for i in range(9)], "k long, v long, since timestamp, until timestamp")
    asked = spark.createDataFrame([(k, day(n), n) for k in range(6) for n in range(-20, 500, 13)], "k long, ts timestamp, n long")
    spread = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("_bucket")
    whole = intervals.as_of(asked, spans, ["k"], days=3)
    rows = sorted(map(tuple, whole.collect()))
    assert rows and not spread(whole)
    for pairs in (0, 200, 359):
        monkeypatch.setattr(intervals, "PAIRS", pairs)
        cut = intervals.as_of(asked, spans, ["k"], days=3)
        assert spread(cut) and sorted(map(tuple, cut.collect())) == rows
