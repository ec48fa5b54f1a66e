"""Timers and keyed state over several micro-batches, against plain versions."""

import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tallymart.streaming.keyed import _period_end, monthly_quotas, once_each, rocks_state, timed_blocks

T0 = datetime.datetime(2024, 1, 30)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def run_in_batches(spark, tmp_path, batches, schema, make, restart_each=True):
    """The rows of a stream over files that come one after another; each batch is a run of its own that recovers the state of the last."""
    source, out, name = str(tmp_path / uuid.uuid4().hex), str(tmp_path / "out"), str(tmp_path / "check")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        with rocks_state(spark):
            stream = make(spark.readStream.schema(schema).parquet(source))
            stream.writeStream.format("parquet").option("checkpointLocation", name).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def test_blocks_end_by_timers(spark, tmp_path):
    schema = "ip string, ts timestamp"
    batches = [
        [("a", at(0)), ("a", at(10)), ("b", at(5)), (None, at(1)), ("a", None)],
        [("a", at(3599)), ("c", at(3000))],
        [("a", at(3600)), ("c", at(9000))],  # a's first block is over at 3600 sharp; the watermark passes b's and c's ends after this batch
        [("b", at(9100)), ("d", at(20_000))],
        [("d", at(20_001)), ("c", at(1))],  # late, behind the watermark
    ]
    found = run_in_batches(spark, tmp_path, batches, schema, lambda s: timed_blocks(s, "ip", 3600, "0 seconds"))
    rows = sorted((r["ip"], (r["began"] - T0).total_seconds(), (r["ended"] - T0).total_seconds(), r["offences"]) for r in found.collect())
    assert rows == [("a", 0.0, 3600.0, 3), ("a", 3600.0, 7200.0, 1), ("b", 5.0, 3605.0, 1), ("b", 9100.0, 12700.0, 1), ("c", 3000.0, 6600.0, 1), ("c", 9000.0, 12600.0, 1)]


def test_quotas_roll_over(spark, tmp_path):
    rng = random.Random(4)
    uses = sorted((rng.choice("xyz"), at(k * 7000 + rng.randint(0, 50)), k, rng.choice(("view", "click", "free"))) for k in range(60))
    uses.sort(key=lambda r: r[1])
    batches = [uses[k : k + 15] for k in range(0, 60, 15)]
    found = run_in_batches(spark, tmp_path, batches, "member string, ts timestamp, id long, kind string", lambda s: monthly_quotas(s, "member", "id", "kind", {"view": 3, "click": 0}, "0 seconds"))
    used, expected = {}, []
    for member, ts, i, kind in uses:
        slot = (member, ts.year, ts.month, kind)
        may = used.get(slot, 0) < {"view": 3, "click": 0}.get(kind, 1 << 60)
        used[slot] = used.get(slot, 0) + may
        expected.append((member, i, kind, may, used[slot]))
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert len({(ts.year, ts.month) for _, ts, _, _ in uses}) == 2 and not all(e[3] for e in expected)


def test_once_within_the_watermark(spark, tmp_path):
    batches = [[("a", at(0)), ("a", at(1)), ("b", at(2))], [("a", at(30)), ("z", at(500))], [("z", at(520))], [("a", at(530))]]
    found = run_in_batches(spark, tmp_path, batches, "ip string, ts timestamp", lambda s: once_each(s, ["ip"], "100 seconds"))
    assert sorted(r["ip"] for r in found.collect()) == ["a", "a", "b", "z"]  # a comes again once its first report is out of the watermark


def test_provider_is_put_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with pytest.raises(ValueError), rocks_state(spark):
        raise ValueError
    assert spark.conf.get(key, None) == before


def test_period_end(spark):
    (r,) = spark.sql("SELECT timestamp'2023-12-31 23:59:59' AS t").select((F.year("t") * 12 + F.month("t") - 1).alias("p"), F.unix_millis(F.lit("2024-01-01").cast("timestamp")).alias("e")).collect()
    assert _period_end(r["p"]) == r["e"]
