"""Changes as a stream: calls of Python are bounded, whatever the number of keys."""

import time

from tallymart.streaming import changes
from tallymart.streaming.run import drained


def test_keys_share_calls_and_whole_numbers_stay_whole(spark, tmp_path, monkeypatch):
    """Two micro-batches; a null beside large numbers of other keys, a null key, and a state that goes on."""
    monkeypatch.setattr(changes, "BUCKETS", 2)
    big = 2**60
    one = [(1, 1, big), (1, 2, big), (1, 3, big + 1), (2, 1, None), (2, 2, 5), (None, 1, 7), (3, None, big + 3)]
    two = [(1, 4, big + 1), (1, 5, None), (2, 3, 5), (None, 2, 7), (None, 3, 8), (4, 1, big + 5)]
    for rows in (one, two):
        spark.createDataFrame(rows, "k long, t long, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their seconds
    stream = spark.readStream.schema("k long, t long, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = changes.streamed_changes(stream, "k", ("t",), "v")
    assert "_bucket" in found._jdf.queryExecution().analyzed().toString()
    expected = [(1, 1, big), (1, 3, big + 1), (2, 2, 5), (None, 1, 7), (3, None, big + 3), (1, 5, None), (None, 3, 8), (4, 1, big + 5)]
    assert sorted(map(tuple, drained(found, str(tmp_path / "out")).collect()), key=str) == sorted(expected, key=str)
