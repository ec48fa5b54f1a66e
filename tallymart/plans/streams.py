"""Streams drained over the events on hand, which must equal their batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..session import shared_folder
from ..sources.views import Views
from ..streaming.changes import daily_counts, streamed_changes
from ..streaming.run import drained


def folder(v: Views) -> str:
    """Where streams of the session write."""
    return f"{shared_folder(v.spark)}/streams"


def table_stream(v: Views, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is a folder or one file."""
    at = v.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{v.sf_dir}/{name}.parquet")
    is_folder = at.getFileSystem(v.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    return v.spark.readStream.schema(v.table(name).schema).parquet(f"{v.sf_dir}/{name}.parquet" + ("" if is_folder else "*"))


def event_stream(v: Views) -> DataFrame:
    return table_stream(v, "events")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE event_type IS DISTINCT FROM before")
def stream_event_changes(v: Views) -> DataFrame:
    return drained(streamed_changes(event_stream(v), "user_id", ("ts", "event_id"), "event_type"), folder(v)).select("user_id", "event_id", "event_type")


@query("SELECT event_type, user_id, CAST(ts AS DATE) AS day, count(*) AS views FROM events WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) - INTERVAL 1 DAY AS DATE) FROM events) GROUP BY 1, 2, 3")
def stream_daily_counts(v: Views) -> DataFrame:
    """Days that the watermark has passed."""
    return drained(daily_counts(event_stream(v), ("event_type", "user_id")), folder(v)).select("event_type", "user_id", "day", "views")
