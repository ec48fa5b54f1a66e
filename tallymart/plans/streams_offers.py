"""Price changes of offers as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.views import Views
from ..streaming.changes import streamed_changes
from ..streaming.run import drained
from .history import CHANGES_SQL
from .streams import folder, table_stream


@query(CHANGES_SQL)
def stream_price_changes(v: Views) -> DataFrame:
    """The change-only history of prices in steps of a thousand, with the last step of each article as state."""
    price = F.when(F.col("l_tax") == 0, 0).otherwise(F.round(F.col("l_extendedprice") / F.col("l_quantity")).cast("long"))
    offers = table_stream(v, "lineitem").select(
        F.col("l_partkey").alias("article_id"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_suppkey").alias("shop_id"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line"), price.alias("price")
    )
    steps = offers.where("price > 0").withColumn("step", F.floor(F.col("price") / 1000).cast("long"))
    out = drained(streamed_changes(steps, "article_id", ("ts", "shop_id", "order_id", "line"), "step"), folder(v))
    return out.select("article_id", F.col("ts").cast("date").alias("day"), "shop_id", "order_id", "line", "step")
