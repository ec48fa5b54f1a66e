"""Values with the time that they hold for, and joins as of a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staged import Staging

#: Microseconds of a day.
DAY = 86_400_000_000
#: Pairs of rows and intervals of a key beyond which it is cut into buckets of time.
PAIRS = 10_000_000


def validity(history: DataFrame, key: Sequence[str], value: str, ts: str = "ts") -> DataFrame:
    """(key, value, since, until): each value from the time it came until another one came, which is not included; null until is still open.

    Values that repeat the one before go on; of several at one time the largest counts. Rows with a null time or value say nothing.
    """
    key = list(key)
    each = history.where(F.col(value).isNotNull() & F.col(ts).isNotNull()).groupBy(*key, ts).agg(F.max(value).alias(value))
    w = Window.partitionBy(*key).orderBy(ts)
    starts = each.withColumn("_before", F.lag(value).over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col(value)))
    return starts.select(*key, value, F.col(ts).alias("since"), F.lead(ts).over(w).alias("until"))


def as_of(asked: DataFrame, intervals: DataFrame, on: Sequence[str], ts: str = "ts", days: int = 30) -> DataFrame:
    """The rows of asked (on, ts, ...) with what of intervals (on, since, until, ...) holds at that time; rows that nothing holds for go.

    Both sides meet by their key. Keys of more than PAIRS pairs of rows and intervals (few, if any) meet in buckets of time instead, so a key with a long history is many groups:
    there an interval stands in each bucket that it touches, an open one up to the last time that is asked for. Times are without a zone or with one on both sides.
    """
    on, spark = list(on), asked.sparkSession
    asked, intervals = Staging(spark, "asked").put(asked), Staging(spark, "intervals").put(intervals)
    counts = asked.groupBy(*on).agg(F.count("*").alias("_n")).join(intervals.groupBy(*on).agg(F.count("*").alias("_m")), on)
    long = Staging(spark, "long").put(counts.where(F.col("_n") * F.col("_m") > PAIRS).select(*on))
    holds = (F.col(ts) >= F.col("since")) & (F.col("until").isNull() | (F.col(ts) < F.col("until")))
    if not long.limit(1).count():
        return asked.join(intervals, on).where(holds)
    short = asked.join(long, on, "left_anti").join(intervals, on).where(holds)
    number = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (days * DAY)).cast("long")
    asked, intervals = asked.join(long, on, "left_semi"), intervals.join(long, on, "left_semi")
    last = asked.agg(F.max(number(ts)).alias("_last"))
    from_, to = number("since"), F.coalesce(F.least(number("until"), F.col("_last")), F.col("_last"))
    spread = intervals.join(F.broadcast(last)).where(from_ <= F.col("_last")).withColumn("_bucket", F.explode(F.sequence(from_, F.greatest(from_, to)))).drop("_last")  # one row
    met = asked.withColumn("_bucket", number(ts)).join(spread, [*on, "_bucket"])
    return short.unionByName(met.where(holds).drop("_bucket"))
