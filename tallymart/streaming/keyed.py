"""Keyed state with event-time timers: blocks that expire, and quotas that roll over. State lives in RocksDB and is recovered from the query's checkpoint.

Rows of a key are taken in order of time within a micro-batch; rows behind the watermark are dropped, as late ones are everywhere in a stream. A key's rows of one
micro-batch are read batch by batch, and its state is a few numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession):
    """State stores that hold timers and several variables, for queries started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _ordered(rows: Iterator[pd.DataFrame], *columns: str) -> pd.DataFrame:
    held = [r for r in rows if len(r)]
    return pd.concat(held).sort_values(list(columns), kind="stable") if held else pd.DataFrame(columns=list(columns))


class Blocks(StatefulProcessor):
    """A block begins with an offence while there is none, lasts `seconds`, and counts the offences in it; a timer ends it."""

    def __init__(self, key: str, seconds: int):
        self.key, self.micros = key, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.began = handle.getValueState("began", "micros long")
        self.offences = handle.getValueState("offences", "n long")

    def _ended(self, key, began: int, offences: int) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "began_us": [began], "ended_us": [began + self.micros], "offences": [offences]})

    def _timer(self, began: int) -> int:
        return -(-(began + self.micros) // 1000)  # timers count milliseconds

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        began = self.began.get()[0] if self.began.exists() else None
        offences = self.offences.get()[0] if self.offences.exists() else 0
        for at in _ordered(rows, "us")["us"].tolist():
            if began is not None and at < began + self.micros:
                offences += 1
                continue
            if began is not None:  # over before the watermark says so, as a later offence is here
                self.handle.deleteTimer(self._timer(began))
                yield self._ended(key, began, offences)
            began, offences = at, 1
            self.handle.registerTimer(self._timer(began))
        if began is not None:
            self.began.update((began,))
            self.offences.update((offences,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.began.exists():
            began, offences = self.began.get()[0], self.offences.get()[0]
            if self._timer(began) <= expiredTimerInfo.getExpiryTimeInMs():
                self.began.clear()
                self.offences.clear()
                yield self._ended(key, began, offences)

    def close(self) -> None:
        pass


class Quotas(StatefulProcessor):
    """Uses of each kind in each period; one beyond the quota of its kind is denied and not counted. A timer drops a period once it has ended."""

    def __init__(self, key: str, quotas: dict[str, int]):
        self.key, self.quotas = key, quotas

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getMapState("used", "period long, kind string", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = _ordered(rows, "us", "id")
        allowed, used, seen = [], [], {}
        for period, ends, kind in zip(rows["period"].tolist(), rows["ends_ms"].tolist(), rows["kind"].tolist()):
            at = (int(period), kind)
            if at not in seen:
                seen[at] = self.used.getValue(at)[0] if self.used.containsKey(at) else 0
                self.handle.registerTimer(int(ends))
            may = kind not in self.quotas or seen[at] < self.quotas[kind]
            seen[at] += may
            allowed.append(may)
            used.append(seen[at])
        for at, n in seen.items():
            self.used.updateValue(at, (n,))
        if len(rows):
            yield pd.DataFrame({self.key: [key[0]] * len(rows), "id": rows["id"].tolist(), "kind": rows["kind"].tolist(), "allowed": allowed, "used": used})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ended = expiredTimerInfo.getExpiryTimeInMs()
        for period, kind in [tuple(k) for k in self.used.keys()]:
            if _period_end(period) <= ended:
                self.used.removeKey((period, kind))
        return iter(())

    def close(self) -> None:
        pass


def _period_end(period: int) -> int:
    """The end of month number `period` (year * 12 + month - 1) in milliseconds, UTC."""
    year, month = divmod(period + 1, 12)
    return int(pd.Timestamp(year=year, month=month + 1, day=1, tz="UTC").timestamp() * 1000)


def timed_blocks(offences: DataFrame, key: str, seconds: int = 3600, late: str = "1 minute", ts: str = "ts") -> DataFrame:
    """(key, began, ended, offences) of blocks that are over: the watermark has passed their end, or a later offence of the key has come. Start it inside rocks_state().

    Offences with a null key or time are ignored. ts may be without a zone, which counts as UTC.
    """
    rows = offences.select(F.col(key), F.col(ts).cast("timestamp").alias("_ts")).dropna().withWatermark("_ts", late).select(key, "_ts", F.unix_micros("_ts").alias("us"))
    kind = dict(offences.dtypes)[key]
    out = rows.groupBy(key).transformWithStateInPandas(Blocks(key, seconds), f"`{key}` {kind}, began_us long, ended_us long, offences long", "append", "eventTime")
    return out.select(key, F.timestamp_micros("began_us").alias("began"), F.timestamp_micros("ended_us").alias("ended"), "offences")


def monthly_quotas(uses: DataFrame, key: str, id_col: str, kind_col: str, quotas: dict[str, int], late: str = "1 day", ts: str = "ts") -> DataFrame:
    """(key, id, kind, allowed, used) of each use: allowed while the month's uses of the kind are below its quota; kinds without one always. Start it inside rocks_state().

    Uses with a null key, time, id or kind are ignored; ties in time are taken by id. Months are those of UTC.
    """
    at = F.col("_ts")
    rows = uses.select(F.col(key), F.col(ts).cast("timestamp").alias("_ts"), F.col(id_col).cast("long").alias("id"), F.col(kind_col).alias("kind")).dropna().withWatermark("_ts", late)
    period = (F.year(at) * 12 + F.month(at) - 1).cast("long")
    ends = F.unix_millis(F.add_months(F.trunc(at, "month"), 1).cast("timestamp"))
    rows = rows.select(key, "_ts", F.unix_micros("_ts").alias("us"), "id", "kind", period.alias("period"), ends.alias("ends_ms"))
    types = dict(uses.dtypes)
    return rows.groupBy(key).transformWithStateInPandas(Quotas(key, quotas), f"`{key}` {types[key]}, id long, kind {types[kind_col]}, allowed boolean, used long", "append", "eventTime")


def once_each(rows: DataFrame, keys: list[str], within: str = "1 hour", ts: str = "ts") -> DataFrame:
    """The first row of each key that comes; further ones go until the watermark, which is `within` behind, has passed it."""
    timed = rows.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", within)
    return timed.dropDuplicatesWithinWatermark(keys).drop("_ts")
