"""Change-only history as a stream: the last value of each key is state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: Groups of keys; each is one call of Python and one row of state, so calls don't grow with the keys.
BUCKETS = 16_384


def streamed_changes(events: DataFrame, key: str, order: tuple[str, ...], value: str) -> DataFrame:
    """(key, order columns, value) where the value differs from the key's last. Rows of a micro-batch are ordered within it; append mode.

    A null is a value like others, except that a key begins with none: a leading null is no change. Keys are dealt to BUCKETS groups by hash; state is one value a key,
    in a list for each group, and the checkpoint of the query recovers it. A task holds the rows of one group of one micro-batch, which the source's limits on a micro-batch bound.
    """
    columns = list(dict.fromkeys([key, *order, value]))
    types = dict(events.dtypes)
    whole = [c for c in columns if types[c] in ("tinyint", "smallint", "int", "bigint")]  # pandas would make fractions of whole numbers beside nulls
    sent = [F.coalesce(c, F.lit(0).cast(types[c])).alias(c) if c in whole else F.col(c) for c in columns] + [F.col(c).isNull().alias(f"_no_{c}") for c in whole]
    schema = ", ".join([f"`{c}` {types[c]}" for c in columns] + [f"`_no_{c}` boolean" for c in whole])

    def objects(rows: pd.DataFrame, c: str) -> np.ndarray:
        out = rows[c].astype(object).to_numpy(copy=True)
        out[rows[f"_no_{c}"].to_numpy(bool) if c in whole else pd.isna(rows[c]).to_numpy()] = None
        return out

    def update(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        if not len(rows):
            return
        known = dict(zip(*state.get)) if state.exists else {}
        rows["_key"] = pd.factorize(objects(rows, key), use_na_sentinel=False)[0]
        rows = rows.sort_values(["_key", *[x for c in order for x in ([f"_no_{c}", c] if c in whole else [c])]], kind="stable")
        keys, values, code = objects(rows, key), objects(rows, value), rows["_key"].to_numpy()
        first = np.r_[True, code[1:] != code[:-1]]
        before = np.r_[[None], values[:-1]]
        before[first] = [known.get(k) for k in keys[first]]
        new = np.array([(v is not None if b is None else v is None or v != b) for b, v in zip(before, values)], bool)
        last = np.r_[first[1:], True]
        known.update(zip(keys[last], values[last]))
        state.update((list(known), list(known.values())))
        yield rows.loc[new, [f.split("`")[1] for f in schema.split(", ")]]

    dealt = events.select(*sent, F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_bucket"))
    changed = dealt.groupBy("_bucket").applyInPandasWithState(update, schema, f"keys array<{types[key]}>, lasts array<{types[value]}>", "append", GroupStateTimeout.NoTimeout)
    return changed.select([F.when(~F.col(f"_no_{c}"), F.col(c)).alias(c) if c in whole else F.col(c) for c in columns])


def daily_counts(events: DataFrame, keys: tuple[str, ...], late: str = "1 day", ts: str = "ts") -> DataFrame:
    """Counts by key and day; a day is final once the watermark has passed it. ts may be without a zone."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    counted = timed.groupBy(F.window("_ts", "1 day"), *keys).agg(F.count("*").alias("views"))
    return counted.select(*keys, F.col("window.start").cast("date").alias("day"), "views")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Runs of events of a key without a longer pause."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    counted = timed.groupBy(F.session_window("_ts", gap), key).agg(F.count("*").alias("events"))
    return counted.select(key, F.col("session_window.start").alias("began"), F.col("session_window.end").alias("ended"), "events")
