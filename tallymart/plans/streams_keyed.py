"""Streams with timers and several state variables, which must equal their batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.views import Views
from ..streaming.keyed import monthly_quotas, once_each, rocks_state, timed_blocks
from ..streaming.run import drained
from .streams import event_stream, folder

#: Events that count as offences, how long they block, and the uses of a month that a plan allows. Not every user has as many, but some have more.
OFFENCES, BLOCK, QUOTAS = ("error",), 7 * 86_400, {"view": 3, "click": 2}


@query(f"""WITH RECURSIVE e AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS later FROM events WHERE event_type IN ('error') AND user_id IS NOT NULL AND ts IS NOT NULL),
    b AS (SELECT user_id, min(ts) AS began FROM e GROUP BY 1 UNION ALL SELECT b.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = b.user_id AND e.ts >= b.began + INTERVAL {BLOCK} SECOND) FROM b WHERE b.began IS NOT NULL),
    n AS (SELECT b.*, lead(began) OVER (PARTITION BY user_id ORDER BY began) AS following FROM b WHERE began IS NOT NULL)
    SELECT user_id, epoch_us(began) AS began, epoch_us(began + INTERVAL {BLOCK} SECOND) AS ended, (SELECT count(*) FROM e WHERE e.user_id = n.user_id AND e.ts >= began AND e.ts < began + INTERVAL {BLOCK} SECOND) AS offences
    FROM n WHERE following IS NOT NULL OR epoch_us(began + INTERVAL {BLOCK} SECOND) <= (SELECT max(epoch_us(ts)) - 60000000 FROM e)""")
def stream_blocks(v: Views) -> DataFrame:
    """Blocks of users that are over, each begun by an offence outside a block and ended by a timer."""
    offences = event_stream(v).where(F.col("event_type").isin(*OFFENCES))
    with rocks_state(v.spark):
        out = drained(timed_blocks(offences, "user_id", BLOCK), folder(v))
    return out.select("user_id", F.unix_micros("began").alias("began"), F.unix_micros("ended").alias("ended"), "offences")


@query("""SELECT user_id, event_id, event_type, CASE event_type WHEN 'view' THEN n <= 3 WHEN 'click' THEN n <= 2 ELSE TRUE END AS allowed, CASE event_type WHEN 'view' THEN least(n, 3) WHEN 'click' THEN least(n, 2) ELSE n END AS used
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('month', ts) ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL)""")
def stream_quotas(v: Views) -> DataFrame:
    """Each use of a member, allowed or denied by what its month had before it."""
    with rocks_state(v.spark):
        out = drained(monthly_quotas(event_stream(v), "user_id", "event_id", "event_type", QUOTAS), folder(v))
    return out.select("user_id", F.col("id").alias("event_id"), F.col("kind").alias("event_type"), "allowed", "used")


@query("SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('error', 'click') AND user_id IS NOT NULL")
def stream_abusers_once(v: Views) -> DataFrame:
    """Who offends and how, reported once within the watermark; a stream that is drained at once reports each once."""
    rows = event_stream(v).where(F.col("event_type").isin("error", "click") & F.col("user_id").isNotNull())
    return drained(once_each(rows, ["user_id", "event_type"]), folder(v)).select("user_id", "event_type")
