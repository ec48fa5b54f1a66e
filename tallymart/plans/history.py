"""Prices over time: change-only history, matrices carried forward, price positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.intervals import as_of, validity
from ..operators.tables import changes_only, numbered_within
from ..registry import query
from ..sources.views import Views

ORDER = ("ts", "shop_id", "order_id", "line")


def price_matrix(history: DataFrame, key: str, backfill: str | None = None) -> DataFrame:
    """For each event of an article a row for each of its shops with the shop's latest price, null before its first.

    history: (key, shop_id, ts, price). Instead of pairing events with shops and looking back, each shop's price is spread over
    the events between two of its own: rows are dealt by article once, and events meet the spans of prices there, so the grid is never moved. backfill "final"
    fills what is before a shop's first price with its last. A null time is behind all others.
    """
    each = history.where(F.col(key).isNotNull()).select(key, "ts", "shop_id", "price").repartition(key).groupBy(key, "ts", "shop_id").agg(F.max("price").alias("price"))
    shop = Window.partitionBy(key, "shop_id")
    at = each.withColumn("_at", F.when(F.col("price").isNotNull() & F.col("shop_id").isNotNull(), F.col("ts")))
    w = shop.orderBy(F.col("_at").asc_nulls_last())
    first = F.max_by("price", "_at").over(shop) if backfill == "final" else F.lit(None)
    placed = at.select(key, "shop_id", "price", "_at", F.lead("_at").over(w).alias("_next"), F.row_number().over(w).alias("_n"), first.cast(dict(each.dtypes)["price"]).alias("_first"))
    span = lambda since, until, price: F.struct(since.alias("_since"), until.alias("_until"), price.alias("last_price"))
    own = F.when(F.col("_at").isNotNull(), span(F.col("_at"), F.col("_next"), F.col("price")))
    before = F.when(F.col("_n") == 1, span(F.lit(None).cast(dict(each.dtypes)["ts"]), F.col("_at"), F.col("_first")))
    spans = placed.select(key, "shop_id", F.inline(F.filter(F.array(before, own), lambda x: x.isNotNull())))
    holds = F.col("_until").isNull() | ((F.col("_since").isNull() | (F.col("ts") >= F.col("_since"))) & (F.col("ts") < F.col("_until")))
    late = F.col("_until").isNotNull() | F.col("_since").isNull() | F.col("ts").isNull() | (F.col("ts") >= F.col("_since"))
    return each.select(key, "ts").distinct().join(spans, key).where(F.coalesce(holds, F.lit(False)) & late).select(key, "ts", "shop_id", "last_price")


@query("""WITH h AS (SELECT article_id, ts, shop_id, max(price) AS price FROM usable GROUP BY 1, 2, 3),
    g AS (SELECT d.article_id, d.ts, s.shop_id FROM (SELECT DISTINCT article_id, ts FROM h) d JOIN (SELECT DISTINCT article_id, shop_id FROM h) s ON d.article_id = s.article_id)
    SELECT g.article_id, CAST(g.ts AS DATE) AS day, g.shop_id, last_value(h.price IGNORE NULLS) OVER (PARTITION BY g.article_id, g.shop_id ORDER BY g.ts ROWS UNBOUNDED PRECEDING) AS last_price
    FROM g LEFT JOIN h ON h.article_id = g.article_id AND h.ts = g.ts AND h.shop_id = g.shop_id""")
def price_matrix_locf(v: Views) -> DataFrame:
    return price_matrix(v.usable, "article_id").select("article_id", F.col("ts").cast("date").alias("day"), "shop_id", "last_price")


CHANGES_SQL = """SELECT article_id, CAST(ts AS DATE) AS day, shop_id, order_id, line, step FROM (SELECT *, lag(step) OVER (PARTITION BY article_id ORDER BY ts, shop_id, order_id, line) AS before
    FROM (SELECT *, price // 1000 AS step FROM offer WHERE price > 0)) WHERE step IS DISTINCT FROM before"""


@query(CHANGES_SQL)
def price_changes(v: Views) -> DataFrame:
    """Change-only history of prices in steps of a thousand."""
    steps = v.offer.where("price > 0").withColumn("step", F.floor(F.col("price") / 1000).cast("long"))
    return changes_only(steps, "article_id", ORDER, "step").select("article_id", F.col("ts").cast("date").alias("day"), "shop_id", "order_id", "line", "step")


@query(f"WITH c AS ({CHANGES_SQL}) SELECT article_id, day, shop_id, order_id, line, step, before FROM (SELECT *, lag(step) OVER (PARTITION BY article_id ORDER BY day, shop_id, order_id, line) AS before FROM c) WHERE step < before")
def price_drops(v: Views) -> DataFrame:
    changes = price_changes(v)
    w = Window.partitionBy("article_id").orderBy("day", "shop_id", "order_id", "line")
    return changes.withColumn("before", F.lag("step").over(w)).where("step < before")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE event_type IS DISTINCT FROM before")
def event_changes(v: Views) -> DataFrame:
    return changes_only(v.table("events"), "user_id", ("ts", "event_id"), "event_type").select("user_id", "event_id", "event_type")


def positions(offers: DataFrame) -> DataFrame:
    """(article_id, shop_id, price, position, sellers): each shop's best price of an article, ranked; equals by shop id."""
    best = offers.groupBy("article_id", "shop_id").agg(F.min("price").alias("price"))
    w = Window.partitionBy("article_id")
    ranked = best.withColumn("position", F.row_number().over(w.orderBy("price", "shop_id")).cast("long"))
    return ranked.withColumn("sellers", F.count("*").over(w))


POSITION_SQL = """SELECT article_id, shop_id, price, row_number() OVER (PARTITION BY article_id ORDER BY price, shop_id) AS position, count(*) OVER (PARTITION BY article_id) AS sellers
    FROM (SELECT article_id, shop_id, min(price) AS price FROM usable GROUP BY 1, 2)"""


@query(POSITION_SQL)
def price_position(v: Views) -> DataFrame:
    return positions(v.usable)


@query(f"""SELECT shop_id, count(*) AS articles, count(*) FILTER (sellers = 1) AS only_seller, count(*) FILTER (sellers > 1 AND position = 1) AS cheapest,
    count(*) FILTER (sellers > 1 AND position = 2) AS second, count(*) FILTER (sellers > 1 AND position = 3) AS third, count(*) FILTER (sellers > 1 AND position = sellers) AS dearest FROM ({POSITION_SQL}) GROUP BY 1""")
def shop_standing(v: Views) -> DataFrame:
    several = F.col("sellers") > 1
    at = lambda k: F.count_if(several & (F.col("position") == k))
    return positions(v.usable).groupBy("shop_id").agg(
        F.count("*").alias("articles"), F.count_if(F.col("sellers") == 1).alias("only_seller"), at(1).alias("cheapest"), at(2).alias("second"), at(3).alias("third"), at(F.col("sellers")).alias("dearest")
    )


@query(f"""WITH p AS ({POSITION_SQL}), c AS (SELECT sellers, position, count(*) AS n FROM p WHERE shop_id = 5 GROUP BY 1, 2)
    SELECT sellers, position, n, CAST(sum(n) OVER (ORDER BY sellers, position) AS BIGINT) AS so_far, CAST((SELECT sum(n) FROM c) AS BIGINT) - CAST(sum(n) OVER (ORDER BY sellers, position) AS BIGINT) AS left_over,
    round(100.0 * n / (SELECT sum(n) FROM c), 4) AS share FROM c""")
def position_report(v: Views) -> DataFrame:
    """Counts of one shop by number of sellers and position, with running totals; a few hundred groups are ordered."""
    counts = positions(v.usable).where("shop_id = 5").groupBy("sellers", "position").agg(F.count("*").alias("n"))
    w, all_rows = Window.orderBy("sellers", "position"), Window.partitionBy()
    out = counts.withColumn("so_far", F.sum("n").over(w)).withColumn("total", F.sum("n").over(all_rows))
    return out.select("sellers", "position", "n", "so_far", (F.col("total") - F.col("so_far")).alias("left_over"), F.round(100.0 * F.col("n") / F.col("total"), 4).alias("share"))


@query("SELECT order_id, line, article_id, shop_id, count(*) OVER (PARTITION BY article_id) AS rivals FROM offer")
def w03_rivals(v: Views) -> DataFrame:
    return v.offer.withColumn("rivals", F.count("*").over(Window.partitionBy("article_id"))).select("order_id", "line", "article_id", "shop_id", "rivals")


@query("SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS id FROM events")
def w09_next_id(v: Views) -> DataFrame:
    """Sequence numbers per kind; the few kinds are numbered by ranges of time, so that no task holds a whole kind."""
    rows = v.table("events").withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
    return numbered_within(rows, "event_type", "_at", "ts", "event_id").select("event_id", "user_id", "event_type", "id")


@query("SELECT shop_id, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n, min(price) AS lowest, max(price) AS highest FROM usable GROUP BY 1, 2")
def monthly_prices(v: Views) -> DataFrame:
    return v.usable.groupBy("shop_id", F.trunc("ts", "month").alias("month")).agg(F.count("*").alias("n"), F.min("price").alias("lowest"), F.max("price").alias("highest"))


@query("SELECT event_type, user_id, CAST(ts AS DATE) AS day, count(*) AS views FROM events WHERE user_id NOT IN (3, 7, 11) GROUP BY 1, 2, 3")
def daily_view_counts(v: Views) -> DataFrame:
    rows = v.table("events").where(~F.col("user_id").isin(3, 7, 11))
    return rows.groupBy("event_type", "user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("views"))


@query("""SELECT user_id, month, event_type, used, CASE event_type WHEN 'view' THEN used < 15 WHEN 'click' THEN used <= 12 ELSE TRUE END AS allowed
    FROM (SELECT user_id, CAST(date_trunc('month', ts) AS DATE) AS month, event_type, count(*) AS used FROM events GROUP BY 1, 2, 3)""")
def quota_usage(v: Views) -> DataFrame:
    """Uses of a member in a month against the plan: searches must stay below, lists may reach it, others are free."""
    used = v.table("events").groupBy("user_id", F.trunc("ts", "month").alias("month"), "event_type").agg(F.count("*").alias("used"))
    return used.withColumn("allowed", F.when(F.col("event_type") == "view", F.col("used") < 15).when(F.col("event_type") == "click", F.col("used") <= 12).otherwise(True))


@query("""SELECT CAST(m AS DATE) AS month, CAST(m + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS last_day, CAST(m + INTERVAL 1 MONTH AS DATE) <= DATE '1999-01-01' AS closed
    FROM (SELECT unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS m FROM (SELECT CAST(min(ts) AS TIMESTAMP) AS lo, CAST(max(ts) AS TIMESTAMP) AS hi FROM offer))""")
def t07_periods(v: Views) -> DataFrame:
    """A period for each month, closed once it has ended."""
    span = v.offer.agg(F.trunc(F.min("ts"), "month").alias("lo"), F.trunc(F.max("ts"), "month").alias("hi"))
    months = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"))
    return months.select("month", F.last_day("month").alias("last_day"), (F.add_months("month", 1) <= F.lit("1999-01-01").cast("date")).alias("closed"))


@query("SELECT user_id, CAST(max(ts) AS DATE) AS day, max(ts) + INTERVAL 1 HOUR < TIMESTAMP '2024-01-20' AS expired FROM events WHERE event_type = 'error' GROUP BY 1")
def t08_expiring_blocks(v: Views) -> DataFrame:
    """A block lasts an hour from the last offence."""
    last = v.table("events").where("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("ts"))
    return last.select("user_id", F.col("ts").cast("date").alias("day"), (F.col("ts") + F.expr("interval 1 hour") < F.lit("2024-01-20").cast("timestamp_ntz")).alias("expired"))


_SPANS = """SELECT article_id, shop_id, price, ts AS since, lead(ts) OVER (PARTITION BY article_id, shop_id ORDER BY ts) AS until FROM (SELECT *, lag(price) OVER (PARTITION BY article_id, shop_id ORDER BY ts) AS before
    FROM (SELECT article_id, shop_id, ts, max(price) AS price FROM usable GROUP BY 1, 2, 3)) WHERE price IS DISTINCT FROM before"""


@query(f"SELECT article_id, shop_id, price, CAST(since AS DATE) AS since, CAST(until AS DATE) AS until FROM ({_SPANS})")
def t02_price_intervals(v: Views) -> DataFrame:
    """From when until when each price of a shop holds."""
    spans = validity(v.usable, ("article_id", "shop_id"), "price")
    return spans.select("article_id", "shop_id", "price", F.col("since").cast("date").alias("since"), F.col("until").cast("date").alias("until"))


@query(f"SELECT m.article_id, CAST(m.ts AS DATE) AS day, x.shop_id, x.price FROM (SELECT DISTINCT article_id, date_trunc('month', ts) AS ts FROM usable) m JOIN ({_SPANS}) x ON x.article_id = m.article_id AND x.since <= m.ts AND (x.until IS NULL OR m.ts < x.until)")
def w04_prices_as_of(v: Views) -> DataFrame:
    """The price of each shop at the beginning of each month in which an article had offers: intervals and times meet in buckets, without a grid of events and shops."""
    months = v.usable.select("article_id", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("ts")).distinct()
    found = as_of(months, validity(v.usable, ("article_id", "shop_id"), "price"), ["article_id"])
    return found.select("article_id", F.col("ts").cast("date").alias("day"), "shop_id", "price")
