"""Operational reports: freshness, status and cost of shops, coverage, work allocation, access logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import any_of
from ..registry import query
from ..sources.views import Views

AS_OF = "2000-01-01"

#: The age buckets in days, from (inclusive) and to (exclusive).
AGES = ((0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (8, 10), (10, 15), (15, None))

#: What is searched for in the lines of requests.
ABUSE_TERMS = (
    ".php", "phpunit", "login.asp", "/.env", "/aaa9", "/aab8", "/boaform/admin/formLogin", "\\x16\\", "ReportServer", "xA7M|\\xB1", "/admin---NO", "/wp-admin", "/phpmyadmin", "/db", "/database", "/config",
    ".env", ".git", "/phpunit", "/cgi-bin", "/etc/passwd", "/wp-config", "/..", "/../../", ".bak", ".swp", ".sql", "/xss", "/sql-injection", "/csrf", "/kali", "/metasploit",
)


def freshness(offers: DataFrame, as_of: str = AS_OF, inclusive: bool = False) -> DataFrame:
    """Offers of each shop by age in days, and of all shops (shop_id null). inclusive: both ends of a bucket count, so borders count twice."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("ts"))

    def inside(low, high):
        above = age >= low
        return above if high is None else above & ((age <= high) if inclusive else (age < high))

    buckets = [F.count_if(inside(low, high)).alias(f"from_{low}") for low, high in AGES]
    return offers.rollup("shop_id").agg(*buckets, F.count("*").alias("total"))


_AGE = f"date_diff('day', CAST(ts AS DATE), DATE '{AS_OF}')"
_AGES_SQL = ", ".join(f"count(*) FILTER ({_AGE} >= {a}" + (f" AND {_AGE} < {b}" if b else "") + f") AS from_{a}" for a, b in AGES)


@query(f"SELECT shop_id, {_AGES_SQL}, count(*) AS total FROM offer WHERE ts < TIMESTAMP '{AS_OF}' GROUP BY ROLLUP (shop_id)")
def freshness_histogram(v: Views) -> DataFrame:
    return freshness(v.offer.where(F.col("ts") < F.lit(AS_OF).cast("timestamp_ntz")))


#: Hours that a shop and a delivery area take to set up, and what an hour costs.
SITE_HOURS, AREA_HOURS, HOUR = 4.0, 0.25, 20.0
STALE_DAYS = 365


def status(offers: DataFrame, shops: DataFrame, areas: DataFrame, rate: float = 0.02, as_of: str = AS_OF) -> DataFrame:
    """One row a shop, those without offers included, and one in all: counts of offers and places, shares with a guarded denominator, and cost of fetching and of setting up."""
    usable = ~F.col("error404") & (F.col("price") > 0)
    old = F.datediff(F.lit(as_of).cast("date"), F.col("ts")) >= STALE_DAYS
    c = offers.rollup("shop_id").agg(
        F.count("*").alias("offers"), F.count_if("error404").alias("missing"), F.count_if(F.col("price") == 0).alias("unpriced"), F.count_if(usable).alias("usable"), F.count_if(usable & old).alias("stale"),
        F.count_distinct("article_id").alias("articles"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("mean_seconds"),
    ).withColumnRenamed("shop_id", "_shop")
    places = areas.rollup("shop_id").agg(F.count("*").alias("areas"), F.count_distinct("district_id").alias("districts")).withColumnRenamed("shop_id", "_place")
    total = shops.agg(F.count("*").alias("shops")).select(F.lit(None).cast("long").alias("shop_id"), F.lit("total").alias("name"), F.lit(True).alias("enabled"), "shops")
    names = shops.select("shop_id", "name", "enabled", F.lit(1).cast("long").alias("shops")).unionByName(total)
    rows = names.join(c, F.col("shop_id").eqNullSafe(F.col("_shop")), "left").join(places, F.col("shop_id").eqNullSafe(F.col("_place")), "left")
    whole = F.when(F.coalesce("offers", F.lit(0)) == 0, 1).otherwise(F.col("offers"))
    number = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n)
    share = lambda n: F.round(100.0 * F.coalesce(F.col(n), F.lit(0)) / whole, 4).alias(f"{n}_share")
    hours = F.coalesce("seconds", F.lit(0)) / 3600.0
    site, area = F.col("shops") * SITE_HOURS * HOUR, F.coalesce("areas", F.lit(0)) * AREA_HOURS * HOUR
    return rows.select(
        "shop_id", "name", "enabled", "shops", *map(number, ("offers", "missing", "unpriced", "usable", "stale", "articles", "seconds", "areas", "districts")), *map(share, ("usable", "missing", "unpriced", "stale", "articles")),
        F.round(F.coalesce("mean_seconds", F.lit(0.0)), 4).alias("mean_seconds"), F.round(hours, 4).alias("hours"), F.round(hours * 30 * rate, 4).alias("cost_a_month"), site.alias("site_cost"), area.alias("area_cost"), (site + area).alias("start_cost"),
    )


_SHARES = ", ".join(f"round(100.0::DOUBLE * coalesce({n}, 0) / CASE WHEN coalesce(offers, 0) = 0 THEN 1 ELSE offers END, 4) AS {a}_share" for n, a in (("usable_n", "usable"), ("missing", "missing"), ("unpriced", "unpriced"), ("stale", "stale"), ("articles", "articles")))


@query(f"""WITH c AS (SELECT shop_id, count(*) AS offers, count(*) FILTER (error404) AS missing, count(*) FILTER (price = 0) AS unpriced, count(*) FILTER (NOT error404 AND price > 0) AS usable_n,
        count(*) FILTER (NOT error404 AND price > 0 AND {_AGE} >= {STALE_DAYS}) AS stale, count(DISTINCT article_id) AS articles, CAST(sum(seconds) AS BIGINT) AS seconds, avg(seconds) AS mean_seconds FROM offer GROUP BY ROLLUP (shop_id)),
    p AS (SELECT shop_id, count(*) AS areas, count(DISTINCT district_id) AS districts FROM delivery_area GROUP BY ROLLUP (shop_id)),
    n AS (SELECT shop_id, name, enabled, 1 AS shops FROM shop UNION ALL SELECT NULL, 'total', TRUE, count(*) FROM shop)
    SELECT n.shop_id, n.name, n.enabled, CAST(n.shops AS BIGINT) AS shops, coalesce(offers, 0) AS offers, coalesce(missing, 0) AS missing, coalesce(unpriced, 0) AS unpriced, coalesce(usable_n, 0) AS usable, coalesce(stale, 0) AS stale, coalesce(articles, 0) AS articles,
    coalesce(seconds, 0) AS seconds, coalesce(areas, 0) AS areas, coalesce(districts, 0) AS districts, {_SHARES}, round(coalesce(mean_seconds, 0), 4) AS mean_seconds, round(coalesce(seconds, 0) / 3600.0::DOUBLE, 4) AS hours,
    round(coalesce(seconds, 0) / 3600.0::DOUBLE * 30 * 0.02::DOUBLE, 4) AS cost_a_month, n.shops * {SITE_HOURS * HOUR}::DOUBLE AS site_cost, coalesce(areas, 0) * {AREA_HOURS * HOUR}::DOUBLE AS area_cost,
    n.shops * {SITE_HOURS * HOUR}::DOUBLE + coalesce(areas, 0) * {AREA_HOURS * HOUR}::DOUBLE AS start_cost FROM n LEFT JOIN c ON n.shop_id IS NOT DISTINCT FROM c.shop_id LEFT JOIN p ON n.shop_id IS NOT DISTINCT FROM p.shop_id""")
def shop_status(v: Views) -> DataFrame:
    return status(v.offer, v.shop, v.delivery_area)


@query("""SELECT z.region_id, z.name AS region, d.district_id, d.name AS district, count(DISTINCT a.shop_id) AS shops, string_agg(s.name, ', ' ORDER BY s.name) AS names, min(a.fee) AS lowest_fee, max(a.fee) AS highest_fee, count(a.shop_id) > 3 AS covered
    FROM zone z JOIN district d ON d.region_id = z.region_id LEFT JOIN (SELECT a.* FROM delivery_area a JOIN shop s ON s.shop_id = a.shop_id WHERE s.enabled) a ON a.district_id = d.district_id LEFT JOIN shop s ON s.shop_id = a.shop_id GROUP BY 1, 2, 3, 4""")
def coverage_by_district(v: Views) -> DataFrame:
    """Regions, their districts and the enabled shops that deliver there, districts without any included."""
    areas = v.delivery_area.join(v.shop.where("enabled").select("shop_id", F.col("name").alias("shop")), "shop_id")
    rows = v.zone.withColumnRenamed("name", "region").join(v.district.withColumnRenamed("name", "district"), "region_id").join(areas, "district_id", "left")
    return rows.groupBy("region_id", "region", "district_id", "district").agg(
        F.count_distinct("shop_id").alias("shops"), F.nullif(F.array_join(F.array_sort(F.collect_list("shop")), ", "), F.lit("")).alias("names"), F.min("fee").alias("lowest_fee"), F.max("fee").alias("highest_fee"), (F.count("shop_id") > 3).alias("covered")
    )


@query("SELECT count(*) AS n, coalesce(min(s_acctbal), -90) AS low, coalesce(max(s_acctbal), 90) AS high FROM supplier WHERE s_nationkey = 4")
def a10_bounds(v: Views) -> DataFrame:
    """The box around points, or a default one."""
    rows = v.table("supplier").where("s_nationkey = 4")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.min("s_acctbal"), F.lit(-90.0)).alias("low"), F.coalesce(F.max("s_acctbal"), F.lit(90.0)).alias("high"))


@query("SELECT DISTINCT a.shop_id FROM delivery_area a JOIN shop s ON s.shop_id = a.shop_id JOIN district d ON d.district_id = a.district_id WHERE s.enabled AND d.district_id = 7 AND d.region_id = (SELECT region_id FROM district WHERE district_id = 7)")
def delivery_shops(v: Views) -> DataFrame:
    """Enabled shops that deliver to one district, along one path from region to area."""
    return v.delivery_area.where("district_id = 7").join(v.shop.where("enabled"), "shop_id", "left_semi").select("shop_id").distinct()


@query(f"""WITH s AS (SELECT shop_id, count(*) AS stale FROM offer WHERE ts < TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY GROUP BY 1), t AS (SELECT sum(stale) AS total FROM s)
    SELECT shop_id, stale, round(stale / CAST(total AS DOUBLE), 4) AS share, CAST(greatest(1, floor(stale / CAST(total AS DOUBLE) * 500)) AS BIGINT) AS workers FROM s, t""")
def crawl_allocation(v: Views) -> DataFrame:
    """Workers in proportion to stale offers, at least one."""
    old = v.offer.where(F.col("ts") < F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval 365 day"))
    stale = old.groupBy("shop_id").agg(F.count("*").alias("stale"))
    total = stale.agg(F.sum("stale").alias("total"))
    share = F.col("stale") / F.col("total").cast("double")
    rows = stale.join(F.broadcast(total))  # one row
    return rows.select("shop_id", "stale", F.round(share, 4).alias("share"), F.greatest(F.lit(1), F.floor(share * 500)).cast("long").alias("workers"))


def access_log(v: Views) -> DataFrame:
    """Lines of a web server's log made from events: one column `line`."""
    k = F.col("k")
    path = F.when(k % 7 == 0, "/.env").when(k % 11 == 0, "/wp-admin/x").when(k % 13 == 0, "/favicon.ico").otherwise(F.concat(F.lit("/p/"), k.cast("string")))
    code = F.when(F.col("event_type") == "error", "404").when(F.col("event_type") == "signup", "301").otherwise("200")
    agent = F.when(F.col("user_id") % 9 == 0, "badbot/1.0").otherwise("Mozilla/5.0 (iPhone)")
    ip = F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"))
    events = v.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return events.select(F.concat(ip, F.lit(' - - [x] "GET '), path, F.lit(' HTTP/1.1" '), code, F.lit(' 12 "-" "'), agent, F.lit('"')).alias("line"))


LOG_SQL = """SELECT '10.0.0.' || user_id || ' - - [x] "GET ' || CASE WHEN k % 7 = 0 THEN '/.env' WHEN k % 11 = 0 THEN '/wp-admin/x' WHEN k % 13 = 0 THEN '/favicon.ico' ELSE '/p/' || k END || ' HTTP/1.1" '
    || CASE event_type WHEN 'error' THEN '404' WHEN 'signup' THEN '301' ELSE '200' END || ' 12 "-" "' || CASE WHEN user_id % 9 = 0 THEN 'badbot/1.0' ELSE 'Mozilla/5.0 (iPhone)' END || '"' AS line
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""


def abuse(log: DataFrame, agents: tuple[str, ...] = ("badbot",), terms: tuple[str, ...] = ABUSE_TERMS) -> DataFrame:
    """(ip, reason, n): requests by denied agents, and requests for a denied term that were answered 404, 500 or 301."""
    line = F.col("line")
    agent = F.regexp_extract(line, r'"([^"]+)"$', 1)
    by_agent = any_of(agent.contains(a) for a in agents)
    by_term = any_of(line.contains(t) for t in terms) & any_of(line.contains(f" {c} ") for c in (404, 500, 301))
    ip = F.regexp_extract(line, r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})", 1)
    reason = F.when(by_agent, F.array(F.lit("agent"))).when(by_term, F.array(F.lit("term")))
    rows = log.select("line", F.explode(reason).alias("reason")).select(ip.alias("ip"), "reason")  # a generator: a filter would be pushed below and repeat the tests
    return rows.groupBy("ip", "reason").agg(F.count("*").alias("n")).where("ip <> ''")


_TERMS = " OR ".join(f"contains(line, '{t}')" for t in ABUSE_TERMS)


@query(f"""SELECT ip, reason, count(*) AS n FROM (SELECT regexp_extract(line, '(\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}})', 1) AS ip,
    CASE WHEN contains(regexp_extract(line, '"([^"]+)"$', 1), 'badbot') THEN 'agent' WHEN ({_TERMS}) AND (contains(line, ' 404 ') OR contains(line, ' 500 ') OR contains(line, ' 301 ')) THEN 'term' END AS reason FROM ({LOG_SQL})) WHERE reason IS NOT NULL GROUP BY 1, 2""")
def log_abuse(v: Views) -> DataFrame:
    return abuse(access_log(v))


@query(f"SELECT regexp_matches(lower(line), '(iphone|mobile|androidtouch)') AS mobile, count(*) AS n FROM ({LOG_SQL}) GROUP BY 1")
def s33_mobile_agents(v: Views) -> DataFrame:
    from ..functions.text import is_mobile

    return access_log(v).groupBy(is_mobile(F.col("line")).alias("mobile")).agg(F.count("*").alias("n"))
