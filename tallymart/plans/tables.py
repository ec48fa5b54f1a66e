"""Mutations as table-to-table functions, and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import balanced, update_columns, upsert
from ..registry import query
from ..sources.views import Views

_OLD = "SELECT article_id, min(price) AS price, count(*) AS offers FROM usable WHERE price < 1200 GROUP BY 1"
_NEW = "SELECT article_id, min(price) AS price, count(*) AS offers FROM usable WHERE price >= 2200 GROUP BY 1"


def _best(v: Views, condition: str) -> DataFrame:
    return v.usable.where(condition).groupBy("article_id").agg(F.min("price").alias("price"), F.count("*").alias("offers"))


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(n.article_id, o.article_id) AS article_id, coalesce(n.price, o.price) AS price, coalesce(n.offers, o.offers) AS offers FROM o FULL OUTER JOIN n ON o.article_id = n.article_id")
def mut01_upsert(v: Views) -> DataFrame:
    """New rows put in or over old ones by key. The tables have no upload, so cheap and dear offers stand for its two sides."""
    return upsert(_best(v, "price < 1200"), _best(v, "price >= 2200"), ["article_id"])


@query("SELECT article_id, coalesce(views, 0) AS views FROM article LEFT JOIN (SELECT l_partkey AS k, count(*) AS views FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) ON k = article_id")
def mut03_counters(v: Views) -> DataFrame:
    """Counters computed anew over all rows rather than added to one at a time."""
    views = v.table("lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_partkey").alias("article_id")).agg(F.count("*").alias("views"))
    return v.article.select("article_id").join(views, "article_id", "left").select("article_id", F.coalesce("views", F.lit(0)).cast("long").alias("views"))


@query("SELECT article_id, brand FROM article WHERE article_id IN (SELECT article_id FROM usable)")
def mut05_collect_garbage(v: Views) -> DataFrame:
    """Articles that still have a listing."""
    return v.article.join(v.usable.select("article_id"), "article_id", "left_semi").select("article_id", "brand")


@query("SELECT shop_id, count(*) AS kept FROM offer WHERE NOT error404 GROUP BY 1")
def mut06_delete_missing(v: Views) -> DataFrame:
    return v.offer.where(~F.col("error404")).groupBy("shop_id").agg(F.count("*").alias("kept"))


@query("SELECT article_id, trim(replace(replace(replace(code, 'sku:', ''), chr(9), ''), chr(10), '')) AS code FROM (SELECT article_id, 'sku:' || ean || chr(9) || ' ' AS code FROM article)")
def mut07_cleanup(v: Views) -> DataFrame:
    code = F.concat(F.lit("sku:"), "ean", F.lit("\t "))
    return v.article.select("article_id", F.trim(F.translate(F.replace(code, F.lit("sku:"), F.lit("")), "\t\n", "")).alias("code"))


@query("SELECT a.article_id, a.name, CASE WHEN u.article_id IS NULL THEN a.package ELSE 'FIXED' END AS package FROM article a LEFT JOIN (SELECT article_id FROM article WHERE degrees > 0) u ON u.article_id = a.article_id")
def mut08_bulk_update(v: Views) -> DataFrame:
    """Some columns replaced for some keys."""
    new = v.article.where("degrees > 0").select("article_id", F.lit("FIXED").alias("package"))
    return update_columns(v.article.select("article_id", "name", "package"), new, "article_id", ["package"])


@query("SELECT DISTINCT a.brand, a.brand IN ('Brand#2', 'Brand#4') AS enabled FROM article a")
def mut10_enabled_flag(v: Views) -> DataFrame:
    """A brand's flag follows from the rules that redirect to it."""
    rules = v.spark.createDataFrame([("Brand#2",), ("Brand#4",)], "target string")
    return v.article.select("brand").distinct().join(rules, F.col("brand") == F.col("target"), "left").select("brand", F.col("target").isNotNull().alias("enabled"))


@query("SELECT basket_id, string_agg(quantity || ' ' || item, '; ' ORDER BY item) AS items, count(*) AS n FROM basket GROUP BY 1")
def q17_saved_lists(v: Views) -> DataFrame:
    """The contents of each list with their quantities; a list is what one person put together."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("item", "quantity"))), lambda x: F.concat_ws(" ", x["quantity"].cast("string"), x["item"]))
    return v.basket.groupBy("basket_id").agg(F.array_join(lines, "; ").alias("items"), F.count("*").alias("n"))


@query("""SELECT z.region_id, to_json(list({'district': d.name, 'shops': d.n} ORDER BY d.name))::VARCHAR AS json FROM zone z JOIN (SELECT d.region_id, d.name, count(s.shop_id) AS n FROM district d LEFT JOIN shop s ON s.district_id = d.district_id GROUP BY 1, 2) d ON d.region_id = z.region_id GROUP BY 1""")
def snk03_nested_json(v: Views) -> DataFrame:
    """Regions with their districts as nested documents."""
    n = v.district.join(v.shop.select("shop_id", "district_id"), "district_id", "left").groupBy("region_id", "name").agg(F.count("shop_id").alias("shops"))
    nested = F.array_sort(F.collect_list(F.struct(F.col("name").alias("district"), "shops")))
    return n.groupBy("region_id").agg(F.to_json(nested).alias("json"))


@query("""SELECT plan, to_json({'plan': plan, 'contents': list({'position': p, 'what': what, 'n': n} ORDER BY p)})::VARCHAR AS json FROM (SELECT c_mktsegment AS plan, o_orderpriority AS what, CAST(left(o_orderpriority, 1) AS BIGINT) AS p, count(*) AS n
    FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3) GROUP BY 1""")
def q16_plans_with_contents(v: Views) -> DataFrame:
    """Plans (here market segments) with what each contains, in order, as nested documents."""
    rows = v.table("customer").select("c_custkey", F.col("c_mktsegment").alias("plan")).join(v.table("orders").select("o_custkey", F.col("o_orderpriority").alias("what")), F.col("c_custkey") == F.col("o_custkey"))
    lines = rows.groupBy("plan", "what").agg(F.count("*").alias("n")).withColumn("position", F.substring("what", 1, 1).cast("long"))
    contents = F.array_sort(F.collect_list(F.struct("position", "what", "n"))).alias("contents")
    return lines.groupBy("plan").agg(contents).select("plan", F.to_json(F.struct("plan", "contents")).alias("json"))


@query("""WITH n AS (SELECT toxic, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY 1) SELECT l.doc_id, CAST(l.toxic AS BIGINT) AS toxic FROM labels l JOIN n ON n.toxic = l.toxic
    WHERE (l.doc_id * 2654435761) % 4294967296 / 4294967296.0::DOUBLE < (SELECT min(n) FROM n) / n.n::DOUBLE""")
def f08_balanced_classes(v: Views) -> DataFrame:
    return balanced(v.table("labels").select("doc_id", F.col("toxic").cast("long").alias("toxic")), "toxic", "doc_id")


@query("SELECT shop_id, to_json({'shop_id': shop_id, 'name': name, 'enabled': enabled})::VARCHAR AS json FROM shop WHERE enabled")
def snk02_json_export(v: Views) -> DataFrame:
    return v.shop.where("enabled").select("shop_id", F.to_json(F.struct("shop_id", "name", "enabled")).alias("json"))
