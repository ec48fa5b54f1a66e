"""What a new shop offers: from its robots file over sitemaps to the structured data of its pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup as M
from ..sources import files


def probe(spark: SparkSession, robots: str, sitemaps: str, pages: DataFrame) -> DataFrame:
    """(loc, lastmod, allowed, fetched, name, brand, code, price) for each address of a shop's sitemaps.

    pages: (url, json) with the structured data that was found. Addresses under a disallowed path are marked, not dropped.
    """
    rules = files.read_robots(spark, robots).where("directive = 'disallow' and content <> ''").select(F.col("content").alias("path"))
    locs = files.read_sitemap(spark, sitemaps).withColumn("at", F.regexp_replace("loc", "^https?://[^/]+", ""))
    sizes = rules.agg(F.collect_set(F.length("path")).alias("sizes"))
    begun = locs.join(F.broadcast(sizes)).select("loc", F.explode(F.transform(F.filter("sizes", lambda n: n <= F.length("at")), lambda n: F.substring("at", F.lit(1), n))).alias("path"))  # one row
    denied = begun.join(rules.distinct(), "path").select("loc").distinct().withColumn("denied", F.lit(True))
    node = M.product_node(F.col("json"))
    found = pages.select(F.col("url").alias("loc"), node.alias("node")).select("loc", *M.product_fields(F.col("node"))[:3], M.product_fields(F.col("node"))[4], F.lit(True).alias("fetched"))
    rows = locs.drop("at").join(denied, "loc", "left").join(found, "loc", "left")
    return rows.select("loc", "lastmod", F.col("denied").isNull().alias("allowed"), F.coalesce("fetched", F.lit(False)).alias("fetched"), "name", "brand", "code", "price")
