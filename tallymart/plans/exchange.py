"""What goes out to files and comes in from them: each query writes what a shop, a crawl or a server would leave, and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import upsert
from ..registry import query
from ..session import shared_folder
from ..sources import files
from ..sources.views import Views
from .onboarding import probe
from .reports import LOG_SQL, access_log


def place(v: Views, what: str) -> str:
    """A folder that no other run uses, in the session's shared one."""
    return f"{shared_folder(v.spark)}/exchange/{what}-{uuid.uuid4().hex}"


def addresses(v: Views) -> DataFrame:
    """The address and the day of each article that a shop lists."""
    day = v.offer.groupBy("article_id").agg(F.max("ts").cast("date").alias("lastmod"))
    return day.select(F.concat(F.lit("https://shop.example/p/"), F.col("article_id").cast("string")).alias("loc"), "lastmod")


@query("SELECT 'https://shop.example/p/' || article_id AS loc, CAST(max(ts) AS DATE) AS lastmod FROM offer GROUP BY article_id")
def src03_sitemap_index(v: Views) -> DataFrame:
    """Addresses of all sitemaps that an index lists, over an index of indexes; the sitemaps are compressed."""
    at = place(v, "sitemaps")
    files.write_sitemap(addresses(v).where("crc32(cast(loc as binary)) % 2 = 0"), f"{at}/one", compression="gzip")
    files.write_sitemap(addresses(v).where("crc32(cast(loc as binary)) % 2 = 1"), f"{at}/two", compression="gzip")
    files.write_index(v.spark, [f"{at}/two"], f"{at}/inner")
    files.write_index(v.spark, [f"{at}/one", f"{at}/inner", f"{at}/outer"], f"{at}/outer")
    return files.read_sitemaps(v.spark, f"{at}/outer")


_DAY = "SELECT article_id, 'https://shop.example/p/' || article_id AS loc, CAST(max(ts) AS DATE) AS lastmod FROM offer GROUP BY 1"


@query(f"SELECT loc, lastmod, (row_number() OVER (ORDER BY article_id) - 1) // 30 + 1 AS page FROM ({_DAY})")
def snk04_sitemap_files(v: Views) -> DataFrame:
    """Sitemaps of thirty addresses each and their index, read back over the index; a row's page is the file that it came from."""
    at = place(v, "pages")
    rows = v.offer.groupBy("article_id").agg(F.max("ts").cast("date").alias("lastmod")).withColumn("loc", F.concat(F.lit("https://shop.example/p/"), F.col("article_id").cast("string")))
    files.write_sitemap_pages(rows, at, "article_id", 30)
    return files.read_sitemap_pages(v.spark, at)


@query("SELECT directive, content, count(*) AS n FROM (SELECT 'user-agent' AS directive, '*' AS content FROM shop UNION ALL SELECT 'disallow', '/cart/' || (shop_id % 7) FROM shop UNION ALL SELECT 'sitemap', 'https://shop' || (shop_id % 5) || '.example/sitemap.xml' FROM shop) GROUP BY 1, 2")
def src05_robots(v: Views) -> DataFrame:
    """Directives of the robots files of all shops, comments and blank lines left out."""
    at = place(v, "robots")
    k = F.col("shop_id")
    lines = F.array(F.lit("# shop"), F.lit("User-agent: *  # all"), F.lit(""), F.concat(F.lit("Disallow:/cart/"), (k % 7).cast("string")), F.concat(F.lit("SITEMAP: https://shop"), (k % 5).cast("string"), F.lit(".example/sitemap.xml")))
    v.shop.select(F.explode(lines).alias("value")).write.text(at)
    return files.read_robots(v.spark, at).groupBy("directive", "content").agg(F.count("*").alias("n"))


@query("SELECT article_id, name, brand FROM article")
def src06_crawl_lines(v: Views) -> DataFrame:
    """A crawl in JSON lines, read back."""
    at = place(v, "crawl")
    files.write_json(v.article.select("article_id", "name", "brand"), at)
    return files.read_crawl(v.spark, at, "article_id long, name string, brand string")


_UPLOAD = "SELECT CAST(shop_id AS VARCHAR) AS site, 'https://shop.example/' || order_id || '/' || line || '/' || article_id AS url, error404, price, 'say \"' || article_id || '\", now' AS name FROM offer"


@query(f"SELECT url, max(price) AS price, count(*) AS n FROM ({_UPLOAD}) GROUP BY 1")
def src08_upload(v: Views) -> DataFrame:
    """Offers out of uploaded CSV files, quotes and commas in their names kept."""
    rows = uploaded(v)
    return rows.where(F.col("name").startswith('say "') & F.col("name").endswith('", now')).groupBy("url").agg(F.max("price").alias("price"), F.count("*").alias("n"))


def uploaded(v: Views) -> DataFrame:
    at = place(v, "upload")
    url = F.concat_ws("/", F.lit("https://shop.example"), F.col("order_id").cast("string"), F.col("line").cast("string"), F.col("article_id").cast("string"))
    name = F.concat(F.lit('say "'), F.col("article_id").cast("string"), F.lit('", now'))
    none = [F.lit(None).cast("string").alias(c) for c in ("product_code", "brand", "image")]
    v.offer.select(F.col("shop_id").cast("string").alias("site"), url.alias("url"), "error404", "price", name.alias("name"), *none).write.option("header", True).option("escape", '"').csv(at)
    return files.read_upload(v.spark, at)


@query(f"SELECT url, CASE WHEN price % 3 = 1 THEN price ELSE price + 1 END AS price FROM (SELECT url, max(price) AS price FROM ({_UPLOAD}) GROUP BY 1)")
def mut09_upload_upsert(v: Views) -> DataFrame:
    """An upload put in or over the offers that are there, by address. The tables have no upload, so two parts of the offers stand for its sides."""
    rows = uploaded(v).groupBy("url").agg(F.max("price").alias("price"))
    return upsert(rows.where("price % 3 <> 0"), rows.where("price % 3 <> 1").withColumn("price", F.col("price") + 1), ["url"])


@query(f"SELECT line, count(*) AS n FROM ({LOG_SQL}) GROUP BY 1")
def src15_access_log(v: Views) -> DataFrame:
    """Lines of a server's log."""
    at = place(v, "log")
    access_log(v).select("line").write.text(at)
    return files.read_access_log(v.spark, at).groupBy("line").agg(F.count("*").alias("n"))


@query("SELECT TRUE AS marked, 'shop_id,name,enabled' AS header, count(*) AS shops, CAST(sum(shop_id) AS BIGINT) AS ids FROM shop")
def snk01_csv_export(v: Views) -> DataFrame:
    """A CSV export: whether every file begins with the UTF-8 mark, the header, and what a reader finds below it."""
    at = place(v, "csv")
    files.write_csv(v.shop.select("shop_id", "name", "enabled"), at)
    first = v.spark.read.text(at, wholetext=True).select(F.substring_index("value", "\n", 1).alias("first"))
    rows = v.spark.read.option("header", True).schema("shop_id long, name string, enabled boolean").option("enforceSchema", True).csv(at)
    heads = first.agg(F.min(F.ascii("first") == 0xFEFF).alias("marked"), F.max(F.regexp_replace("first", "^﻿", "")).alias("header"))
    return heads.join(rows.agg(F.count("*").alias("shops"), F.sum("shop_id").alias("ids")))  # one row each


@query("""SELECT 'https://shop.example/p/' || a.article_id AS loc, left(CAST(a.article_id AS VARCHAR), 1) <> '1' AS allowed, a.article_id % 2 = 0 AS fetched, CASE WHEN a.article_id % 2 = 0 THEN a.name END AS name, CASE WHEN a.article_id % 2 = 0 THEN a.brand END AS brand
    FROM article a WHERE article_id IN (SELECT article_id FROM offer)""")
def q18_onboarding_probe(v: Views) -> DataFrame:
    """Addresses of a new shop's sitemaps, whether its robots file allows them, and the products that fetched pages hold."""
    at = place(v, "probe")
    v.spark.createDataFrame([("User-agent: *",), ("Disallow: /p/1",), ("Disallow:",)], "value string").write.text(f"{at}/robots")
    files.write_sitemap(addresses(v), f"{at}/sitemap")
    doc = F.to_json(F.struct(F.lit("Product").alias("@type"), "name", "brand", F.struct((F.col("article_id") * 10 + 990).alias("price")).alias("offers")))
    pages = v.article.where("article_id % 2 = 0").select(F.concat(F.lit("https://shop.example/p/"), F.col("article_id").cast("string")).alias("url"), doc.alias("json"))
    return probe(v.spark, f"{at}/robots", f"{at}/sitemap", pages).select("loc", "allowed", "fetched", "name", "brand")
