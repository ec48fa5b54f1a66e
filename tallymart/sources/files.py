"""Reading what crawls and servers leave behind, and writing what others read."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The default of a sitemap's lastmod.
DEFAULT_LASTMOD = "2022-10-24"
#: Entries that the protocol allows in an index.
INDEX = 50_000
UPLOAD_SCHEMA = "site string, url string, error404 boolean, price long, name string, product_code string, brand string, image string"


def read_sitemap(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(loc, lastmod) of all url elements of the XML files under one path or several, which may be compressed; a missing or odd date is the default."""
    raw = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    day = F.coalesce(F.try_to_date(F.substring("lastmod", 1, 10), "yyyy-MM-dd"), F.lit(DEFAULT_LASTMOD).cast("date"))
    return raw.where(F.col("loc").isNotNull()).select(F.trim("loc").alias("loc"), day.alias("lastmod"))


def read_sitemap_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(loc) of all sitemap elements of index files."""
    return spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(path).select(F.trim("loc").alias("loc"))


def read_sitemaps(spark: SparkSession, index: str) -> DataFrame:
    """(loc, lastmod) of all sitemaps that an index lists, followed through indexes of indexes; what was followed once isn't followed again.

    The protocol bounds an index at 50,000 entries; their paths alone reach the driver. A file that is no index gives no entries there. All files
    of a level are read at once, so the jobs are as many as the levels.
    """
    seen: set[str] = set()
    front, maps = [index], []
    while front:
        seen.update(front)
        listed = {r["loc"] for r in read_sitemap_index(spark, front).distinct().collect()}
        maps += front
        front = sorted(listed - seen)
    return read_sitemap(spark, maps).distinct()


def write_sitemap_pages(df: DataFrame, path: str, key: str, size: int = 10_000, loc: str = "loc", lastmod: str = "lastmod") -> int:
    """A sitemap file for each page of `size` rows in order of a unique numeric key, and under path/index the index of the files that are there. Gives their number.

    More than INDEX files are listed in several indexes, which path/index lists, as the protocol asks for.

    Each file holds exactly the rows of its page: pages are numbered by ranges, dealt whole, and written to a folder each.
    """
    from ..operators.tables import global_pages

    spark = df.sparkSession
    rows = global_pages(df.select(key, F.col(loc).alias("loc"), F.date_format(lastmod, "yyyy-MM-dd").alias("lastmod")), size, key)
    rows.select("loc", "lastmod", "page").repartition("page").write.partitionBy("page").format("xml").option("rootTag", "urlset").option("rowTag", "url").mode("overwrite").save(f"{path}/maps")
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(f"{path}/maps").select(F.col("path").alias("loc"))
    pages = there.select("loc", page_of("loc").alias("page")).orderBy("page").cache()
    found, last = pages.agg(F.count("*"), F.max("page")).first()
    if found <= INDEX:
        _write_index(pages.select("loc"), f"{path}/index")
    else:
        parts = range(-(-last // INDEX))
        for k in parts:
            _write_index(pages.where((F.col("page") > k * INDEX) & (F.col("page") <= (k + 1) * INDEX)).select("loc"), f"{path}/indexes/{k}")
        write_index(spark, [f"{path}/indexes/{k}" for k in parts], f"{path}/index")
    pages.unpersist()
    return found


def page_of(path: str) -> Column:
    """The number of the page that a file of `write_sitemap_pages` holds, null for other files."""
    return F.nullif(F.regexp_extract(path, "/page=([0-9]+)/", 1), F.lit("")).cast("long")


def read_sitemap_pages(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod, page) of the files under path that its index, or the indexes which that lists, name. No list of files reaches the driver, only that of indexes."""
    top = read_sitemap_index(spark, f"{path}/index")
    inner = [r["loc"] for r in top.where(page_of("loc").isNull()).collect()]
    listed = top.unionByName(read_sitemap_index(spark, inner)) if inner else top
    found = spark.read.format("xml").option("rowTag", "url").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").schema("loc string, lastmod date").load(f"{path}/maps").select("loc", "lastmod", page_of("_metadata.file_path").alias("page"))
    return found.join(listed.select(page_of("loc").alias("page")).distinct(), "page", "left_semi").select("loc", "lastmod", "page")


def write_index(spark: SparkSession, locs: list[str], path: str) -> None:
    """An index of sitemaps."""
    _write_index(spark.createDataFrame([(x,) for x in locs], "loc string"), path)


def _write_index(locs: DataFrame, path: str) -> None:
    locs.coalesce(1).write.format("xml").option("rootTag", "sitemapindex").option("rowTag", "sitemap").mode("overwrite").save(path)


def read_robots(spark: SparkSession, path: str) -> DataFrame:
    """(directive, content) of the lines of robots files, directives in lower case; comments and blank lines go."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    rows = spark.read.text(path).select(F.lower(F.trim(F.regexp_extract(line, "^([^:]+):", 1))).alias("directive"), F.trim(F.regexp_extract(line, "^[^:]+:(.*)$", 1)).alias("content"))
    return rows.where("directive <> ''")


def read_crawl(spark: SparkSession, path: str, schema: str, most: int | None = None) -> DataFrame:
    """The rows of a crawl in JSON lines, the first `most` where that is asked for."""
    rows = spark.read.schema(schema).json(path)
    return rows if most is None else rows.limit(most)


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """Offers out of CSV files with a header."""
    return spark.read.option("header", True).option("escape", '"').schema(UPLOAD_SCHEMA).csv(path)


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a web server's log."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, each starting with the UTF-8 mark that spreadsheets look for."""
    first, *rest = df.columns
    marked = df.select(F.col(first).alias("﻿" + first), *rest)
    marked.write.option("header", True).mode("overwrite").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_sitemap(df: DataFrame, path: str, loc: str = "loc", lastmod: str = "lastmod", compression: str = "none") -> None:
    """XML files of url elements, compressed on request."""
    rows = df.select(F.col(loc).alias("loc"), F.date_format(lastmod, "yyyy-MM-dd").alias("lastmod"))
    rows.write.format("xml").option("rootTag", "urlset").option("rowTag", "url").option("compression", compression).mode("overwrite").save(path)


def read_jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, options: Mapping[str, str] | None = None) -> DataFrame:
    """A table of a database, read in parts of a numeric key where its bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**dict(options or {}))
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()
