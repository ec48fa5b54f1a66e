"""Pages into typed offers by selectors that each site configures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.selectors import CONFIG, extracted, typed
from ..registry import query
from ..sources.views import Views

#: Settings of a site: field, order, how, selector, what is taken, what is removed, split by, part.
SETTINGS = (
    ("name", 1, "css", "article > h2.title", "text", None, None, None), ("name", 2, "css", "article > h1", "text", None, None, None), ("brand", 1, "css", "div.ad", "text", ["."], " ", 0), ("category", 1, "css", "nav ul > li:nth-of-type(2) a", "text", None, None, None),
    ("image", 1, "xpath", "//nav//li:first-child/a", "href", None, None, None), ("stock", 1, "css", "html[lang]", "lang", None, None, None), ("price", 1, "css", "script", "text", [");"], "(", -1), ("supplier", 1, "fixed", "House", None, None, None, None),
    ("code", 1, "meta", "product:code", None, None, None, None), ("code", 2, "css", "meta[charset]", "charset", ["-"], None, None), ("units", 1, "css", "#none > b", "text", None, None, None), ("kind", 1, "css", "b[", "text", None, None, None),
)


def pages_of_sites(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("site"), "html")


def settings(v: Views) -> DataFrame:
    """The same settings for each site that has pages."""
    rows = v.spark.createDataFrame([(None, *s) for s in SETTINGS], CONFIG)
    return pages_of_sites(v).select("site").distinct().join(F.broadcast(rows.drop("site")))  # a dozen rows


_PLAIN = "replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"
_FIELDS = rf"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS site, trim({_PLAIN.format("regexp_extract(html, '(?is)<article><h1[^>]*>(.*?)</h1>', 1)")}) AS name, trim(replace(split_part(trim({_PLAIN.format("regexp_extract(html, '(?is)<div class=.ad.>(.*?)</div>', 1)")}), ' ', 1), '.', '')) AS brand,
    trim({_PLAIN.format("regexp_extract_all(html, '(?is)<li><a href=.([^<>]*).>(.*?)</a></li>', 2)[2]")}) AS category, {_PLAIN.format("regexp_extract_all(html, '(?is)<li><a href=.([^<>]*).>(.*?)</a></li>', 1)[1]")} AS image, regexp_extract(html, '(?i)<html[^>]*lang=.([a-zA-Z-]+)', 1) AS stock,
    regexp_extract(html, '(?s)track\((\d+)\);</script>', 1) AS price, replace(regexp_extract(html, '(?i)<meta charset=.([A-Za-z0-9-]+)', 1), '-', '') AS code FROM pages WHERE html IS NOT NULL"""


@query(f"""SELECT page_id, nullif(lower(name), '') AS name, nullif(lower(brand), '') AS brand, nullif(lower(category), '') AS category, nullif(image, '') AS image, nullif(left(lower(stock), 20), '') AS stock, 'house' AS supplier, nullif(lower(code), '') AS code,
    TRY_CAST(nullif(price, '') AS BIGINT) AS price, CAST(1 AS BIGINT) AS price_quantity, CAST(NULL AS DOUBLE) AS units FROM ({_FIELDS})""")
def n07_typed_offers(v: Views) -> DataFrame:
    """Offers of all pages: every field by its site's selectors in one parse, written with its type."""
    rows = extracted(pages_of_sites(v), settings(v), "page_id")
    return rows.select("page_id", *typed(F.col("values"))).select("page_id", "name", "brand", "category", "image", "stock", "supplier", "code", "price", "price_quantity", "units")


@query(f"""WITH f AS ({_FIELDS}), s AS (SELECT site, count(*) AS pages, count(*) FILTER (name = '') AS no_name, count(*) FILTER (brand = '') AS no_brand, count(*) FILTER (category IS NULL OR category = '') AS no_category, count(*) FILTER (image IS NULL OR image = '') AS no_image, count(*) FILTER (stock = '') AS no_stock, count(*) FILTER (price = '') AS no_price, count(*) FILTER (code = '') AS no_code FROM f GROUP BY 1)
    SELECT site, field, selectors, CAST(errors AS BIGINT) AS errors FROM (SELECT site, unnest([{{'field': 'name', 'selectors': 'article > h2.title | article > h1', 'errors': pages + no_name}}, {{'field': 'brand', 'selectors': 'div.ad', 'errors': no_brand}}, {{'field': 'category', 'selectors': 'nav ul > li:nth-of-type(2) a', 'errors': no_category}},
    {{'field': 'image', 'selectors': '//nav//li:first-child/a', 'errors': no_image}}, {{'field': 'stock', 'selectors': 'html[lang]', 'errors': no_stock}}, {{'field': 'price', 'selectors': 'script', 'errors': no_price}}, {{'field': 'supplier', 'selectors': 'House', 'errors': 0}}, {{'field': 'code', 'selectors': 'product:code | meta[charset]', 'errors': pages + no_code}},
    {{'field': 'units', 'selectors': '#none > b', 'errors': pages}}, {{'field': 'kind', 'selectors': 'b[', 'errors': pages}}], recursive := true) FROM s)""")
def a26_selector_errors(v: Views) -> DataFrame:
    """The ordered selectors of each field of a site, and how often one of them gave nothing."""
    config = settings(v)
    errors = extracted(pages_of_sites(v), config, "page_id").select("site", F.explode("errors").alias("e")).groupBy("site", F.col("e.field").alias("field")).agg(F.count("*").alias("errors"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "search"))), lambda x: x["search"])
    listed = config.groupBy("site", "field").agg(F.array_join(ordered, " | ").alias("selectors"))
    return listed.join(errors, ["site", "field"], "left").select("site", "field", "selectors", F.coalesce("errors", F.lit(0)).cast("long").alias("errors"))


_GOT = ("name", "brand", "category", "image", "stock", "price", "code")
_SHARES = ", ".join(f"round(100.0::DOUBLE * {c} / CASE WHEN pages = 0 THEN 1 ELSE pages END, 4) AS {c}_share" for c in _GOT)


@query(f"""WITH f AS ({_FIELDS}), p AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS site, page_id, html IS NULL AS gone, starts_with(url, 'https:') AS secure, contains(url, '?') AS asked FROM pages),
    c AS (SELECT p.site, count(*) AS pages, count(*) FILTER (gone) AS missing, count(*) FILTER (secure) AS secure, count(*) FILTER (asked) AS with_query, {", ".join(f"count(*) FILTER (coalesce(f.{c}, '') <> '') AS {c}" for c in _GOT)},
        count(*) FILTER (coalesce(f.name, '') <> '' AND coalesce(f.price, '') <> '') AS usable, count(f.page_id) AS fetched FROM p LEFT JOIN f ON f.page_id = p.page_id GROUP BY ROLLUP (p.site))
    SELECT coalesce(site, 'total') AS site, pages, missing, pages - missing AS fetched, secure, with_query, {", ".join(_GOT)}, usable, {len({s[0] for s in SETTINGS})}::BIGINT AS fields, {len(SETTINGS)}::BIGINT AS selectors, {sum(s[2] == "css" for s in SETTINGS)}::BIGINT AS css, {sum(s[2] == "fixed" for s in SETTINGS)}::BIGINT AS fixed, {_SHARES},
    round(100.0::DOUBLE * missing / CASE WHEN pages = 0 THEN 1 ELSE pages END, 4) AS missing_share, round(100.0::DOUBLE * usable / CASE WHEN pages = 0 THEN 1 ELSE pages END, 4) AS usable_share FROM c""")
def a12_site_matrix(v: Views) -> DataFrame:
    """What the crawl has of each site and in all: pages, fields that were found, settings, and shares with a guarded denominator. Beside shop_status it is the rest of the status report."""
    pages = v.table("pages").select("page_id", "url", "html", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("site"))
    found = extracted(pages, settings(v), "page_id").select("page_id", "values")
    rows = pages.select("page_id", "site", F.col("html").isNull().alias("gone"), F.startswith("url", F.lit("https:")).alias("secure"), F.contains("url", F.lit("?")).alias("asked")).join(found, "page_id", "left")
    has = lambda c: F.col("values")[c].isNotNull()
    counts = [F.count("*").alias("pages"), F.count_if("gone").alias("missing"), F.count_if("secure").alias("secure"), F.count_if("asked").alias("with_query"), *[F.count_if(has(c)).alias(c) for c in _GOT], F.count_if(has("name") & has("price")).alias("usable")]
    c = rows.rollup("site").agg(*counts)
    fixed = {"fields": len({s[0] for s in SETTINGS}), "selectors": len(SETTINGS), "css": sum(s[2] == "css" for s in SETTINGS), "fixed": sum(s[2] == "fixed" for s in SETTINGS)}
    share = lambda n: F.round(100.0 * F.col(n) / F.when(F.col("pages") == 0, 1).otherwise(F.col("pages")), 4).alias(f"{n}_share")
    numbers = [F.lit(n).cast("long").alias(k) for k, n in fixed.items()]
    return c.select(F.coalesce("site", F.lit("total")).alias("site"), "pages", "missing", (F.col("pages") - F.col("missing")).alias("fetched"), "secure", "with_query", *_GOT, "usable", *numbers, *map(share, (*_GOT, "missing", "usable")))
