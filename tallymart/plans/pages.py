"""Pages, sitemaps and structured data: from crawled bytes to offers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import text as T
from ..operators.tables import crawled, reachable
from ..registry import query
from ..sources.views import Views


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h1, regexp_extract(html, '(?i)<meta[^>]*charset=["'']?([A-Za-z0-9_-]+)', 1) AS charset FROM pages""")
def page_meta_extract(v: Views) -> DataFrame:
    html = F.col("html")
    return v.table("pages").select("page_id", M.tag_text(html, "title").alias("title"), M.tag_text(html, "h1").alias("h1"), M.charset(html).alias("charset"))


_LINKS = """SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a [^>]*href=["'']([^"'']*)["'']', 1)) AS href FROM pages"""


@query(f"SELECT page_id, href, count(*) AS n FROM ({_LINKS}) GROUP BY 1, 2")
def page_links(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", F.explode(M.links(F.col("html"))).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


def link_edges(v: Views) -> DataFrame:
    """(src, dst): a page's group of links, and where they lead; the first word of a title is a page's own name."""
    pages = v.table("pages").select(F.concat(F.lit("/"), F.split_part(M.tag_text(F.col("html"), "h1"), F.lit(" "), F.lit(1))).alias("src"), F.explode(F.array_distinct(M.links(F.col("html")))).alias("dst"))
    return pages.where("src <> dst").distinct()


_EDGES = f"""SELECT DISTINCT src, dst FROM (SELECT '/' || split_part(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), ' ', 1) AS src, href AS dst FROM pages p JOIN ({_LINKS}) l ON l.page_id = p.page_id) WHERE src <> dst"""


@query(f"""WITH e AS ({_EDGES}), l0 AS (SELECT '/The' AS node, 0 AS level), l1 AS (SELECT DISTINCT dst AS node, 1 AS level FROM e JOIN l0 ON src = node WHERE dst NOT IN (SELECT node FROM l0)),
    l2 AS (SELECT DISTINCT dst AS node, 2 AS level FROM e JOIN l1 ON src = node WHERE dst NOT IN (SELECT node FROM l0 UNION ALL SELECT node FROM l1))
    SELECT node, CAST(level AS BIGINT) AS level FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)""")
def crawl_levels(v: Views) -> DataFrame:
    """What is reached from one page in two steps."""
    return reachable(link_edges(v), v.spark.createDataFrame([("/The",)], "node string"), 2)


@query(f"""WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT DISTINCT src AS node, CAST(0 AS BIGINT) AS level FROM e WHERE src IN ('/The', '/In', '/La') UNION
    SELECT dst, level + 1 FROM r JOIN e ON src = node WHERE level < 3 AND starts_with(dst, '/') AND NOT contains(dst, 'z') AND NOT contains(dst, ','))
    SELECT node, min(level) AS level FROM r GROUP BY 1 ORDER BY 2, 1 LIMIT 400""")
def src12_bounded_crawl(v: Views) -> DataFrame:
    """Pages in order of a crawl of three levels from several starts, of one prefix, without avoided words, four hundred at most."""
    edges = link_edges(v)
    start = edges.select(F.col("src").alias("node")).where(F.col("node").isin("/The", "/In", "/La")).distinct()
    return crawled(edges, start, 3, "/", ("z", ","), 400)


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS domain, [x for x in string_split(regexp_replace(url, '^https?://[^/]+', ''), '/') if x <> ''][1] AS group_1, [x for x in string_split(regexp_replace(url, '^https?://[^/]+', ''), '/') if x <> ''][2] AS group_2 FROM pages""")
def url_groups(v: Views) -> DataFrame:
    url = F.col("url")
    path = F.filter(F.split(F.regexp_replace(url, "^https?://[^/]+", ""), "/"), lambda x: x != "")
    return v.table("pages").select("page_id", F.regexp_extract(url, "^https?://([^/]+)", 1).alias("domain"), F.get(path, F.lit(0)).alias("group_1"), F.get(path, F.lit(1)).alias("group_2"))


@query("SELECT site, n, site || '/list?page=' || CASE WHEN n > 1 THEN CAST(n AS VARCHAR) ELSE '1' END || '&sort=price' AS url FROM (SELECT 'https://shop' || shop_id AS site FROM shop WHERE enabled) s, (SELECT unnest(generate_series(1, 5)) AS n) p")
def listing_pages(v: Views) -> DataFrame:
    """The addresses of a shop's listing pages."""
    sites = v.shop.where("enabled").select(F.concat(F.lit("https://shop"), F.col("shop_id").cast("string")).alias("site"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("n"))
    return sites.select("site", "n", F.concat("site", F.lit("/list?page="), F.col("n").cast("string"), F.lit("&sort=price")).alias("url"))


@query("SELECT page, max(n) AS last FROM (SELECT 'https://shop' || shop_id || '/list' AS page, CAST(order_id % 9 AS BIGINT) AS n FROM offer) GROUP BY 1")
def page_frontier(v: Views) -> DataFrame:
    """The highest page number seen of each listing, out of its addresses."""
    url = F.concat(F.lit("https://shop"), F.col("shop_id").cast("string"), F.lit("/list?page="), (F.col("order_id") % 9).cast("string"))
    return v.offer.select(F.split_part(url, F.lit("?page="), F.lit(1)).alias("page"), F.split_part(url, F.lit("?page="), F.lit(2)).cast("long").alias("n")).groupBy("page").agg(F.max("n").alias("last"))


@query("SELECT url FROM (SELECT 'https://shop.example/p/' || article_id AS url FROM article) WHERE url NOT IN (SELECT 'https://shop.example/p/' || article_id FROM usable) AND length(url) < 500")
def new_urls(v: Views) -> DataFrame:
    """Addresses of a sitemap that no offer has yet."""
    at = F.concat(F.lit("https://shop.example/p/"), F.col("article_id").cast("string"))
    known = v.usable.select(at.alias("url")).distinct()
    return v.article.select(at.alias("url")).where(F.length("url") < 500).join(known, "url", "left_anti")


@query("SELECT page_id FROM pages WHERE NOT regexp_matches(url, '(login|cart|/7)') AND contains(url, 'http')")
def avoid_keywords(v: Views) -> DataFrame:
    return v.table("pages").where(~F.col("url").rlike("(login|cart|/7)") & F.col("url").contains("http")).select("page_id")


#: Shapes of a product's structured data, by article_id % 6.
def _shaped(v: Views) -> DataFrame:
    key, price = F.col("article_id").cast("string"), (F.col("article_id") * 10 + 990).cast("string")
    offer = F.concat(F.lit('{"@type":"Offer","price":"$'), price, F.lit('","availability":"InStock"}'))
    head = F.concat(F.lit('"@type":"Product","name":"'), "name", F.lit('","sku":"'), key, F.lit('","brand":'))
    named = F.concat(F.lit('{"@type":"Brand","name":"'), "brand", F.lit('"}'))
    plain = F.concat(F.lit('"'), "brand", F.lit('"'))
    crumbs = F.concat(F.lit('{"@type":"BreadcrumbList","itemListElement":[{"position":1,"item":{"@id":"/c","name":"'), "package", F.lit('"}},{"position":2,"name":"'), "size", F.lit('","item":"/s"}]}'))
    shapes = [
        F.concat(F.lit("{"), head, named, F.lit(',"offers":['), offer, F.lit("]}")),
        F.concat(F.lit("{"), head, plain, F.lit(',"image":{"url":"a.png"},"offers":'), offer, F.lit("}")),
        F.concat(F.lit("{"), head, plain, F.lit(',"image":"b.png","offers":{"@type":"AggregateOffer","offers":['), offer, F.lit("]}}")),
        F.concat(F.lit('{"@graph":['), crumbs, F.lit(",{"), head, named, F.lit(',"offers":'), offer, F.lit("}]}")),
        crumbs,
        F.concat(F.lit('{"@type":"Product","name":'), "name"),
    ]
    out = shapes[5]
    for k in range(5):
        out = F.when(F.col("article_id") % 6 == k, shapes[k]).otherwise(out)
    return v.article.select("article_id", out.alias("json"))


@query("""SELECT article_id, name, brand, CAST(article_id AS VARCHAR) AS code, CASE article_id % 6 WHEN 1 THEN 'a.png' WHEN 2 THEN 'b.png' END AS image, article_id * 10 + 990 AS price, 'InStock' AS availability FROM article WHERE article_id % 6 < 4""")
def jsonld_product(v: Views) -> DataFrame:
    """Products out of documents of six shapes, of which two hold none."""
    nodes = _shaped(v).select("article_id", M.product_node(F.col("json")).alias("node")).where(F.col("node").isNotNull())
    rows = nodes.select("article_id", *M.product_fields(F.col("node")))
    return rows.withColumn("price", T.json_price(F.col("price")))


@query("SELECT article_id, CAST(p AS BIGINT) AS position, CASE p WHEN 1 THEN package ELSE size END AS name, CASE p WHEN 1 THEN '/c' ELSE '/s' END AS item FROM article, (SELECT unnest([1, 2]) AS p) WHERE article_id % 6 IN (3, 4)")
def jsonld_breadcrumb(v: Views) -> DataFrame:
    return M.breadcrumbs(_shaped(v), "json", ["article_id"])


@query("SELECT a.article_id, to_json({'@type': 'Product', 'name': a.name, 'brand': a.brand, 'lowPrice': min(u.price), 'offerCount': count(*)})::VARCHAR AS json FROM article a JOIN usable u ON u.article_id = a.article_id GROUP BY a.article_id, a.name, a.brand")
def snk08_product_documents(v: Views) -> DataFrame:
    """A document for each article with offers."""
    rows = v.usable.join(v.article, "article_id").groupBy("article_id", "name", "brand").agg(F.min("price").alias("low"), F.count("*").alias("n"))
    doc = F.struct(F.lit("Product").alias("@type"), "name", "brand", F.col("low").alias("lowPrice"), F.col("n").alias("offerCount"))
    return rows.select("article_id", F.to_json(doc).alias("json"))


@query("SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<h2[^>]*>(.*?)</h2>', 1)), ''), nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)), '')) AS name FROM pages")
def selector_fallback(v: Views) -> DataFrame:
    """The first of several places that holds a name."""
    html = F.col("html")
    return v.table("pages").select("page_id", M.with_fallbacks(M.tag_text(html, "h2"), M.tag_text(html, "h1")).alias("name"))


@query()
def page_titles_parsed(v: Views) -> DataFrame:
    """Titles by an HTML parser, with character references resolved."""
    return v.table("pages").select("page_id", M.selected("h1")(F.col("html")).alias("h1"), M.unescaped(M.tag_text(F.col("html"), "title")).alias("title"))


@query("SELECT page, CAST(min(article_id) AS BIGINT) AS first_id, CAST(max(article_id) AS BIGINT) AS last_id, count(*) AS n FROM (SELECT article_id, (row_number() OVER (ORDER BY article_id) - 1) // 100 + 1 AS page FROM article WHERE article_id IN (SELECT article_id FROM usable)) GROUP BY 1")
def sitemap_pages(v: Views) -> DataFrame:
    """Articles with sellers in pages of a hundred; every page is whole."""
    from ..operators.tables import global_pages

    have = v.article.select("article_id").join(v.usable.select("article_id"), "article_id", "left_semi")
    return global_pages(have, 100, "article_id").groupBy("page").agg(F.min("article_id").alias("first_id"), F.max("article_id").alias("last_id"), F.count("*").alias("n"))
