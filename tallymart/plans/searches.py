"""Many searches at once over stored posting lists, and what barcodes fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.postings import posting_lists, searched
from ..operators.staged import Staging
from ..operators.tables import overlapping
from ..registry import query
from ..sources.views import Views

#: Searches out of the tables: a customer looks for words of the parts of one of their orders: with a brand, without, cut short, and one that finds nothing.
_SEARCHES = """SELECT article_id AS search_id, CASE article_id % 5 WHEN 0 THEN name || ' ' || brand WHEN 1 THEN left(name, length(name) - 2) WHEN 2 THEN brand || ' ' || left(name, 2) WHEN 3 THEN upper(name) ELSE colour || ' zzz' END AS text FROM article WHERE article_id IN (SELECT min(article_id) FROM offer GROUP BY order_id)"""


def searches(v: Views) -> DataFrame:
    asked = v.offer.groupBy("order_id").agg(F.min("article_id").alias("article_id")).select("article_id").distinct()
    k = F.col("article_id") % 5
    text = F.when(k == 0, F.concat_ws(" ", "name", "brand")).when(k == 1, F.substring("name", F.lit(1), F.length("name") - 2)).when(k == 2, F.concat(F.col("brand"), F.lit(" "), F.substring("name", 1, 2))).when(k == 3, F.upper("name")).otherwise(F.concat("colour", F.lit(" zzz")))
    return v.article.join(asked, "article_id", "left_semi").select(F.col("article_id").alias("search_id"), text.alias("text"))


@query(f"""WITH s AS (SELECT search_id, string_split(lower(text), ' ') AS w FROM ({_SEARCHES})), n AS (SELECT s.search_id, b.brand, [x for x in s.w if x <> lower(b.brand)] AS rest FROM s JOIN (SELECT DISTINCT brand FROM article) b ON list_contains(s.w, lower(b.brand))),
    q AS (SELECT s.search_id, n.brand, coalesce(n.rest, s.w) AS w FROM s LEFT JOIN n ON n.search_id = s.search_id)
    SELECT q.search_id, count(*) AS found, min(a.article_id) AS first_id, CAST(sum(a.article_id) AS BIGINT) AS ids FROM q JOIN article a ON (q.brand IS NULL OR a.brand = q.brand) AND (len(q.w) > 0 AND starts_with(lower(a.name), q.w[1]) AND len([x for x in q.w if NOT contains(lower(a.name), x)]) = 0) GROUP BY 1""")
def q01_many_searches(v: Views) -> DataFrame:
    """What each of many searches finds: a brand that it names narrows it, its first other word starts the name, the rest stand in it.

    Different words are met with different names once, over posting lists; articles of a name and brand are counted before.
    """
    asked = searches(v).select("search_id", F.split(F.lower("text"), " ").alias("w"))
    brands = v.article.select("brand").distinct().select("brand", F.lower("brand").alias("word"))
    named = asked.select("search_id", F.explode(F.array_distinct("w")).alias("word")).join(brands, "word").select("search_id", "brand", "word")
    rows = asked.join(named, "search_id", "left").select("search_id", "brand", F.when(F.col("word").isNull(), F.col("w")).otherwise(F.array_remove("w", F.col("word"))).alias("words"))
    asks = Staging(v.spark, "asks").put(rows.select("words").dropna().distinct().withColumn("ask", F.monotonically_increasing_id()))
    kinds = Staging(v.spark, "kinds").put(v.article.groupBy(F.lower("name").alias("t"), "brand").agg(F.count("*").alias("n"), F.min("article_id").alias("least"), F.sum("article_id").alias("sum")))
    names = Staging(v.spark, "names").put(kinds.groupBy("t").agg(F.min("least").alias("name_id")))
    lists = Staging(v.spark, "postings").put(posting_lists(names, "name_id", "t").repartitionByRange("piece").sortWithinPartitions("piece", "bucket"))
    found = searched(asks.select("ask", "words"), names, lists, "ask", "name_id", "t")
    each = found.join(names, "name_id").join(kinds, "t").groupBy("ask", "brand").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("sum").alias("sum"))
    each = Staging(v.spark, "found").put(each)
    all_ = each.groupBy("ask").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("sum").alias("sum"))
    askers = rows.join(asks, "words").select("search_id", "brand", "ask")
    kept = askers.where(F.col("brand").isNull()).join(all_, "ask").select("search_id", "n", "least", "sum").unionByName(askers.join(each, ["ask", "brand"]).select("search_id", "n", "least", "sum"))
    return kept.groupBy("search_id").agg(F.sum("n").alias("found"), F.min("least").alias("first_id"), F.sum("sum").alias("ids"))


_SHOPS = "SELECT article_id, list(DISTINCT shop_id) AS shops FROM (SELECT u.article_id, u.shop_id, u.price, min(u.price) OVER (PARTITION BY u.article_id) AS least FROM usable u) WHERE price = least GROUP BY 1"


def barcodes_filled(rows: DataFrame) -> DataFrame:
    """(ean, article_id, degrees, measure, package, size, name, merged, sellers) of each barcode whose lowest article takes others over, in order of their ids.

    rows: (article_id, ean, name, degrees, measure, package, size, shops). An article is taken over if no shop sells it beside what is there so far; an article
    without shops overlaps with every other. Blank degrees, package and size are filled, the larger measure wins, a name of more than five letters replaces the name, sellers are united. A barcode has few articles.
    """
    columns = ("article_id", "name", "degrees", "measure", "package", "size", "shops")
    first = F.array_sort(F.collect_list(F.struct(*columns)))
    start = lambda x: F.struct(x["name"].alias("name"), x["degrees"].alias("degrees"), x["measure"].alias("measure"), x["package"].alias("package"), x["size"].alias("size"), x["shops"].alias("shops"), F.lit(1).cast("long").alias("merged"))

    def step(s, x):
        fill = lambda c, blank: F.when(blank(s[c]), x[c]).otherwise(s[c]).alias(c)
        no_text = lambda c: c.isNull() | (c == "")
        new = F.struct(F.when(F.length(x["name"]) > 5, x["name"]).otherwise(s["name"]).alias("name"), fill("degrees", lambda c: c.isNull() | (c == 0)), F.greatest(s["measure"], x["measure"]).alias("measure"), fill("package", no_text), fill("size", no_text), F.array_union(s["shops"], x["shops"]).alias("shops"), (s["merged"] + 1).alias("merged"))
        return F.when(overlapping(s["shops"], x["shops"]), s).otherwise(new)

    grouped = rows.groupBy("ean").agg(first.alias("all")).where(F.size("all") > 1)
    folded = grouped.select("ean", F.get("all", 0)["article_id"].alias("article_id"), F.aggregate(F.slice("all", F.lit(2), F.size("all")), start(F.get("all", 0)), step).alias("s"))
    return folded.where("s.merged > 1").select("ean", "article_id", "s.degrees", "s.measure", "s.package", "s.size", "s.name", "s.merged", F.size("s.shops").cast("long").alias("sellers"))


@query(f"""WITH RECURSIVE h AS ({_SHOPS}), a AS (SELECT x.article_id, ean, name, degrees, measure, nullif(package, 'PROMO') AS package, nullif(size, 'xs') AS size, coalesce(h.shops, []) AS shops, row_number() OVER (PARTITION BY ean ORDER BY x.article_id) AS k FROM article x LEFT JOIN h ON h.article_id = x.article_id),
    r AS (SELECT ean, article_id, k, name, degrees, measure, package, size, shops, 1::BIGINT AS merged FROM a WHERE k = 1 UNION ALL
    SELECT r.ean, r.article_id, a.k, CASE WHEN ok AND length(a.name) > 5 THEN a.name ELSE r.name END, CASE WHEN ok AND r.degrees = 0 THEN a.degrees ELSE r.degrees END, CASE WHEN ok THEN greatest(r.measure, a.measure) ELSE r.measure END, CASE WHEN ok THEN coalesce(r.package, a.package) ELSE r.package END, CASE WHEN ok THEN coalesce(r.size, a.size) ELSE r.size END,
        CASE WHEN ok THEN list_concat(r.shops, a.shops) ELSE r.shops END, r.merged + CASE WHEN ok THEN 1 ELSE 0 END FROM (SELECT r.*, len(r.shops) > 0 AND len(n.shops) > 0 AND NOT list_has_any(r.shops, n.shops) AS ok FROM r JOIN a n ON n.ean = r.ean AND n.k = r.k + 1) r JOIN a ON a.ean = r.ean AND a.k = r.k + 1)
    SELECT ean, article_id, degrees, measure, package, size, name, merged, len(list_distinct(shops)) AS sellers FROM r WHERE merged > 1 QUALIFY row_number() OVER (PARTITION BY ean ORDER BY k DESC) = 1""")
def m08_barcodes_filled(v: Views) -> DataFrame:
    """Articles of one barcode as one, with all that they fill; the shops that sell an article cheapest stand for its sellers."""
    w = Window.partitionBy("article_id")
    cheap = v.usable.withColumn("least", F.min("price").over(w)).where("price = least").groupBy("article_id").agg(F.collect_set("shop_id").alias("shops"))
    rows = v.article.join(cheap, "article_id", "left").select("article_id", "ean", "name", "degrees", "measure", F.nullif("package", F.lit("PROMO")).alias("package"), F.nullif("size", F.lit("xs")).alias("size"), F.coalesce("shops", F.array().cast("array<bigint>")).alias("shops"))
    return barcodes_filled(rows)


@query("SELECT article_id, left(c, 50) AS category, left(regexp_replace(s, '^https?://schema.org/', ''), 20) AS stock FROM (SELECT article_id, package || ' > ' || name || ' > ' || brand || ' > ' || colour || ' > all the rest of the shop' AS c, 'https://schema.org/LimitedAvailability' || size AS s FROM article)")
def s29_stock_and_category(v: Views) -> DataFrame:
    """Stock without the vocabulary's address, in twenty letters, and a category in fifty."""
    category = F.concat_ws(" > ", "package", "name", "brand", "colour", F.lit("all the rest of the shop"))
    stock, cut = T.stock_and_category(F.concat(F.lit("https://schema.org/LimitedAvailability"), "size"), category)
    return v.article.select("article_id", cut.alias("category"), stock.alias("stock"))
