"""Search, filters, joins and aggregates over offers and articles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.tables import facets, narrowed, page, small, without
from ..registry import query
from ..sources.views import Views

#: How many shops must sell an article before it is compared.
MIN_SELLERS = 16


def best_offers(offers: DataFrame, articles: DataFrame, least_sellers: int = MIN_SELLERS) -> DataFrame:
    """For each article with enough sellers: sellers, best price, the shop that has it (lowest id of equals), price per unit."""
    best = offers.groupBy("article_id").agg(F.count_distinct("shop_id").alias("sellers"), F.min("price").alias("best_price"), F.min(F.struct("price", "shop_id"))["shop_id"].alias("shop_id"))
    each = best.where(F.col("sellers") >= least_sellers).join(articles.select("article_id", "name", "brand", "units"), "article_id")
    return each.withColumn("price_per_unit", F.round(F.col("best_price") / F.when(F.col("units") > 0, F.col("units")).otherwise(1), 4))


BEST_SQL = f"""SELECT u.article_id, count(DISTINCT u.shop_id) AS sellers, min(u.price) AS best_price, arg_min(u.shop_id, (u.price, u.shop_id)) AS shop_id
    FROM usable u GROUP BY 1 HAVING count(DISTINCT u.shop_id) >= {MIN_SELLERS}"""


@query(f"""SELECT b.article_id, b.sellers, b.best_price, b.shop_id, a.name, a.brand, a.units, round(b.best_price / CASE WHEN a.units > 0 THEN a.units ELSE 1 END, 4) AS price_per_unit
    FROM ({BEST_SQL}) b JOIN article a ON a.article_id = b.article_id""")
def best_offer_per_article(v: Views) -> DataFrame:
    return best_offers(v.usable, v.article)


def search(v: Views, text: str, least_sellers: int = 2, number: int = 1, size: int = 20, **filters) -> DataFrame:
    """Articles by text: a barcode finds just its articles; else words that name a brand, of one word or more, narrow to all brands that are so
    named, the first word that isn't the brand's starts the name and the rest stand in it. Cheapest per unit first, one page.

    A brand is named where its words are a subset of the text's in their order, without regard to case. Each distinct brand is tested once and joined with its
    articles; whether any is named is a frame of one row.
    """
    words = [w for w in text.split() if w]
    articles = narrowed(v.article, **filters)
    if text.strip().isdigit() and len(text.strip()) >= 8:
        articles = articles.where(F.col("ean") == text.strip())
    else:
        given, name = F.array(*[F.lit(w.lower()) for w in words]).cast("array<string>"), F.lower("name")
        named, rest = T.subset_in_order(given, F.split(F.trim(F.lower("brand")), r"\s+"))
        brands = v.article.select("brand").distinct().select(F.col("brand").alias("_brand"), named.alias("_named"), rest.alias("_rest"))
        some = brands.agg(F.coalesce(F.max("_named"), F.lit(False)).alias("_any"))
        rows = articles.join(brands, F.col("brand").eqNullSafe(F.col("_brand"))).join(F.broadcast(some)).where(~F.col("_any") | F.col("_named"))  # one row
        asked = F.when(F.col("_any"), F.col("_rest")).otherwise(given)
        starts = (F.size(asked) == 0) | F.startswith(name, F.get(asked, 0))
        articles = rows.where(starts & F.forall(asked, lambda w: F.contains(name, w))).select(articles.columns)
    found = best_offers(v.usable.join(articles.select("article_id"), "article_id", "left_semi"), articles, least_sellers)
    return page(found, number, size, F.col("price_per_unit").asc_nulls_last(), F.col("article_id"))


@query("""SELECT * FROM (SELECT x.*, row_number() OVER (ORDER BY price_per_unit, article_id) AS row_number FROM (
    SELECT b.article_id, b.sellers, b.best_price, b.shop_id, a.name, a.brand, a.units, round(b.best_price / CASE WHEN a.units > 0 THEN a.units ELSE 1 END, 4) AS price_per_unit
    FROM (SELECT u.article_id, count(DISTINCT u.shop_id) AS sellers, min(u.price) AS best_price, arg_min(u.shop_id, (u.price, u.shop_id)) AS shop_id FROM usable u GROUP BY 1 HAVING count(DISTINCT u.shop_id) >= 2) b
    JOIN article a ON a.article_id = b.article_id WHERE a.brand = 'Brand#3' AND a.name LIKE 'red%' AND a.package IN ('ECONOMY', 'SMALL', 'PROMO')) x) WHERE row_number <= 20""")
def search_articles(v: Views) -> DataFrame:
    return search(v, "red brand#3", package=["ECONOMY", "SMALL", "PROMO"])


@query("""SELECT * FROM (SELECT x.*, row_number() OVER (ORDER BY price_per_unit, article_id) AS row_number FROM (
    SELECT b.article_id, b.sellers, b.best_price, b.shop_id, a.name, a.brand, a.units, round(b.best_price / CASE WHEN a.units > 0 THEN a.units ELSE 1 END, 4) AS price_per_unit
    FROM (SELECT u.article_id, count(DISTINCT u.shop_id) AS sellers, min(u.price) AS best_price, arg_min(u.shop_id, (u.price, u.shop_id)) AS shop_id FROM usable u GROUP BY 1 HAVING count(DISTINCT u.shop_id) >= 2) b
    JOIN article a ON a.article_id = b.article_id WHERE a.ean = '780000000010') x) WHERE row_number <= 20""")
def search_by_barcode(v: Views) -> DataFrame:
    return search(v, "780000000010")


@query(f"""SELECT * FROM (SELECT b.article_id, b.sellers, b.best_price, a.name, a.size, row_number() OVER (ORDER BY a.name, b.article_id) AS row_number
    FROM ({BEST_SQL}) b JOIN article a ON a.article_id = b.article_id WHERE a.brand = 'Brand#7') WHERE row_number BETWEEN 11 AND 20""")
def brand_page(v: Views) -> DataFrame:
    articles = narrowed(v.article, brand="Brand#7")
    found = best_offers(v.usable.join(articles.select("article_id"), "article_id", "left_semi"), articles)
    found = found.join(articles.select("article_id", "size"), "article_id").select("article_id", "sellers", "best_price", "name", "size")
    return page(found, 2, 10, F.col("name"), F.col("article_id"))


FACETS_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS facet, CAST({c} AS VARCHAR) AS value, count(DISTINCT article_id) AS n FROM r WHERE {w} GROUP BY 2"
    for n, c, w in (("shop", "shop_id", "true"), ("brand", "brand", "true"), ("degrees", "CAST(round(degrees * 10) AS BIGINT)", "degrees <> 0"), ("package", "package", "package IS NOT NULL"), ("colour", "colour", "colour <> ''"), ("measure", "CAST(measure AS BIGINT)", "measure <> 0"), ("measure_unit", "CAST(CAST(measure AS BIGINT) AS VARCHAR) || ' ' || unit", "measure <> 0"), ("unit", "unit", "unit <> ''"), ("size", "size", "size <> ''"), ("units", "units", "units > 1"))
)


@query(f"WITH r AS (SELECT u.shop_id, a.* FROM usable u JOIN article a ON a.article_id = u.article_id WHERE a.name LIKE '%ring') {FACETS_SQL}")
def facet_counts(v: Views) -> DataFrame:
    rows = v.usable.select("shop_id", "article_id").join(v.article.where(F.col("name").endswith("ring")), "article_id")
    measure = F.col("measure").cast("long")
    rows = rows.withColumns({"tenths": F.round(F.col("degrees") * 10).cast("long"), "amount": measure, "amount_unit": F.concat_ws(" ", measure.cast("string"), "unit")})
    some = lambda c: F.col(c) != ""
    return facets(rows, {
        "shop": ("shop_id", F.lit(True)), "brand": ("brand", F.lit(True)), "degrees": ("tenths", F.col("degrees") != 0), "package": ("package", F.col("package").isNotNull()), "colour": ("colour", some("colour")),
        "measure": ("amount", F.col("measure") != 0), "measure_unit": ("amount_unit", F.col("measure") != 0), "unit": ("unit", some("unit")), "size": ("size", some("size")), "units": ("units", F.col("units") > 1),
    }, "article_id")


@query("""SELECT CASE WHEN grouping(a.brand) = 0 THEN 'brand' WHEN grouping(a.package) = 0 THEN 'package' ELSE 'size' END AS facet,
    coalesce(a.brand, a.package, a.size) AS value, count(DISTINCT a.article_id) AS n FROM article a JOIN usable u ON a.article_id = u.article_id GROUP BY GROUPING SETS ((a.brand), (a.package), (a.size))""")
def facets_grouping_sets(v: Views) -> DataFrame:
    """Facets without conditions of their own, as grouping sets."""
    rows = v.article.join(v.usable.select("article_id").distinct(), "article_id", "left_semi")
    sets = [[F.col("brand")], [F.col("package")], [F.col("size")]]
    out = rows.groupingSets(sets, "brand", "package", "size").agg(F.grouping("brand").alias("b"), F.grouping("package").alias("p"), F.count_distinct("article_id").alias("n"))
    return out.select(F.when(F.col("b") == 0, "brand").when(F.col("p") == 0, "package").otherwise("size").alias("facet"), F.coalesce("brand", "package", "size").alias("value"), "n")


@query("SELECT order_id, line, article_id, shop_id, price FROM offer WHERE NOT error404 AND price <> 0 AND seconds <> 10")
def p01_equality_filters(v: Views) -> DataFrame:
    return without(v.offer.where(~F.col("error404") & (F.col("price") != 0)), seconds=10).select("order_id", "line", "article_id", "shop_id", "price")


@query("SELECT article_id, name FROM article WHERE package IN ('PROMO', 'LARGE') AND article_id IN (SELECT article_id FROM usable WHERE shop_id IN (1, 2, 3))")
def p02_membership(v: Views) -> DataFrame:
    return narrowed(v.article, package=["PROMO", "LARGE"]).join(narrowed(v.usable, shop_id=[1, 2, 3]), "article_id", "left_semi").select("article_id", "name")


@query("SELECT order_id, line, article_id, shop_id, CAST(ts AS DATE) AS day FROM offer WHERE ts BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '1999-03-31' AND price BETWEEN 500 AND 1500")
def p03_closed_ranges(v: Views) -> DataFrame:
    days = F.col("ts").between(F.lit("1999-01-01").cast("timestamp_ntz"), F.lit("1999-03-31").cast("timestamp_ntz"))
    return v.offer.where(days & F.col("price").between(500, 1500)).select("order_id", "line", "article_id", "shop_id", F.col("ts").cast("date").alias("day"))


@query("SELECT article_id FROM article WHERE degrees > 0 AND measure <= 12 AND units > 1")
def p04_comparisons(v: Views) -> DataFrame:
    return v.article.where((F.col("degrees") > 0) & (F.col("measure") <= 12) & (F.col("units") > 1)).select("article_id")


@query("SELECT article_id, name, brand FROM article WHERE lower(name) LIKE 'red%' AND contains(lower(name), 'g') AND lower(brand) = 'brand#5'")
def p05_text_predicates(v: Views) -> DataFrame:
    name = F.lower("name")
    return v.article.where(name.startswith("red") & name.contains("g") & (F.lower("brand") == "brand#5")).select("article_id", "name", "brand")


@query("SELECT o_orderkey AS order_id FROM orders LEFT JOIN offer ON o_orderkey = order_id WHERE order_id IS NULL")
def p06_null_test(v: Views) -> DataFrame:
    orders = v.table("orders").select(F.col("o_orderkey").alias("key"))
    joined = orders.join(v.offer.select("order_id").distinct(), F.col("key") == F.col("order_id"), "left")
    return joined.where(F.col("order_id").isNull()).select(F.col("key").alias("order_id"))


@query("SELECT count(*) AS n FROM offer o JOIN shop s ON o.shop_id = s.shop_id JOIN district d ON s.district_id = d.district_id WHERE d.region_id = 2 AND s.enabled")
def p07_traversal(v: Views) -> DataFrame:
    shops = v.shop.where("enabled").join(v.district.where("region_id = 2"), "district_id").select("shop_id")
    return v.offer.join(shops, "shop_id", "left_semi").agg(F.count("*").alias("n"))


@query("SELECT order_id, line, article_id, shop_id FROM offer WHERE year(ts) = 1999 AND month(ts) = 2")
def p08_date_parts(v: Views) -> DataFrame:
    return v.offer.where((F.year("ts") == 1999) & (F.month("ts") == 2)).select("order_id", "line", "article_id", "shop_id")


@query("SELECT article_id FROM article WHERE brand = 'Brand#9' AND size IN ('m', 'l') AND units = 2")
def p09_optional_filters(v: Views) -> DataFrame:
    return narrowed(v.article, brand="Brand#9", degrees=None, package=None, colour=[], size=["m", "l"], units=2).select("article_id")


#: Articles of a brand and pack count that one task holds against all others of these.
PART = 2_000


@query("SELECT a.article_id, b.article_id AS other_id FROM article a JOIN article b ON a.brand = b.brand AND a.units = b.units AND a.article_id <> b.article_id AND (a.degrees = 0 OR a.degrees = b.degrees) AND (a.size = 'xs' OR a.size = b.size) WHERE a.package = 'PROMO' AND b.package = 'PROMO'")
def p10_wildcard_predicate(v: Views) -> DataFrame:
    """A row's own blank value asks nothing of its partner."""
    a = v.article.where("package = 'PROMO'")
    b = a.select(F.col("article_id").alias("other_id"), F.col("brand").alias("b"), F.col("units").alias("u"), F.col("degrees").alias("d"), F.col("size").alias("s"))
    fits = (F.col("article_id") != F.col("other_id")) & ((F.col("degrees") == 0) | (F.col("degrees") == F.col("d"))) & ((F.col("size") == "xs") | (F.col("size") == F.col("s")))
    n = F.ceil(F.count("*") / PART).cast("int").alias("parts")
    sizes = small(a.groupBy(F.col("brand").alias("g"), F.col("units").alias("k")).agg(n))
    parts = max(int(v.spark.conf.get("spark.sql.shuffle.partitions")), sizes.agg(F.sum("parts")).first()[0] or 0)
    own = a.join(sizes, (F.col("brand") == F.col("g")) & (F.col("units") == F.col("k"))).withColumn("part", F.pmod(F.xxhash64("article_id"), F.col("parts")).cast("int")).drop("g", "k", "parts")
    every = b.join(sizes, (F.col("b") == F.col("g")) & (F.col("u") == F.col("k"))).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("g", "k", "parts")
    one, two = own.repartition(parts, "brand", "units", "part"), every.repartition(parts, "b", "u", "p").hint("merge")
    return one.join(two, (F.col("brand") == F.col("b")) & (F.col("units") == F.col("u")) & (F.col("part") == F.col("p")) & fits).select("article_id", "other_id")


@query("SELECT o.article_id, o.shop_id, a.brand, o.price, CAST(o.ts AS DATE) AS day, d.name AS district FROM offer o JOIN shop s ON o.shop_id = s.shop_id JOIN article a ON a.article_id = o.article_id JOIN district d ON d.district_id = s.district_id JOIN zone z ON z.region_id = d.region_id WHERE o.price > 0")
def offer_price_history_join(v: Views) -> DataFrame:
    """Five tables, the offers largest; the small sides are left to the optimizer's size checks."""
    places = v.shop.select("shop_id", "district_id").join(v.district.withColumnRenamed("name", "district"), "district_id").join(v.zone.select("region_id"), "region_id")
    rows = v.offer.where("price > 0").join(v.article.select("article_id", "brand"), "article_id").join(places, "shop_id")
    return rows.select("article_id", "shop_id", "brand", "price", F.col("ts").cast("date").alias("day"), "district")


@query("SELECT l.article_id, s.shop_id, s.name FROM listing l JOIN shop s ON s.shop_id = l.shop_id")
def j02_article_to_shops(v: Views) -> DataFrame:
    return v.listing.join(v.shop.select("shop_id", "name"), "shop_id").select("article_id", "shop_id", "name")


@query("SELECT a.article_id, count(DISTINCT u.shop_id) AS sellers FROM article a LEFT JOIN usable u ON u.article_id = a.article_id GROUP BY 1")
def sellers_per_article(v: Views) -> DataFrame:
    """Every article, with zero where nobody sells it."""
    sellers = v.usable.groupBy("article_id").agg(F.count_distinct("shop_id").alias("sellers"))
    return v.article.select("article_id").join(sellers, "article_id", "left").select("article_id", F.coalesce("sellers", F.lit(0)).cast("long").alias("sellers"))


@query("SELECT article_id, name FROM article WHERE article_id NOT IN (SELECT article_id FROM usable)")
def articles_without_sellers(v: Views) -> DataFrame:
    return v.article.join(v.usable.select("article_id"), "article_id", "left_anti").select("article_id", "name")


@query("SELECT brand, count(*) AS articles FROM article WHERE article_id IN (SELECT article_id FROM usable) GROUP BY 1")
def brands_with_articles(v: Views) -> DataFrame:
    return v.article.join(v.usable.select("article_id"), "article_id", "left_semi").groupBy("brand").agg(F.count("*").alias("articles"))


@query("SELECT a.article_id, b.article_id AS other_id, a.ean FROM article a JOIN article b ON a.ean = b.ean AND a.article_id < b.article_id")
def j10_same_barcode(v: Views) -> DataFrame:
    """Pairs of one barcode; a barcode has at most three articles here."""
    b = v.article.select(F.col("article_id").alias("other_id"), F.col("ean").alias("e"))
    return v.article.join(b, (F.col("ean") == F.col("e")) & (F.col("article_id") < F.col("other_id"))).select("article_id", "other_id", "ean")


@query("SELECT e.user_id, CASE WHEN d.agent IS NULL THEN FALSE ELSE TRUE END AS ignored, count(*) AS n FROM events e LEFT JOIN (SELECT * FROM (VALUES (3), (7), (11)) t(agent)) d ON e.user_id = d.agent GROUP BY 1, 2")
def j19_denylist(v: Views) -> DataFrame:
    deny = v.spark.createDataFrame([(3,), (7,), (11,)], "agent long")
    rows = v.table("events").join(F.broadcast(deny), F.col("user_id") == F.col("agent"), "left")  # three rows
    return rows.groupBy("user_id", F.col("agent").isNotNull().alias("ignored")).agg(F.count("*").alias("n"))


def redirected(brands: DataFrame, rules: DataFrame, rounds: int = 3) -> DataFrame:
    """(brand, target): brands followed along (brand, target) rules at most `rounds` times, so that a cycle ends."""
    out = brands.select("brand", F.col("brand").alias("target"))
    for _ in range(rounds):
        step = rules.select(F.col("brand").alias("_b"), F.col("target").alias("_t"))
        out = out.join(step, F.col("target") == F.col("_b"), "left").select("brand", F.coalesce("_t", "target").alias("target"))
    return out


@query("""WITH r AS (SELECT * FROM (VALUES ('Brand#1', 'Brand#2'), ('Brand#2', 'Brand#3'), ('Brand#5', 'Brand#6'), ('Brand#6', 'Brand#5')) t(b, t)), x AS (SELECT DISTINCT brand FROM article)
    SELECT x.brand, coalesce(r3.t, r2.t, r1.t, x.brand) AS target FROM x LEFT JOIN r r1 ON r1.b = x.brand LEFT JOIN r r2 ON r2.b = r1.t LEFT JOIN r r3 ON r3.b = r2.t""")
def j20_brand_redirects(v: Views) -> DataFrame:
    rules = v.spark.createDataFrame([("Brand#1", "Brand#2"), ("Brand#2", "Brand#3"), ("Brand#5", "Brand#6"), ("Brand#6", "Brand#5")], "brand string, target string")
    return redirected(v.article.select("brand").distinct(), rules)


@query("SELECT count(*) AS offers, count(DISTINCT article_id) AS articles, sum(CASE WHEN error404 THEN 1 ELSE 0 END)::BIGINT AS missing, round(avg(seconds), 6) AS seconds FROM offer")
def q10_offer_totals(v: Views) -> DataFrame:
    return v.offer.agg(F.count("*").alias("offers"), F.count_distinct("article_id").alias("articles"), F.count_if("error404").alias("missing"), F.round(F.avg("seconds"), 6).alias("seconds"))


@query("SELECT u.shop_id, count(*) AS n FROM usable u JOIN article a ON a.article_id = u.article_id WHERE a.brand = 'Brand#4' AND u.shop_id <> 7 GROUP BY 1")
def a04_brand_offers_per_shop(v: Views) -> DataFrame:
    return v.usable.where("shop_id <> 7").join(narrowed(v.article, brand="Brand#4"), "article_id", "left_semi").groupBy("shop_id").agg(F.count("*").alias("n"))


@query("SELECT ean, count(DISTINCT brand) AS brands, min(brand) AS first_brand, count(*) AS articles FROM article GROUP BY 1 HAVING count(DISTINCT brand) > 1")
def barcode_brand_conflicts(v: Views) -> DataFrame:
    each = v.article.groupBy("ean").agg(F.count_distinct("brand").alias("brands"), F.min("brand").alias("first_brand"), F.count("*").alias("articles"))
    return each.where("brands > 1")


@query("""WITH n AS (SELECT brand, count(*) AS articles FROM article GROUP BY 1), e AS (SELECT DISTINCT a.ean, a.brand, n.articles FROM article a JOIN n ON n.brand = a.brand)
    SELECT ean, arg_max(brand, (articles, brand)) AS main_brand, bool_and(articles > 75) AS all_large, NOT bool_or(articles > 75) AS none_large FROM e GROUP BY 1 HAVING count(*) > 1""")
def a09_barcode_main_brand(v: Views) -> DataFrame:
    """For barcodes with more than one brand the brand with most articles, and whether all or none of them are large."""
    sizes = v.article.groupBy("brand").agg(F.count("*").alias("articles"))
    each = v.article.select("ean", "brand").distinct().join(sizes, "brand")
    large = F.col("articles") > 75
    out = each.groupBy("ean").agg(F.max(F.struct("articles", "brand"))["brand"].alias("main_brand"), F.bool_and(large).alias("all_large"), (~F.bool_or(large)).alias("none_large"), F.count("*").alias("n"))
    return out.where("n > 1").drop("n")


@query("SELECT brand, name FROM (SELECT brand, name, count(*) OVER (PARTITION BY brand, name) AS n FROM article) WHERE n = 1")
def a11_singleton_names(v: Views) -> DataFrame:
    return v.article.groupBy("brand", "name").agg(F.count("*").alias("n")).where("n = 1").select("brand", "name")


@query("SELECT article_id, string_agg(CAST(shop_id AS VARCHAR), ',' ORDER BY shop_id) AS shops FROM listing GROUP BY 1")
def a17_shops_of_article(v: Views) -> DataFrame:
    shops = F.array_sort(F.collect_list("shop_id"))
    return v.listing.groupBy("article_id").agg(F.array_join(F.transform(shops, lambda x: x.cast("string")), ",").alias("shops"))


@query("SELECT article_id, shop_id, count(*) AS n FROM offer GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_sellers(v: Views) -> DataFrame:
    return v.offer.groupBy("article_id", "shop_id").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT brand, package, degrees, CAST(sum(price) AS BIGINT) AS total FROM usable u JOIN article a ON a.article_id = u.article_id GROUP BY 1, 2, 3")
def a21_sum_by_key(v: Views) -> DataFrame:
    return v.usable.join(v.article.select("article_id", "brand", "package", "degrees"), "article_id").groupBy("brand", "package", "degrees").agg(F.sum("price").alias("total"))


@query("SELECT * FROM (SELECT order_id, line, article_id, price, row_number() OVER (ORDER BY price, order_id, line, article_id) AS row_number FROM usable WHERE shop_id = 5) WHERE row_number BETWEEN 51 AND 100")
def offers_of_shop_page(v: Views) -> DataFrame:
    rows = v.usable.where("shop_id = 5").select("order_id", "line", "article_id", "price")
    return page(rows, 2, 50, *map(F.col, ("price", "order_id", "line", "article_id")))


@query("SELECT * FROM (SELECT order_id, line, article_id, price, row_number() OVER (ORDER BY price, order_id, line, article_id) AS row_number FROM usable WHERE shop_id = 5) WHERE row_number > (SELECT ((count(*) - 1) // 50) * 50 FROM usable WHERE shop_id = 5)")
def o05_last_page(v: Views) -> DataFrame:
    """A page beyond the end gives the last one."""
    rows = v.usable.where("shop_id = 5").select("order_id", "line", "article_id", "price")
    return page(rows, 10_000, 50, *map(F.col, ("price", "order_id", "line", "article_id")), past_end="last")


@query("""SELECT * FROM (SELECT 'brand' AS resource, brand AS id FROM (SELECT DISTINCT brand FROM article) ORDER BY id LIMIT 10 OFFSET 5) UNION ALL SELECT * FROM (SELECT 'corporation', CAST(region_id AS VARCHAR) FROM zone ORDER BY region_id LIMIT 10 OFFSET 2)
    UNION ALL SELECT * FROM (SELECT 'article', CAST(article_id AS VARCHAR) FROM article ORDER BY article_id LIMIT 100 OFFSET 50) UNION ALL SELECT * FROM (SELECT 'shop', CAST(shop_id AS VARCHAR) FROM shop ORDER BY shop_id LIMIT 100 OFFSET 5)
    UNION ALL SELECT * FROM (SELECT 'offer', order_id || '/' || line FROM offer ORDER BY order_id, line, article_id LIMIT 100 OFFSET 200) UNION ALL SELECT * FROM (SELECT 'seller', article_id || '/' || shop_id FROM listing ORDER BY article_id, shop_id LIMIT 100 OFFSET 200)
    UNION ALL SELECT * FROM (SELECT 'price', article_id || '/' || shop_id || '/' || CAST(ts AS DATE) || '/' || price FROM usable ORDER BY article_id, shop_id, ts, price LIMIT 100 OFFSET 200)""")
def snk05_limit_offset(v: Views) -> DataFrame:
    """A page of each of the seven listing resources: brands, corporations (here zones), articles, shops, offers, sellers and prices."""
    text = lambda *c: F.concat_ws("/", *[F.col(x).cast("string") for x in c])
    prices = v.usable.select("article_id", "shop_id", "ts", F.col("ts").cast("date").alias("day"), "price")
    pages = [
        ("brand", v.article.select("brand").distinct(), ["brand"], ["brand"], 10, 5), ("corporation", v.zone, ["region_id"], ["region_id"], 10, 2), ("article", v.article, ["article_id"], ["article_id"], 100, 50), ("shop", v.shop, ["shop_id"], ["shop_id"], 100, 5),
        ("offer", v.offer, ["order_id", "line", "article_id"], ["order_id", "line"], 100, 200), ("seller", v.listing, ["article_id", "shop_id"], ["article_id", "shop_id"], 100, 200), ("price", prices, ["article_id", "shop_id", "ts", "price"], ["article_id", "shop_id", "day", "price"], 100, 200),
    ]
    rows = [df.orderBy(*order).offset(skip).limit(n).select(F.lit(name).alias("resource"), text(*shown).alias("id")) for name, df, order, shown, n, skip in pages]
    return reduce(DataFrame.unionByName, rows)


@query("SELECT shop_id, n, row_number() OVER (ORDER BY n DESC, shop_id) AS position FROM (SELECT shop_id, count(*) AS n FROM offer GROUP BY 1)")
def o07_shops_by_size(v: Views) -> DataFrame:
    """One row a shop is ranked, after the aggregation."""
    counts = v.offer.groupBy("shop_id").agg(F.count("*").alias("n"))
    return counts.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "shop_id")).cast("long"))


@query("SELECT article_id, shop_id, order_id, line, CAST(ts AS DATE) AS day FROM offer WHERE ts <= TIMESTAMP '1999-06-01' ORDER BY ts, order_id, line, article_id, shop_id LIMIT 200")
def o08_work_queue(v: Views) -> DataFrame:
    """The stalest first."""
    old = v.offer.where(F.col("ts") <= F.lit("1999-06-01").cast("timestamp_ntz")).orderBy("ts", "order_id", "line", "article_id", "shop_id").limit(200)
    return old.select("article_id", "shop_id", "order_id", "line", F.col("ts").cast("date").alias("day"))
