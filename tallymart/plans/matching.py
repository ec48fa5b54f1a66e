"""Entity resolution: rewrite rules, article identity, fuzzy matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import similarity, token_sorted
from ..operators.mining import mine_rules
from ..operators.rules import apply_rules, changed, rule_upsert as upsert_rules
from ..operators.similar import best_names, pairs_of_rows, similar_names
from ..operators.staged import Staging
from ..operators.tables import overlapping
from ..registry import query
from ..sources.views import Views

KEY = ("brand", "name", "degrees", "measure", "units", "package", "size")


def whole_listing(v: Views) -> DataFrame:
    """Which shops sell an article at any price."""
    return v.usable.select("article_id", "shop_id").distinct()


#: Steps that a key takes: brand, units and size from one value to another. A chain of four and a cycle.
STEPS = (("chain", None, "Brand#A"), ("chain", "Brand#A", "Brand#B"), ("chain", "Brand#B", "Brand#C"), ("chain", "Brand#C", "Brand#D"), ("cycle", None, "Brand#X"), ("cycle", "Brand#X", "Brand#Y"), ("cycle", "Brand#Y", "Brand#X"))


def sized(articles: DataFrame) -> DataFrame:
    """The articles with no size in place of the smallest, as a column that may be null."""
    return articles.withColumn("size", F.when(F.col("size") != "xs", F.col("size")))


def rules_of(articles: DataFrame) -> DataFrame:
    """Rules for the keys of some articles: chains of one to four rules, and cycles, over all seven columns; null matches null."""
    kind = F.when(F.col("article_id") % 3 == 0, "chain").when(F.col("article_id") % 3 == 1, "cycle")
    keys = articles.groupBy(*KEY).agg(F.min("article_id").alias("article_id")).withColumn("kind", kind).where("kind is not null")
    steps = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).cast("string").alias("a"), F.lit(b).alias("b"), F.lit(n).alias("n")) for n, (k, a, b) in enumerate(STEPS)])
    rows = keys.withColumn("s", F.explode(steps)).where("s.kind = kind")
    before, after = F.coalesce("s.a", "brand"), F.col("s.b")
    same = [c for c in KEY if c not in ("brand", "units")]
    return rows.select(
        (F.col("article_id") * 10 + F.col("s.n")).alias("rule_id"), before.alias("if_brand"), F.when(F.col("s.a").isNull(), F.col("units")).otherwise(F.lit(0)).cast("long").alias("if_units"), after.alias("then_brand"), F.lit(0).cast("long").alias("then_units"),
        *[F.col(c).alias(f"if_{c}") for c in same], *[F.col(c).alias(f"then_{c}") for c in same],
    ).dropDuplicates([f"if_{c}" for c in KEY])


_SIZED = "SELECT article_id, brand, name, degrees, measure, units, package, CASE WHEN size = 'xs' THEN NULL ELSE size END AS size FROM article"
_RULES = f"""SELECT DISTINCT coalesce(s.a, k.brand) AS if_brand, s.b AS then_brand, CASE WHEN s.a IS NULL THEN k.units ELSE 0 END AS if_units, name, degrees, measure, package, size
    FROM (SELECT brand, name, degrees, measure, units, package, size, min(article_id) % 3 AS m FROM ({_SIZED}) GROUP BY ALL) k
    JOIN (VALUES {", ".join(f"({0 if k == 'chain' else 1}, {'NULL' if a is None else repr(a)}, {b!r})" for k, a, b in STEPS)}) s(m, a, b) ON s.m = k.m"""


def _step(source: str) -> str:
    return f"""SELECT x.article_id, coalesce(r.then_brand, x.brand) AS brand, x.name, x.degrees, x.measure, CASE WHEN r.then_brand IS NULL THEN x.units ELSE 0 END AS units, x.package, x.size, x.used + CASE WHEN r.then_brand IS NULL THEN 0 ELSE 1 END AS used
    FROM ({source}) x LEFT JOIN rules r ON x.brand = r.if_brand AND lower(x.name) = lower(r.name) AND x.degrees = r.degrees AND x.measure = r.measure AND x.units = r.if_units AND x.package = r.package AND x.size IS NOT DISTINCT FROM r.size"""


#: The rules, and the articles after three rounds of them.
RULES_SQL, USED_SQL = _RULES, _step(_step(_step(f"SELECT *, 0 AS used FROM ({_SIZED})")))


@query(f"WITH rules AS ({RULES_SQL}) SELECT article_id, brand, name, degrees, measure, CAST(units AS BIGINT) AS units, package, size, CAST(used AS BIGINT) AS used FROM ({USED_SQL})")
def rules_apply_3(v: Views) -> DataFrame:
    """Rules over the seven columns of an article's key in three rounds, so a chain of four stops before its end and a cycle ends."""
    rows = sized(v.article).select("article_id", *KEY)
    return apply_rules(rows, rules_of(rows), KEY, rounds=3)


@query("SELECT min(article_id) AS article_id, brand, name, measure, degrees, units, package, size, count(*) AS copies FROM article GROUP BY ALL")
def m02_article_identity(v: Views) -> DataFrame:
    """One article for each key of seven columns, the lowest id of them."""
    return v.article.groupBy("brand", "name", "measure", "degrees", "units", "package", "size").agg(F.min("article_id").alias("article_id"), F.count("*").alias("copies"))


@query("WITH rules AS (SELECT DISTINCT brand, name, degrees, size FROM article WHERE package = 'PROMO' AND units = 1) SELECT a.article_id FROM article a JOIN rules r ON a.brand = r.brand AND a.name = r.name AND (a.degrees IS DISTINCT FROM r.degrees OR a.size IS DISTINCT FROM r.size) GROUP BY 1")
def rule_diff(v: Views) -> DataFrame:
    """Articles of which a column differs from that of a promoted article with the same brand and name."""
    rules = v.article.where("package = 'PROMO' and units = 1").select("brand", "name", F.col("degrees").alias("new_degrees"), F.col("size").alias("new_size")).distinct()
    rows = v.article.join(rules, ["brand", "name"])
    return rows.where(changed(("degrees", "new_degrees"), ("size", "new_size"))).select("article_id").distinct()


@query("""WITH o AS (SELECT brand, name, max(degrees) AS degrees, max(units) AS units FROM article WHERE package <> 'PROMO' GROUP BY 1, 2), n AS (SELECT brand, name, min(degrees) AS degrees, max(units) AS units FROM article WHERE package <> 'LARGE' GROUP BY 1, 2)
    SELECT coalesce(n.brand, o.brand) AS brand, coalesce(n.name, o.name) AS name, CASE WHEN n.brand IS NULL THEN o.degrees WHEN o.brand IS NULL THEN n.degrees WHEN n.degrees <> 0 THEN n.degrees ELSE o.degrees END AS degrees,
    CASE WHEN n.brand IS NULL THEN o.units WHEN o.brand IS NULL THEN n.units WHEN n.units <> 0 THEN n.units ELSE o.units END AS units FROM o FULL OUTER JOIN n ON o.brand = n.brand AND o.name = n.name""")
def rule_upsert(v: Views) -> DataFrame:
    """Rules put in by key; a new zero doesn't overwrite."""
    old = v.article.where("package <> 'PROMO'").groupBy("brand", "name").agg(F.max("degrees").alias("degrees"), F.max("units").alias("units"))
    new = v.article.where("package <> 'LARGE'").groupBy("brand", "name").agg(F.min("degrees").alias("degrees"), F.max("units").alias("units"))
    return upsert_rules(old, new, ["brand", "name"])


def best_other(rows: DataFrame, by: list[str], least: int) -> DataFrame:
    """(article_id, other_id, score) of the most similar other article (by, name, article_id) of its group, the lowest id of equals.

    An article's namesakes are known from the two lowest ids of its name; the other names are compared once each.
    """
    first = rows.groupBy(*by, "name").agg(F.min("article_id").alias("first"))
    second = rows.join(first, [*by, "name"]).where("article_id > first").groupBy(*by, "name").agg(F.min("article_id").alias("second"))
    named = first.join(second, [*by, "name"], "left")
    alike = similar_names(first, first, by, least).where("x <> y").join(first.withColumnRenamed("name", "y"), [*by, "y"])
    top = alike.groupBy(*by, F.col("x").alias("name")).agg(F.max(F.struct("score", (-F.col("first")).alias("m"))).alias("top"))
    twin = F.when(F.col("article_id") != F.col("first"), F.col("first")).otherwise(F.col("second"))
    own = F.when(twin.isNotNull(), F.struct(F.lit(100).cast("long").alias("score"), (-twin).alias("m")))
    best = rows.join(named, [*by, "name"]).join(top, [*by, "name"], "left").withColumn("b", F.greatest("top", own)).where("b is not null")
    return best.select("article_id", (-F.col("b.m")).alias("other_id"), F.col("b.score").alias("score"))


_SIM = "round(100.0::DOUBLE * (1.0::DOUBLE - levenshtein(x, y) / CAST(greatest(length(x), length(y), 1) AS DOUBLE)))"
_SORTED = "array_to_string(list_sort(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' ')), ' ')"


@query(f"""SELECT article_id, other_id, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, other_id) AS n FROM (SELECT article_id, other_id, {_SIM} AS score FROM (
    SELECT a.article_id, b.article_id AS other_id, {_SORTED.format('a.name')} AS x, {_SORTED.format('b.name')} AS y FROM article a JOIN article b ON a.brand = b.brand AND a.units = b.units AND a.package = b.package AND a.article_id <> b.article_id)) WHERE score >= 60) WHERE n = 1""")
def fuzzy_best_match(v: Views) -> DataFrame:
    """The most similar article of the same brand, units and package, the lowest id of equals."""
    rows = v.article.select("article_id", "brand", "units", "package", token_sorted(F.col("name")).alias("name"))
    return best_other(rows, ["brand", "units", "package"], 60)


@query(f"""SELECT article_id, package, new_package, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, other_id) AS n FROM (SELECT article_id, other_id, package, new_package, {_SIM} AS score FROM (
    SELECT a.article_id, b.article_id AS other_id, a.package, b.package AS new_package, {_SORTED.format('a.name')} AS x, {_SORTED.format('b.name')} AS y FROM article a JOIN article b ON a.brand = b.brand AND a.units = b.units AND a.size = b.size AND a.degrees = b.degrees
    WHERE a.package = 'PROMO' AND b.package <> 'PROMO')) WHERE score > 70) WHERE n = 1""")
def fuzzy_fill_package(v: Views) -> DataFrame:
    """A missing package (here PROMO) from the most similar article with equal other attributes, as one pass over sets."""
    by = ["brand", "units", "size", "degrees"]
    rows = v.article.select("article_id", *by, "package", token_sorted(F.col("name")).alias("name"))
    blank, known = rows.where("package = 'PROMO'"), rows.where("package <> 'PROMO'")
    best = best_names(blank, known, by, 71, "article_id").withColumnRenamed("x", "name")
    filled = blank.join(best, [*by, "name"]).join(known.select(F.col("article_id").alias("id"), F.col("package").alias("new_package")), "id")
    return filled.select("article_id", "package", "new_package", "score")


@query("""WITH s AS (SELECT article_id, list(DISTINCT shop_id) AS shops FROM usable GROUP BY 1), f AS (SELECT ean, min(article_id) AS lead FROM article GROUP BY 1),
    m AS (SELECT a.article_id, a.ean, a.degrees, a.measure, f.lead, x.shops FROM article a JOIN f ON f.ean = a.ean LEFT JOIN s x ON x.article_id = a.article_id LEFT JOIN s y ON y.article_id = f.lead WHERE a.article_id = f.lead OR (x.shops IS NOT NULL AND y.shops IS NOT NULL AND NOT list_has_any(x.shops, y.shops))),
    n AS (SELECT ean, count(DISTINCT shop) AS sellers FROM (SELECT ean, unnest(shops) AS shop FROM m) GROUP BY 1)
    SELECT m.ean, m.lead AS article_id, max(m.degrees) AS degrees, max(m.measure) AS measure, any_value(l.name) AS name, count(*) AS merged, any_value(n.sellers) AS sellers FROM m JOIN article l ON l.article_id = m.lead LEFT JOIN n ON n.ean = m.ean GROUP BY 1, 2 HAVING count(*) > 1""")
def ean_merge(v: Views) -> DataFrame:
    """Articles of one barcode that no shop sells beside the first of them, as one: filled degrees, the larger measure, the first name, the union of sellers."""
    shops = v.usable.groupBy("article_id").agg(F.collect_set("shop_id").alias("shops"))
    rows = v.article.select("article_id", "ean", "name", "degrees", "measure").join(shops, "article_id", "left").withColumn("shops", F.coalesce("shops", F.array().cast("array<bigint>")))
    first = F.min(F.struct("article_id", "name", "shops")).over(Window.partitionBy("ean"))  # a barcode has few articles
    joined = rows.withColumn("lead", first).where((F.col("article_id") == F.col("lead.article_id")) | ~overlapping(F.col("shops"), F.col("lead.shops")))
    merged = joined.groupBy("ean").agg(
        F.first("lead.article_id").alias("article_id"), F.max("degrees").alias("degrees"), F.max("measure").alias("measure"), F.first("lead.name").alias("name"), F.count("*").alias("merged"),
        F.size(F.array_distinct(F.flatten(F.collect_list("shops")))).cast("long").alias("sellers"),
    )
    return merged.where("merged > 1")


@query("""WITH s AS (SELECT article_id, list(DISTINCT shop_id) AS shops FROM usable GROUP BY 1) SELECT a.article_id, b.article_id AS other_id FROM article a JOIN article b ON a.brand = b.brand AND a.name = b.name AND a.article_id < b.article_id
    LEFT JOIN s x ON x.article_id = a.article_id LEFT JOIN s y ON y.article_id = b.article_id WHERE x.shops IS NOT NULL AND y.shops IS NOT NULL AND NOT list_has_any(x.shops, y.shops)""")
def disjoint_sellers(v: Views) -> DataFrame:
    """Articles with the same brand and name that no shop sells both of; an article without sellers counts as overlapping."""
    shops = whole_listing(v).groupBy("article_id").agg(F.collect_set("shop_id").alias("shops"))
    rows = v.article.select("article_id", "brand", "name").join(shops, "article_id", "left").withColumn("shops", F.coalesce("shops", F.array().cast("array<bigint>")))
    other = rows.select(F.col("article_id").alias("other_id"), "brand", "name", F.col("shops").alias("other_shops"))
    pairs = rows.join(other, ["brand", "name"]).where("article_id < other_id")
    return pairs.where(~overlapping(F.col("shops"), F.col("other_shops"))).select("article_id", "other_id")


@query("""SELECT a.article_id, a.brand, 'Brand#99' AS then_brand, a.name FROM article a WHERE a.brand IN ('Brand#10', 'Brand#11')""")
def m13_brand_rule_expansion(v: Views) -> DataFrame:
    """A redirect of a brand as a rule for each of its articles."""
    redirects = v.spark.createDataFrame([("Brand#10", "Brand#99"), ("Brand#11", "Brand#99")], "brand string, then_brand string")
    return v.article.join(F.broadcast(redirects), "brand").select("article_id", "brand", "then_brand", "name")  # two rows


@query("SELECT DISTINCT lower(brand) AS brand FROM article WHERE NOT regexp_matches(brand, '^[0-9]+$') AND lower(brand) NOT IN ('brand#1', 'brand#2')")
def m17_brand_bootstrap(v: Views) -> DataFrame:
    known = v.spark.createDataFrame([("brand#1",), ("brand#2",)], "brand string")
    return v.article.where(~F.col("brand").rlike("^[0-9]+$")).select(F.lower("brand").alias("brand")).distinct().join(known, "brand", "left_anti")


_ONCE = "SELECT brand, package, degrees FROM article GROUP BY 1, 2, 3 HAVING count(*) = 1"


@query(f"""SELECT article_id, new_degrees, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, other_id) AS n FROM (SELECT article_id, other_id, new_degrees, {_SIM} AS score FROM (
    SELECT a.article_id, b.article_id AS other_id, b.degrees AS new_degrees, {_SORTED.format('a.name')} AS x, {_SORTED.format('b.name')} AS y FROM article a JOIN ({_ONCE}) o ON o.brand = a.brand AND o.package = a.package AND o.degrees = a.degrees
    JOIN article b ON a.brand = b.brand AND a.measure // 10 = b.measure // 10 AND a.units = b.units AND b.degrees <> 0 WHERE a.degrees = 0)) WHERE score > 0) WHERE n = 1""")
def m10_degrees_repaired(v: Views) -> DataFrame:
    """Articles without degrees, where that stands once in their brand and package, with those of the most similar name of the same brand, units and class of measure."""
    once = v.article.groupBy("brand", "package", "degrees").agg(F.count("*").alias("n")).where("n = 1 and degrees = 0").select("brand", "package", "degrees")
    by = ["brand", "class", "units"]
    keyed = v.article.select("article_id", "brand", "package", "degrees", "units", F.floor(F.col("measure") / 10).alias("class"), token_sorted(F.col("name")).alias("name"))
    rows, other = keyed.join(once, ["brand", "package", "degrees"]), keyed.where("degrees <> 0")
    best = best_names(rows, other, by, 1, "article_id").withColumnRenamed("x", "name")
    filled = rows.join(best, [*by, "name"]).join(other.select(F.col("article_id").alias("id"), F.col("degrees").alias("new_degrees")), "id")
    return filled.select("article_id", "new_degrees", "score")


@query()
def mine_rules_per_brand(v: Views) -> DataFrame:
    """Rules mined by the whole sequence of passes, by components of articles that could merge."""
    shops = v.usable.groupBy("article_id").agg(F.array_sort(F.collect_set("shop_id")).alias("shops"))
    rows = v.article.withColumn("measure", F.floor(F.col("measure") / 20)).withColumn("size", F.when(F.col("size") != "xs", F.col("size")))
    return mine_rules(rows.join(shops, "article_id", "left"))


@query("""SELECT order_id, line, o.article_id, shop_id, m.article_id AS identity FROM offer o JOIN article a ON a.article_id = o.article_id JOIN (SELECT min(article_id) AS article_id, brand, name, measure, degrees, units, package, size FROM article GROUP BY ALL) m
    ON m.brand = a.brand AND m.name = a.name AND m.measure = a.measure AND m.degrees = a.degrees AND m.units = a.units AND m.package = a.package AND m.size = a.size WHERE o.article_id <> m.article_id""")
def q23_offers_to_identities(v: Views) -> DataFrame:
    """Offers whose article has a twin with a lower id, linked to that."""
    key = Window.partitionBy("brand", "name", "measure", "degrees", "units", "package", "size")
    moved = v.article.withColumn("identity", F.min("article_id").over(key)).where("identity <> article_id").select("article_id", "identity")
    return v.offer.join(moved, "article_id").select("order_id", "line", "article_id", "shop_id", "identity")


def rebuild(articles: DataFrame, listing: DataFrame, redirects: DataFrame, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """The whole rebuild: redirected brands, one article for each key, mined rules applied along chains, listings moved, and what nothing
    sells dropped. Gives (article_id, brand, name, sellers) and the rules that were used, with their hits."""
    from .catalog import redirected

    brands = redirected(articles.select("brand").distinct(), redirects)
    rows = articles.join(brands, "brand").drop("brand").withColumnRenamed("target", "brand")
    key = Window.partitionBy("brand", "name", "measure", "degrees", "units", "package", "size")
    named = rows.withColumn("identity", F.min("article_id").over(key))
    shops = listing.join(named.select("article_id", "identity"), "article_id").groupBy(F.col("identity").alias("article_id")).agg(F.array_sort(F.collect_set("shop_id")).alias("shops"))
    spark = articles.sparkSession
    kept = Staging(spark, "kept").put(named.where("article_id = identity").join(shops, "article_id", "left"))
    rules = Staging(spark, "rules").put(mine_rules(kept))
    steps = rules.select(F.col("article_id").alias("from"), F.col("into_id").alias("into"))
    ends = rules.select("article_id", F.col("into_id").alias("to"))
    for _ in range(rounds - 1):
        ends = ends.join(steps, F.col("to") == F.col("from"), "left").select("article_id", F.coalesce("into", "to").alias("to"))
    final = kept.where("shops is not null").select("article_id", "shops").join(ends, "article_id", "left").withColumn("to", F.coalesce("to", "article_id"))
    sold = final.groupBy(F.col("to").alias("article_id")).agg(F.size(F.array_distinct(F.flatten(F.collect_list("shops")))).cast("long").alias("sellers"))  # an article's shops
    hits = final.where("article_id <> to").select("article_id", F.size("shops").cast("long").alias("hits"))
    return kept.join(sold, "article_id").select("article_id", "brand", "name", "sellers"), rules.join(hits, "article_id")


@query()
def m14_full_rebuild(v: Views) -> DataFrame:
    """Articles after the whole rebuild; no shop's listing is lost."""
    rows = v.article.withColumn("measure", F.floor(F.col("measure") / 20)).withColumn("size", F.when(F.col("size") != "xs", F.col("size")))
    redirects = v.spark.createDataFrame([("Brand#10", "Brand#9"), ("Brand#11", "Brand#9")], "brand string, target string")
    return rebuild(rows, whole_listing(v), redirects)[0]


#: How alike names and prices are before a name that stands once is taken for a misspelling.
NAMES, PRICES = 55, 40


@query(f"""WITH s AS (SELECT article_id, list(DISTINCT shop_id) AS shops, CAST(min(price) AS VARCHAR) AS price FROM usable GROUP BY 1), o AS (SELECT brand, name FROM article GROUP BY 1, 2 HAVING count(*) = 1),
    p AS (SELECT a.article_id, b.article_id AS other_id, b.name AS new_name, {_SORTED.format('a.name')} AS x, {_SORTED.format('b.name')} AS y, t.price AS q, u.price AS r FROM article a JOIN o ON o.brand = a.brand AND o.name = a.name
    JOIN article b ON b.brand = a.brand AND b.units = a.units AND b.degrees = a.degrees AND b.name <> a.name JOIN s t ON t.article_id = a.article_id JOIN s u ON u.article_id = b.article_id WHERE NOT list_has_any(t.shops, u.shops))
    SELECT article_id, new_name, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, other_id) AS n FROM (SELECT article_id, other_id, new_name, {_SIM} AS score,
    round(100.0::DOUBLE * (1.0::DOUBLE - levenshtein(q, r) / CAST(greatest(length(q), length(r), 1) AS DOUBLE))) AS near FROM p)) WHERE n = 1 AND score >= {NAMES} AND near > {PRICES}""")
def m11_names_repaired(v: Views) -> DataFrame:
    """Names that stand once in a brand, with the most similar one of an article of equal units and degrees that no shop sells beside it and whose price is written alike."""
    sold = v.usable.groupBy("article_id").agg(F.collect_set("shop_id").alias("shops"), F.min("price").cast("string").alias("price"))
    once = v.article.groupBy("brand", "name").agg(F.count("*").alias("n")).where("n = 1").select("brand", "name")
    keyed = v.article.join(sold, "article_id").select("article_id", "brand", "units", "degrees", "name", "shops", "price")
    return names_repaired(keyed, once, NAMES, PRICES)


def names_repaired(keyed: DataFrame, once: DataFrame, least: int = 90, least_price: int = 90) -> DataFrame:
    """(article_id, new_name, score) of articles (brand, units, degrees, name, shops, price as text) whose (brand, name) is in `once`.

    The levels that a catalogue is repaired with are the defaults. Only names that are alike by `least` are ever joined with articles.
    """
    by = ["brand", "units", "degrees"]
    rows = keyed.withColumn("x", token_sorted(F.col("name")))
    single = rows.join(once, ["brand", "name"])
    alike = similar_names(single.select(*by, F.col("x").alias("name")), rows.select(*by, F.col("x").alias("name")), by, least)
    other = rows.select(*by, F.col("article_id").alias("other_id"), F.col("name").alias("new_name"), F.col("shops").alias("other_shops"), F.col("price").alias("other_price"), F.col("x").alias("y"))
    pairs = single.join(alike, [*by, "x"]).join(other, [*by, "y"]).where((F.col("name") != F.col("new_name")) & ~overlapping(F.col("shops"), F.col("other_shops")))
    scored = pairs.select("article_id", "other_id", "new_name", "score", similarity(F.col("price"), F.col("other_price")).alias("near"))
    best = scored.groupBy("article_id").agg(F.max(F.struct("score", (-F.col("other_id")).alias("m"), "new_name", "near")).alias("b")).where(F.col("b.near") > least_price)
    return best.select("article_id", "b.new_name", "b.score")


@query(f"""SELECT article_id, other_id, CAST(score AS BIGINT) AS score FROM (SELECT article_id, other_id, {_SIM} AS score FROM (SELECT a.article_id, b.article_id AS other_id, {_SORTED.format('a.name')} AS x, {_SORTED.format('b.name')} AS y FROM article a JOIN article b ON a.brand = b.brand AND a.units = b.units AND a.article_id < b.article_id)) WHERE score >= 90""")
def m05_similar_pairs(v: Views) -> DataFrame:
    """Pairs within a brand and pack count whose names are nearly the same."""
    by = ["brand", "units"]
    rows = v.article.select("article_id", *by, token_sorted(F.col("name")).alias("name"))
    alike = similar_names(rows, rows, by, 90)
    return pairs_of_rows(rows, alike, by, "article_id", "other_id")
