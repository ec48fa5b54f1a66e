"""The rebuild that replaces what it rebuilds: rules with their counters, and the articles that they give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mining import mine_rules
from ..operators.rules import apply_counted
from ..operators.staged import Staging, StagedTables
from ..registry import query
from ..sources.views import Views
from .exchange import place
from .matching import KEY, RULES_SQL, _SIZED, rules_of, sized

RULES = "rule_id long, automatic boolean, hits long, " + ", ".join(f"{side}_{c} {t}" for side in ("if", "then") for c, t in zip(KEY, ("string", "string", "double", "double", "long", "string", "string")))
ARTICLES = "article_id long, copies long, " + ", ".join(f"{c} {t}" for c, t in zip(KEY, ("string", "string", "double", "double", "long", "string", "string")))


def rebuild_tables(tables: StagedTables, articles: DataFrame, batch: int) -> bool:
    """Puts new rules and articles in place of those of `tables` (rules, articles), both at once; False where the batch was applied before.

    Counters start at zero and count the rules that articles use, in chains of up to three. Automatic rules that nothing used go, others stay with zero.
    Articles of one key are one, with the lowest id.
    """
    if tables.applied("rebuild", batch):
        return False
    rules = tables.read("rules")
    used = Staging(tables.spark, "used").put(apply_counted(articles.select("article_id", *KEY), rules, KEY))
    hits = used.select(F.explode("rules_used").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n"))
    counted = rules.drop("hits").join(hits, "rule_id", "left").withColumn("hits", F.coalesce("n", F.lit(0)))
    merged = used.groupBy(*KEY).agg(F.min("article_id").alias("article_id"), F.count("*").alias("copies"))
    return tables.replace({"rules": counted.where("not automatic or hits > 0"), "articles": merged}, "rebuild", batch)


def rebuilt(v: Views) -> StagedTables:
    """The tables after a rebuild over all articles that is tried twice. The rules that were there have counters of an earlier one."""
    tables = StagedTables(v.spark, place(v, "rebuild"), {"rules": RULES, "articles": ARTICLES})
    rows = sized(v.article)
    old = rules_of(rows.select("article_id", *KEY)).withColumn("automatic", F.length("if_name") % 2 == 0).withColumn("hits", F.lit(99))
    tables.replace({"rules": old})
    for _ in range(2):
        rebuild_tables(tables, rows, 1)
    return tables


_OTHERS = "name, degrees, measure, package, size"
_MATCH = "x.brand = r.if_brand AND lower(x.name) = lower(r.name) AND x.degrees = r.degrees AND x.measure = r.measure AND x.units = r.if_units AND x.package = r.package AND x.size IS NOT DISTINCT FROM r.size"


def _round(n: int) -> str:
    return f"""m{n} AS (SELECT x.*, r.then_brand FROM a{n - 1} x LEFT JOIN rules r ON {_MATCH}),
    a{n} AS (SELECT article_id, coalesce(then_brand, brand) AS brand, CASE WHEN then_brand IS NULL THEN units ELSE 0 END AS units, {_OTHERS} FROM m{n})"""


_ROUNDS = f"WITH rules AS ({RULES_SQL}), a0 AS (SELECT article_id, brand, units, {_OTHERS} FROM ({_SIZED})), {_round(1)}, {_round(2)}, {_round(3)}"


@query(f"""{_ROUNDS}, h AS (SELECT brand, units, {_OTHERS}, count(*) AS hits FROM ({" UNION ALL ".join(f"SELECT brand, units, {_OTHERS} FROM m{n} WHERE then_brand IS NOT NULL" for n in (1, 2, 3))}) GROUP BY ALL)
    SELECT r.if_brand AS brand, CAST(r.if_units AS BIGINT) AS units, {", ".join(f"r.{c.strip()}" for c in _OTHERS.split(","))}, coalesce(x.hits, 0) AS hits FROM rules r LEFT JOIN h x ON {_MATCH} WHERE length(r.name) % 2 <> 0 OR x.hits > 0""")
def mut04_rules_replaced(v: Views) -> DataFrame:
    """Rules after a rebuild: counters of this run alone, and no automatic rule that nothing used."""
    return rebuilt(v).read("rules").select(*[F.col(f"if_{c}").alias(c) for c in KEY], "hits")


@query(f"{_ROUNDS} SELECT min(article_id) AS article_id, count(*) AS copies, brand, CAST(units AS BIGINT) AS units, {_OTHERS} FROM a3 GROUP BY ALL")
def mut04_articles_replaced(v: Views) -> DataFrame:
    """Articles after the same rebuild, one for each key."""
    return rebuilt(v).read("articles")


def single_sellers(v: Views) -> DataFrame:
    """Articles with the shops that sell them cheapest, so that few are sold together, and attributes that many lack."""
    least = v.usable.groupBy("article_id").agg(F.min("price").alias("least"))
    shops = v.usable.join(least, "article_id").where("price = least").groupBy("article_id").agg(F.array_sort(F.collect_set("shop_id")).alias("shops"))
    rows = v.article.withColumn("measure", F.floor(F.col("measure") / 20).cast("double")).withColumn("size", F.when(F.col("size") != "xs", F.col("size"))).withColumn("package", F.when(F.col("package") != "PROMO", F.col("package")))
    return rows.join(shops, "article_id")


@query()
def m09_rules_mined(v: Views) -> DataFrame:
    """Rules out of articles whose shops are those that sell them cheapest, by components of what could merge."""
    return mine_rules(single_sellers(v))
