"""The canonical tables of the price-comparison domain over the star schema, as DataFrames and as SQL.

Each view is defined twice, for Spark with DataFrame functions and for the comparison engine in SQL. Money is whole units;
a price of 0 means that there is none. What the star schema lacks (units, barcodes, markup) is made from its keys.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL of the views, in an order in which each uses earlier ones only.
SQL = {
    "shop": "SELECT s_suppkey AS shop_id, s_name AS name, CAST(s_nationkey AS BIGINT) AS district_id, s_acctbal >= 0 AS enabled FROM supplier",
    "district": "SELECT CAST(n_nationkey AS BIGINT) AS district_id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region_id FROM nation",
    "zone": "SELECT CAST(r_regionkey AS BIGINT) AS region_id, r_name AS name FROM region",
    "article": """SELECT p_partkey AS article_id, p_name AS name, p_brand AS brand, p_type AS package, CAST((p_size - 1) % 6 + 1 AS BIGINT) AS units,
        CAST(p_size AS DOUBLE) AS measure, CASE p_size % 5 WHEN 0 THEN 'ml' WHEN 1 THEN 'lt' WHEN 2 THEN 'gr' WHEN 3 THEN 'kg' ELSE 'cl' END AS unit,
        CASE WHEN p_size % 3 = 0 THEN 12.5 ELSE 0.0 END::DOUBLE AS degrees, CASE p_size // 10 WHEN 0 THEN 'xs' WHEN 1 THEN 's' WHEN 2 THEN 'm' WHEN 3 THEN 'l' ELSE 'xl' END AS size,
        split_part(p_name, ' ', 1) AS colour, CAST(780000000000 + p_partkey // 3 AS VARCHAR) AS ean FROM part""",
    "offer": """SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line, l_suppkey AS shop_id, l_partkey AS article_id, l_shipdate AS ts,
        CASE WHEN l_tax = 0 THEN 0 ELSE CAST(round(l_extendedprice / l_quantity) AS BIGINT) END AS price, l_returnflag = 'R' AS error404,
        CAST(l_quantity AS BIGINT) AS seconds FROM lineitem""",
    "usable": "SELECT o.* FROM offer o JOIN shop s ON o.shop_id = s.shop_id WHERE s.enabled AND o.price > 0 AND NOT o.error404",
    "listing": "SELECT DISTINCT article_id, shop_id FROM offer",
    "basket": """SELECT l_orderkey AS basket_id, p_brand || '/' || p_type || '/' || CAST(p_size // 10 AS VARCHAR) AS item, CAST(sum(l_quantity) AS BIGINT) AS quantity, max((p_size - 1) % 6 + 1)::BIGINT AS units
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "shelf": """SELECT u.shop_id, a.brand || '/' || a.package || '/' || CAST(CAST(a.measure AS INT) // 10 AS VARCHAR) AS item, min(u.price) AS price
        FROM usable u JOIN article a ON u.article_id = a.article_id GROUP BY 1, 2""",
    "delivery_area": """SELECT s.shop_id, e.district_id, 100 * (s.shop_id % 7) AS fee, 1000 * (s.shop_id % 5) AS minimum
        FROM shop s JOIN district d ON s.district_id = d.district_id JOIN district e ON d.region_id = e.region_id""",
    "product_text": """SELECT p_partkey AS article_id, p_name || ' ' || p_brand || ' ' || CAST(p_size AS VARCHAR)
        || CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE '' END || CASE p_size % 5 WHEN 0 THEN 'ml' WHEN 1 THEN 'lt' WHEN 2 THEN 'gr' WHEN 3 THEN 'kg' ELSE 'cl' END
        || CASE WHEN p_size % 3 = 0 THEN ' 12,5°' ELSE '' END || CASE p_partkey % 4 WHEN 0 THEN ' pack x ' || CAST((p_size - 1) % 6 + 1 AS VARCHAR) WHEN 1 THEN ' ' || CAST((p_size - 1) % 6 + 1 AS VARCHAR) || ' unidades' ELSE '' END AS text FROM part""",
}


def with_views(sql: str) -> str:
    """The SQL with the views that it needs defined before it."""
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in SQL:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                need(SQL[name])

    need(sql)
    if not needed:
        return sql
    body = sql.strip()
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in SQL if n in needed)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


def unit_of(size: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("ml", "lt", "gr", "kg", "cl"))), (size % 5 + 1).cast("int"))


def units_of(size: Column) -> Column:
    return ((size - 1) % 6 + 1).cast("long")


#: Rows of lists that one task puts together, so that its memory doesn't grow with the table.
ROWS = 250_000


class Views:
    """The views over the tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def shop(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("shop_id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("district_id"), (F.col("s_acctbal") >= 0).alias("enabled"))

    @cached_property
    def district(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").cast("long").alias("district_id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region_id"))

    @cached_property
    def zone(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").cast("long").alias("region_id"), F.col("r_name").alias("name"))

    @cached_property
    def article(self) -> DataFrame:
        size = F.col("p_size")
        letter = F.element_at(F.array(*map(F.lit, ("xs", "s", "m", "l", "xl"))), F.least(F.floor(size / 10), F.lit(4)).cast("int") + 1)
        return self.table("part").select(
            F.col("p_partkey").alias("article_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("package"),
            units_of(size).alias("units"), size.cast("double").alias("measure"), unit_of(size).alias("unit"), F.when(size % 3 == 0, 12.5).otherwise(0.0).alias("degrees"),
            letter.alias("size"), F.substring_index("p_name", " ", 1).alias("colour"), (F.lit(780000000000) + F.floor(F.col("p_partkey") / 3)).cast("string").alias("ean"),
        )

    @cached_property
    def offer(self) -> DataFrame:
        price = F.when(F.col("l_tax") == 0, 0).otherwise(F.round(F.col("l_extendedprice") / F.col("l_quantity")).cast("long"))
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_suppkey").alias("shop_id"), F.col("l_partkey").alias("article_id"),
            F.col("l_shipdate").alias("ts"), price.alias("price"), (F.col("l_returnflag") == "R").alias("error404"), F.col("l_quantity").cast("long").alias("seconds"),
        )

    @cached_property
    def usable(self) -> DataFrame:
        """Offers with a price, found, of enabled shops."""
        return self.offer.where((F.col("price") > 0) & ~F.col("error404")).join(self.shop.where("enabled").select("shop_id"), "shop_id", "left_semi")

    @cached_property
    def listing(self) -> DataFrame:
        return self.offer.select("article_id", "shop_id").distinct()

    def _item(self, brand: str, package: str, size: str) -> Column:
        return F.concat_ws("/", brand, package, F.floor(F.col(size) / 10).cast("long").cast("string"))

    @cached_property
    def basket(self) -> DataFrame:
        """Items of a basket with how many are wanted and the units that each holds, dealt by basket."""
        part = self.table("part").select("p_partkey", self._item("p_brand", "p_type", "p_size").alias("item"), units_of(F.col("p_size")).alias("units"))
        rows = self.table("lineitem").select(F.col("l_orderkey").alias("basket_id"), "l_partkey", F.col("l_quantity").cast("long").alias("quantity")).join(part, F.col("l_partkey") == F.col("p_partkey"))
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.table("lineitem").count() // ROWS))
        return rows.repartition(tasks, "basket_id").groupBy("basket_id", "item").agg(F.sum("quantity").alias("quantity"), F.max("units").alias("units"))

    @cached_property
    def shelf(self) -> DataFrame:
        """The cheapest price of each item in each shop."""
        item = self.article.select("article_id", self._item("brand", "package", "measure").alias("item"))
        return self.usable.join(item, "article_id").groupBy("shop_id", "item").agg(F.min("price").alias("price"))

    @cached_property
    def delivery_area(self) -> DataFrame:
        """A shop delivers to all districts of its region."""
        home, near = self.district.select("district_id", "region_id"), self.district.select(F.col("district_id").alias("to"), "region_id")
        rows = self.shop.join(home, "district_id").join(near, "region_id")
        return rows.select("shop_id", F.col("to").alias("district_id"), (F.col("shop_id") % 7 * 100).alias("fee"), (F.col("shop_id") % 5 * 1000).alias("minimum"))

    @cached_property
    def product_text(self) -> DataFrame:
        size, key = F.col("p_size"), F.col("p_partkey")
        units = units_of(size).cast("string")
        pack = F.when(key % 4 == 0, F.concat(F.lit(" pack x "), units)).when(key % 4 == 1, F.concat(F.lit(" "), units, F.lit(" unidades"))).otherwise("")
        text = F.concat("p_name", F.lit(" "), "p_brand", F.lit(" "), size.cast("string"), F.when(key % 2 == 0, " ").otherwise(""), unit_of(size), F.when(size % 3 == 0, " 12,5°").otherwise(""), pack)
        return self.table("part").select(key.alias("article_id"), text.alias("text"))
