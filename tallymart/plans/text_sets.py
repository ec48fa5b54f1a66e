"""Set operations over the words and elements of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.views import Views


def word_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word): the distinct words of each row."""
    return df.select(key, F.explode(F.array_distinct(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))).alias("word"))


_WORDS = "list_distinct([w for w in regexp_split_to_array(text, '\\s+') if w <> ''])"


@query(f"SELECT a.doc_id, w AS word FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) b WHERE b.doc_id = a.doc_id + 1 AND b.w = a.w)")
def word_difference(v: Views) -> DataFrame:
    """Words of a text that the next text doesn't have."""
    docs = v.table("documents")
    own = word_rows(docs, "doc_id", "text")
    other = word_rows(docs, "doc_id", "text").select((F.col("doc_id") - 1).alias("doc_id"), "word")
    return own.join(other, ["doc_id", "word"], "left_anti")


@query("""WITH w AS (SELECT DISTINCT brand, name FROM article) SELECT x.name FROM (SELECT name FROM w WHERE brand = 'Brand#1' EXCEPT SELECT name FROM w WHERE brand = 'Brand#2') x""")
def u01_except(v: Views) -> DataFrame:
    """Names that one brand has and another hasn't."""
    names = lambda b: v.article.where(F.col("brand") == b).select("name")
    return names("Brand#1").subtract(names("Brand#2"))


@query("""WITH a AS (SELECT DISTINCT name FROM article WHERE brand = 'Brand#1'), b AS (SELECT DISTINCT name FROM article WHERE brand = 'Brand#2')
    SELECT name, 'left' AS side FROM a WHERE name NOT IN (SELECT name FROM b) UNION ALL SELECT name, 'right' AS side FROM b WHERE name NOT IN (SELECT name FROM a)""")
def u02_symmetric_difference(v: Views) -> DataFrame:
    names = lambda b: v.article.where(F.col("brand") == b).select("name")
    a, b = names("Brand#1"), names("Brand#2")
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


@query("""SELECT page_id, pos, a AS own, b AS other FROM (SELECT p.page_id, i AS pos, regexp_extract_all(p.html, '<a [^>]*>([^<]*)</a>', 1)[i] AS a, regexp_extract_all(q.html, '<a [^>]*>([^<]*)</a>', 1)[i] AS b
    FROM pages p JOIN pages q ON q.page_id = p.page_id + 1, LATERAL (SELECT unnest(generate_series(1, len(regexp_extract_all(p.html, '<a [^>]*>([^<]*)</a>', 1)))) AS i) n) WHERE a <> b""")
def u04_positional_diff(v: Views) -> DataFrame:
    """Texts of links that differ from those at the same place of the next page."""
    texts = F.regexp_extract_all(F.col("html"), F.lit("<a [^>]*>([^<]*)</a>"), 1)
    pages = v.table("pages").select("page_id", texts.alias("own"))
    other = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("own").alias("next"))
    both = pages.join(other, "page_id").select("page_id", F.posexplode(F.arrays_zip("own", "next")).alias("pos", "z"))
    return both.where("z.own <> z.next").select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("z.own").alias("own"), F.col("z.next").alias("other"))


@query("SELECT brand, string_agg(DISTINCT package, ',' ORDER BY package) AS packages FROM article GROUP BY 1")
def u05_union_of_lists(v: Views) -> DataFrame:
    return v.article.groupBy("brand").agg(F.array_join(F.array_sort(F.collect_set("package")), ",").alias("packages"))


@query("SELECT 'shop' AS kind, count(*) AS n FROM shop UNION ALL SELECT 'article' AS kind, count(*) AS n FROM article UNION ALL SELECT 'district' AS kind, count(*) AS n FROM district")
def u07_union(v: Views) -> DataFrame:
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in (("shop", v.shop), ("article", v.article), ("district", v.district))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query()
def u03_text_path_differences(v: Views) -> DataFrame:
    """(page_id, path, own, other): texts that stand at the same path in a page and the next and differ."""
    from ..functions.markup import text_paths

    pages = v.table("pages").select("page_id", F.explode(text_paths(F.col("html"))).alias("path", "own"))
    other = pages.select((F.col("page_id") - 1).alias("page_id"), "path", F.col("own").alias("other"))
    return pages.join(other, ["page_id", "path"]).where("own <> other")
