"""Dictionaries as tables: brands inside names, replacements in order, and the scan that takes out what it finds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.phrases import brands_recognised, phrases_in, phrases_replaced
from ..registry import query
from ..sources.views import Views

UNITS = ("ml", "lt", "gr", "kg", "cl")

#: A brand is enabled unless its number ends in 5; a text's given brand is its own, unknown, missing or one letter by turns.
_BRANDS = "SELECT DISTINCT CAST(substr(brand, 7) AS BIGINT) AS ord, lower(brand) AS brand, substr(brand, length(brand)) <> '5' AS enabled FROM article"
_NAMES = "SELECT t.article_id, lower(t.text) AS text, CASE t.article_id % 4 WHEN 0 THEN lower(a.brand) WHEN 1 THEN 'house' WHEN 2 THEN NULL ELSE 'x' END AS brand FROM product_text t JOIN article a ON a.article_id = t.article_id"


def brand_table(v: Views) -> DataFrame:
    brand = F.col("brand")
    return v.article.select(F.substring(brand, F.lit(7), F.length(brand)).cast("long").alias("ord"), F.lower(brand).alias("brand"), (~brand.endswith("5")).alias("enabled")).distinct()


def given_brands(v: Views) -> DataFrame:
    k = F.col("article_id") % 4
    brand = F.when(k == 0, F.lower("brand")).when(k == 1, "house").when(k == 3, "x")
    return v.product_text.join(v.article.select("article_id", "brand"), "article_id").select("article_id", F.lower("text").alias("text"), brand.alias("brand"))


@query(f"""WITH b AS ({_BRANDS}), n AS ({_NAMES}), r AS (SELECT brand, 'brand#1' AS target FROM b WHERE brand = 'brand#15'),
    f AS (SELECT article_id, min((NOT contains(' ' || text || ' ', ' ' || b.brand || ' '), ord, b.brand)) AS best FROM n JOIN b ON b.enabled AND contains(text, b.brand) GROUP BY 1),
    t AS (SELECT n.*, CASE WHEN g.brand IS NOT NULL THEN n.brand ELSE f.best[3] END AS taken FROM n LEFT JOIN b g ON g.enabled AND g.brand = n.brand LEFT JOIN f ON f.article_id = n.article_id)
    SELECT article_id, coalesce(taken, CASE WHEN o.brand IS NOT NULL THEN coalesce(r.target, t.brand) WHEN length(t.brand) >= 2 THEN t.brand END) AS brand, CASE WHEN taken IS NOT NULL THEN replace(text, taken, '') ELSE text END AS name
    FROM t LEFT JOIN b o ON NOT o.enabled AND o.brand = t.brand LEFT JOIN r ON r.brand = t.brand""")
def s04_brands_recognised(v: Views) -> DataFrame:
    """A given brand that is enabled, else the first brand of the table between spaces, else inside words; disabled ones by their redirects."""
    redirects = v.spark.createDataFrame([("brand#15", "brand#1")], "brand string, target string")
    return brands_recognised(given_brands(v), brand_table(v), redirects, "article_id")


@query(f"""WITH b AS ({_BRANDS}), n AS ({_NAMES}) SELECT article_id, string_agg(b.brand, ',' ORDER BY ord) AS brands, CAST(sum(CASE WHEN contains(' ' || text || ' ', ' ' || b.brand || ' ') THEN 1 ELSE 0 END) AS BIGINT) AS alone
    FROM n JOIN b ON contains(text, b.brand) GROUP BY 1""")
def j11_brands_contained(v: Views) -> DataFrame:
    """All brands that a name holds, inside its words too, and how many of them stand between spaces."""
    names = given_brands(v).select("article_id", "text")
    found = phrases_in(names, brand_table(v).select("ord", F.col("brand").alias("phrase")), "article_id").join(names, "article_id")
    alone = F.filter("found", lambda p: F.contains(F.concat(F.lit(" "), "text", F.lit(" ")), F.concat(F.lit(" "), p["phrase"], F.lit(" "))))
    return found.select("article_id", F.array_join(F.transform("found", lambda p: p["phrase"]), ",").alias("brands"), F.size(alone).cast("long").alias("alone"))


#: Two-word names and colours by their order, each replaced by its first letters, or deleted where it begins with b; replacements make and break later ones.
_DICTIONARY = """SELECT row_number() OVER (ORDER BY phrase) AS ord, phrase, CASE WHEN left(phrase, 1) = 'b' THEN NULL ELSE left(phrase, 3) END AS replacement
    FROM (SELECT DISTINCT name AS phrase FROM article WHERE article_id % 3 = 0 UNION SELECT DISTINCT colour FROM article WHERE article_id % 2 = 0 UNION SELECT DISTINCT left(package, 2) FROM article)"""


def _dictionary(v: Views) -> DataFrame:
    from pyspark.sql import Window

    phrases = v.article.where("article_id % 3 = 0").select(F.col("name").alias("phrase")).union(v.article.where("article_id % 2 = 0").select("colour")).union(v.article.select(F.substring("package", 1, 2))).distinct()
    ranked = phrases.withColumn("ord", F.row_number().over(Window.orderBy("phrase")).cast("long"))  # a dictionary; its order is one sequence
    return ranked.withColumn("replacement", F.when(~F.col("phrase").startswith("b"), F.substring("phrase", 1, 3)))


def _rewritten(condition: str) -> str:
    return f"""WITH RECURSIVE d AS ({_DICTIONARY}), s AS (SELECT article_id, text, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS hits FROM product_text UNION ALL
        SELECT s.article_id, CASE WHEN {condition} THEN replace(s.text, d.phrase, coalesce(d.replacement, '')) ELSE s.text END, d.ord, CASE WHEN {condition} THEN list_append(s.hits, d.ord) ELSE s.hits END FROM s JOIN d ON d.ord = s.k + 1)"""


@query(f"{_rewritten('contains(s.text, d.phrase)')} SELECT article_id, text, array_to_string(hits, ',') AS hits FROM s WHERE k = (SELECT max(ord) FROM d)")
def j12_dictionary_replaced(v: Views) -> DataFrame:
    """Every phrase of a dictionary table replaced in its order, each in what the ones before left, and which of them were found."""
    out = phrases_replaced(v.product_text, _dictionary(v), "article_id")
    return out.select("article_id", "text", F.array_join(F.transform("hits", lambda h: h.cast("string")), ",").alias("hits"))


@query(f"{_rewritten('contains(s.text, d.phrase)')} SELECT d.phrase, count(*) AS hits FROM (SELECT unnest(hits) AS ord FROM s WHERE k = (SELECT max(ord) FROM d)) h JOIN d ON d.ord = h.ord GROUP BY 1")
def s03_phrase_hits(v: Views) -> DataFrame:
    """How many names each phrase of the dictionary was replaced in."""
    dictionary = _dictionary(v)
    hits = phrases_replaced(v.product_text, dictionary, "article_id").select(F.explode("hits").alias("ord")).groupBy("ord").agg(F.count("*").alias("hits"))
    return hits.join(dictionary.select("ord", "phrase"), "ord").select("phrase", "hits")


@query(f"""{_rewritten("contains(' ' || s.text || ' ', ' ' || d.phrase || ' ')")} SELECT article_id, text, array_to_string(hits, ',') AS hits FROM s WHERE k = (SELECT max(ord) FROM d)""")
def s08_phrases_taken_out(v: Views) -> DataFrame:
    """As the dictionary is applied to phrases that stand between spaces only."""
    out = phrases_replaced(v.product_text, _dictionary(v), "article_id", padded=True)
    return out.select("article_id", "text", F.array_join(F.transform("hits", lambda h: h.cast("string")), ",").alias("hits"))


#: Names with measures in every form: apart, glued, bare, as a dimension, in the middle, none.
_FORMS = """SELECT article_id, name || CASE article_id % 8 WHEN 0 THEN ' ' || size_ || ' ml' WHEN 1 THEN ' ' || size_ || ',5lt box' WHEN 2 THEN ' kg' WHEN 3 THEN ' ' || size_ || 'x20cm' WHEN 4 THEN ' 3 kg of ' || size_ || ' gr' WHEN 5 THEN ' gr ' || size_ || 'gr x' WHEN 6 THEN ' 10x4' || ' lt' ELSE '' END AS text
    FROM (SELECT article_id, name, CAST(CAST(measure AS BIGINT) AS VARCHAR) AS size_ FROM article)"""


def measured_names(v: Views) -> DataFrame:
    k, n = F.col("article_id") % 8, F.col("measure").cast("long").cast("string")
    form = F.when(k == 0, F.concat(F.lit(" "), n, F.lit(" ml"))).when(k == 1, F.concat(F.lit(" "), n, F.lit(",5lt box"))).when(k == 2, " kg").when(k == 3, F.concat(F.lit(" "), n, F.lit("x20cm")))
    form = form.when(k == 4, F.concat(F.lit(" 3 kg of "), n, F.lit(" gr"))).when(k == 5, F.concat(F.lit(" gr "), n, F.lit("gr x"))).when(k == 6, " 10x4 lt").otherwise("")
    return v.article.select("article_id", F.concat("name", form).alias("text"))


_U = "'ml', 'lt', 'gr', 'kg', 'cl'"


def _measures(source: str) -> str:
    """CTEs w, t, c, l and m(article_id, quantity, unit, dimension, rest) over (article_id, text)."""
    return rf"""w AS (SELECT article_id, regexp_split_to_array(trim(text), ' +') AS w FROM {source}), t AS (SELECT article_id, w, unnest(generate_series(1, len(w))) AS i FROM w),
    c AS (SELECT article_id, w, i, w[i] AS x, w[i] IN ({_U}) AND i > 1 AND regexp_matches(replace(replace(w[i - 1], '.', ''), ',', ''), '^[0-9]+$') AS pair, w[i] IN ({_U}) AS unit, regexp_matches(w[i], '^\d+([.,]\d+)?(ml|lt|gr|kg|cl)$') AS glued, regexp_matches(w[i], '^\d+[xX]\d+[a-zA-Z]*$') AS dim FROM t),
    l AS (SELECT * FROM c WHERE unit OR glued OR dim QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY i DESC) = 1),
    m AS (SELECT w.article_id, CASE WHEN pair THEN w.w[i - 1] WHEN unit THEN '1' WHEN glued THEN regexp_extract(x, '^(\d+([.,]\d+)?)', 1) ELSE '' END AS quantity, CASE WHEN unit THEN x WHEN glued THEN regexp_extract(x, '(ml|lt|gr|kg|cl)$', 1) ELSE '' END AS unit,
        CASE WHEN dim AND NOT glued THEN x ELSE '' END AS dimension, array_to_string(CASE WHEN i IS NULL THEN w.w WHEN pair THEN list_concat(w.w[:i - 2], w.w[i + 1:]) ELSE list_concat(w.w[:i - 1], w.w[i + 1:]) END, ' ') AS rest FROM w LEFT JOIN l ON l.article_id = w.article_id)"""


@query(f"WITH {_measures(f'({_FORMS})')} SELECT article_id, quantity, unit, dimension, rest FROM m")
def s13_measures_taken(v: Views) -> DataFrame:
    """The last measure of a name in any form, and the name without exactly its tokens."""
    return measured_names(v).select("article_id", T.measure_taken(F.col("text"), UNITS).alias("m")).select("article_id", "m.*")


def _packs(source: str) -> str:
    sql = f"SELECT article_id, 1::BIGINT AS units, text AS rest FROM {source}"
    for p in T.PACK_PATTERNS:
        hit, found = f"units = 1 AND regexp_matches(rest, '(?i){p}')", f"coalesce(TRY_CAST(nullif(regexp_extract(rest, '(?i){p}', 1), '') AS BIGINT), 1)"
        sql = f"SELECT article_id, CASE WHEN {hit} THEN {found} ELSE units END AS units, CASE WHEN {hit} THEN trim(regexp_replace(rest, '(?i){p}', '', 'g')) ELSE rest END AS rest FROM ({sql})"
    return sql


_PACKED = "SELECT article_id, CASE article_id % 5 WHEN 0 THEN text || ' 6 unidades y 2 unidades' WHEN 1 THEN '12 ' || text WHEN 2 THEN text || ' 1 unidad x 4' WHEN 3 THEN text || ' 3 packs x 2 packs x' ELSE text END AS text FROM product_text"


@query(_packs(f"({_PACKED})"))
def s16_packs_taken(v: Views) -> DataFrame:
    """Pack counts by the patterns in their order, with all matches of the one that decided taken out."""
    k = F.col("article_id") % 5
    text = F.when(k == 0, F.concat("text", F.lit(" 6 unidades y 2 unidades"))).when(k == 1, F.concat(F.lit("12 "), "text")).when(k == 2, F.concat("text", F.lit(" 1 unidad x 4"))).when(k == 3, F.concat("text", F.lit(" 3 packs x 2 packs x"))).otherwise(F.col("text"))
    return v.product_text.select("article_id", T.packs_taken(text).alias("p")).select("article_id", "p.*")


@query(r"SELECT article_id, CASE WHEN n = '' THEN 1.0::DOUBLE ELSE CAST(n AS DOUBLE) END AS units, CASE WHEN n = '' THEN text ELSE trim(replace(' ' || text || ' ', ' ' || n || ' unidades ', ' ')) END AS rest FROM (SELECT article_id, text, regexp_extract(' ' || text || ' ', ' (\d+) unidades ', 1) AS n FROM product_text)")
def s18_units_taken(v: Views) -> DataFrame:
    """Trailing units, and the text without them."""
    return v.product_text.select("article_id", T.units_taken(F.col("text"), ["unidades", "uds"]).alias("u")).select("article_id", "u.*")


def attributes(names: DataFrame, dictionary: DataFrame, brands: DataFrame, redirects: DataFrame, key: str) -> DataFrame:
    """Attributes of names (key, text, brand) in the order of the whole chain, each step reading exactly what the one before left: dictionary, brand, digits and
    degrees, the measure, packs, trailing units, marks at the ends."""
    lower = names.select(key, F.lower("text").alias("text"))
    said = phrases_replaced(lower, dictionary, key).select(key, "text").join(names.select(key, "brand"), key)
    rows = brands_recognised(said, brands, redirects, key)
    clean = T.degree_points(T.split_digits(F.col("name")))
    rows = rows.select(key, "brand", T.degrees(clean).alias("degrees"), T.measure_taken(T.without_degrees(clean), UNITS).alias("m"))
    rows = rows.select(key, "brand", "degrees", "m", T.packs_taken(F.col("m.rest")).alias("p")).select("*", T.units_taken(F.col("p.rest"), ["unidades", "uds"]).alias("u"))
    amount, unit = T.scaled(T.number(F.col("m.quantity")), T.unit_name(F.col("m.unit")))
    units = F.when(F.col("p.units") == 1, F.col("u.units").cast("long")).otherwise(F.col("p.units"))
    return rows.select(key, "brand", T.tidied(F.col("u.rest")).alias("name"), "degrees", amount.alias("measure"), unit.alias("unit"), F.col("m.dimension").alias("dimension"), units.alias("units"))


_TIDY = r"trim(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(trim(rest), '[,\-.+– ]+$', ''), '^[:!+ ]+', ''), '^pack ', ''), '.,', '  '), ' +', ' ', 'g'))"


@query(rf"""WITH RECURSIVE d AS ({_DICTIONARY}), n AS (SELECT article_id, CASE article_id % 4 WHEN 0 THEN lower(brand) WHEN 1 THEN 'house' WHEN 2 THEN NULL ELSE 'x' END AS brand FROM article),
    s AS (SELECT article_id, lower(text) AS text, CAST(0 AS BIGINT) AS k FROM product_text UNION ALL SELECT s.article_id, CASE WHEN contains(s.text, d.phrase) THEN replace(s.text, d.phrase, coalesce(d.replacement, '')) ELSE s.text END, d.ord FROM s JOIN d ON d.ord = s.k + 1),
    x AS (SELECT s.article_id, s.text, n.brand FROM s JOIN n ON n.article_id = s.article_id WHERE k = (SELECT max(ord) FROM d)), b AS ({_BRANDS}),
    f AS (SELECT article_id, min((NOT contains(' ' || text || ' ', ' ' || b.brand || ' '), ord, b.brand)) AS best FROM x JOIN b ON b.enabled AND contains(text, b.brand) GROUP BY 1),
    y AS (SELECT x.*, CASE WHEN g.brand IS NOT NULL THEN x.brand ELSE f.best[3] END AS taken FROM x LEFT JOIN b g ON g.enabled AND g.brand = x.brand LEFT JOIN f ON f.article_id = x.article_id),
    z AS (SELECT article_id, coalesce(taken, CASE WHEN o.brand IS NOT NULL THEN CASE WHEN y.brand = 'brand#15' THEN 'brand#1' ELSE y.brand END WHEN length(y.brand) >= 2 THEN y.brand END) AS brand,
        regexp_replace(regexp_replace(CASE WHEN taken IS NOT NULL THEN replace(text, taken, '') ELSE text END, '(\d+)([a-zA-Z]+)', '\1 \2', 'g'), '(\d+),(\d+)°', '\1.\2°', 'g') AS name FROM y LEFT JOIN b o ON NOT o.enabled AND o.brand = y.brand),
    e AS (SELECT article_id, brand, TRY_CAST(replace(regexp_extract(name, '(\S*°)', 1), '°', '') AS DOUBLE) AS degrees, array_to_string([q for q in regexp_split_to_array(name, ' +') if q <> '' AND NOT contains(q, '°')], ' ') AS text FROM z),
    {_measures('e')}, p AS ({_packs('(SELECT article_id, rest AS text FROM m)')}),
    u AS (SELECT article_id, units, CASE WHEN c = '' THEN rest ELSE trim(replace(' ' || rest || ' ', ' ' || c || ' unidades ', ' ')) END AS rest, c FROM (SELECT *, regexp_extract(' ' || rest || ' ', ' (\d+) unidades ', 1) AS c FROM p)),
    a AS (SELECT article_id, CASE WHEN quantity = '' THEN 0 ELSE CAST(quantity AS DOUBLE) END AS q, CASE WHEN unit IN ('ml', 'cl') THEN 'cc' ELSE unit END AS unit, dimension FROM m)
    SELECT e.article_id, e.brand, {_TIDY} AS name, e.degrees, CASE WHEN a.unit IN ('lt', 'kg') AND q <= 5 THEN q * 1000 ELSE q END AS measure, CASE WHEN a.unit = 'lt' AND q <= 5 THEN 'cc' WHEN a.unit = 'kg' AND q <= 5 THEN 'gr' ELSE a.unit END AS unit, a.dimension,
        CASE WHEN units = 1 THEN CASE WHEN c = '' THEN 1 ELSE CAST(c AS BIGINT) END ELSE units END AS units FROM e JOIN a ON a.article_id = e.article_id JOIN u ON u.article_id = e.article_id""")
def q23_whole_chain(v: Views) -> DataFrame:
    """Names into attributes with dictionary and brands as tables and every step taking out what it found."""
    redirects = v.spark.createDataFrame([("brand#15", "brand#1")], "brand string, target string")
    return attributes(given_brands(v), _dictionary(v), brand_table(v), redirects, "article_id")
