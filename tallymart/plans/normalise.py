"""Attributes out of product names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.tables import small
from ..registry import query
from ..sources.views import Views

UNITS = ("ml", "lt", "gr", "kg", "cl")


def _case(column: str, mapping) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping) + f" ELSE {column} END"


_UNIT_PAIRS = [(s + m, name) for name, spellings in T.UNIT_SPELLINGS.items() for s in spellings for m in (("", ".", ",") if name in T.MARKED_UNITS else ("",))]
_SPELL = "CASE article_id % 6 WHEN 0 THEN 'LTS.' WHEN 1 THEN 'grms' WHEN 2 THEN 'kilos,' WHEN 3 THEN 'c.c' WHEN 4 THEN 'galon' ELSE 'pulgada' END"


def _spelt():
    k = F.col("article_id") % 6
    return F.lower(F.when(k == 0, "LTS.").when(k == 1, "grms").when(k == 2, "kilos,").when(k == 3, "c.c").when(k == 4, "galon").otherwise("pulgada"))


@query(f"SELECT article_id, {_case(f'lower({_SPELL})', _UNIT_PAIRS)} AS unit FROM article")
def norm_units(v: Views) -> DataFrame:
    return v.article.select("article_id", T.unit_name(_spelt()).alias("unit"))


@query(f"""SELECT article_id, round(CASE WHEN u IN ('lt', 'kg') AND q <= 5 THEN q * 1000 ELSE q END, 6) AS quantity, CASE WHEN u = 'lt' AND q <= 5 THEN 'cc' WHEN u = 'kg' AND q <= 5 THEN 'gr' ELSE u END AS unit FROM (
    SELECT article_id, CASE unit WHEN 'galon' THEN measure * 3.785411784::DOUBLE WHEN 'cl' THEN measure * 10 ELSE measure END AS q, CASE unit WHEN 'galon' THEN 'lt' WHEN 'cl' THEN 'cc' ELSE unit END AS u
    FROM (SELECT article_id, measure, {_case(f'lower({_SPELL})', _UNIT_PAIRS)} AS unit FROM article))""")
def norm_quantity_scaling(v: Views) -> DataFrame:
    q, u = T.scaled(F.col("measure"), F.col("u"))
    return v.article.withColumn("u", T.unit_name(_spelt())).select("article_id", F.round(q, 6).alias("quantity"), u.alias("unit"))


_LAST = r"^.*(?:^|\s)(\d[\d.,]*)\s?(ml|lt|gr|kg|cl)(?:\s|$)"


@query(f"SELECT article_id, regexp_extract(text, '{_LAST}', 1) AS quantity, regexp_extract(text, '{_LAST}', 2) AS unit FROM product_text")
def norm_measure_regex(v: Views) -> DataFrame:
    """The last number with a unit, spaced or glued."""
    quantity, unit = T.measure(F.col("text"), UNITS)
    return v.product_text.select("article_id", quantity.alias("quantity"), unit.alias("unit"))


_PACK = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '(?i){p}', 1), '')" for p in T.PACK_PATTERNS) + ", '1')"


@query(f"SELECT article_id, CAST({_PACK} AS BIGINT) AS units FROM product_text")
def norm_pack_count(v: Views) -> DataFrame:
    return v.product_text.select("article_id", T.pack_count(F.col("text")).alias("units"))


@query(r"""SELECT article_id, TRY_CAST(replace(regexp_extract(clean, '(\S*°)', 1), '°', '') AS DOUBLE) AS degrees, trim(regexp_replace(clean, '\s*\S*°', '', 'g')) AS rest
    FROM (SELECT article_id, regexp_replace(text, '(\d+),(\d+)°', '\1.\2°', 'g') AS clean FROM product_text)""")
def norm_degrees(v: Views) -> DataFrame:
    clean = T.degree_points(F.col("text"))
    return v.product_text.select("article_id", T.degrees(clean).alias("degrees"), T.without_degrees(clean).alias("rest"))


@query(f"SELECT article_id, {_case('written', T.SIZE_NAMES.items())} AS size FROM (SELECT article_id, CASE WHEN article_id % 3 = 0 THEN size ELSE 'talla ' || size END AS written FROM article)")
def norm_size(v: Views) -> DataFrame:
    written = F.when(F.col("article_id") % 3 == 0, F.col("size")).otherwise(F.concat(F.lit("talla "), "size"))
    return v.article.select("article_id", T.size_name(written).alias("size"))


@query("SELECT article_id, regexp_replace(strip_accents(lower(text)), '[_ /]', '-', 'g') AS slug FROM product_text")
def norm_slug(v: Views) -> DataFrame:
    return v.product_text.select("article_id", T.slug(F.col("text")).alias("slug"))


_PRICE = "CASE article_id % 5 WHEN 0 THEN '$1.' || (100 + article_id % 800) WHEN 1 THEN '' WHEN 2 THEN '2x1990' WHEN 3 THEN ' 990 ' ELSE '$' || article_id || '.9' END"


def _price():
    key, k = F.col("article_id").cast("string"), F.col("article_id") % 5
    return F.when(k == 0, F.concat(F.lit("$1."), (F.col("article_id") % 800 + 100).cast("string"))).when(k == 1, "").when(k == 2, "2x1990").when(k == 3, " 990 ").otherwise(F.concat(F.lit("$"), key, F.lit(".9")))


@query(f"""SELECT article_id, CASE WHEN t = '' THEN 0 ELSE TRY_CAST(t AS BIGINT) END AS price, coalesce(TRY_CAST(nullif(regexp_extract(trim(raw), '^(\\d+)x', 1), '') AS BIGINT), 1) AS quantity
    FROM (SELECT article_id, raw, trim(replace(replace(raw, '.', ''), '$', '')) AS t FROM (SELECT article_id, {_PRICE} AS raw FROM article))""")
def norm_price_text(v: Views) -> DataFrame:
    return v.article.select("article_id", T.price_text(_price()).alias("price"), T.price_quantity(_price()).alias("quantity"))


@query(f"SELECT article_id, CASE WHEN trim(replace(raw, '$', '')) = '' THEN 0 ELSE CAST(trunc(TRY_CAST(trim(replace(raw, '$', '')) AS DOUBLE)) AS BIGINT) END AS price FROM (SELECT article_id, {_PRICE} AS raw FROM article)")
def norm_json_price(v: Views) -> DataFrame:
    return v.article.select("article_id", T.json_price(_price()).alias("price"))


_CODE = "CASE article_id % 6 WHEN 0 THEN '[''00' || ean || ''']' WHEN 1 THEN ean || 'x6' WHEN 2 THEN ean || '-7' WHEN 3 THEN 'sku' WHEN 4 THEN ean || '}' ELSE ean END"


@query(f"""SELECT article_id, CAST(TRY_CAST(split_part(t, 'x', 1) AS BIGINT) AS VARCHAR) AS ean, TRY_CAST(nullif(regexp_extract(t, '^\\d+x(\\d+)$', 1), '') AS BIGINT) AS units
    FROM (SELECT article_id, split_part(trim(replace(replace(replace(replace(raw, '[', ''), ']', ''), '}}', ''), '''', '')), '-', 1) AS t FROM (SELECT article_id, {_CODE} AS raw FROM article))""")
def norm_barcode(v: Views) -> DataFrame:
    k, ean = F.col("article_id") % 6, F.col("ean")
    raw = F.when(k == 0, F.concat(F.lit("['00"), ean, F.lit("']"))).when(k == 1, F.concat(ean, F.lit("x6"))).when(k == 2, F.concat(ean, F.lit("-7"))).when(k == 3, "sku").when(k == 4, F.concat(ean, F.lit("}"))).otherwise(ean)
    code, units = T.barcode(raw)
    return v.article.select("article_id", code.alias("ean"), units.alias("units"))


#: A small dictionary of our own; the last word is deleted.
WORDS = (("widget", "gadget"), ("old ", "vintage "), ("hot", "warm"), ("gad", "g"), ("unidades", None))


@query("SELECT article_id, replace(replace(replace(replace(replace(text, 'widget', 'gadget'), 'old ', 'vintage '), 'hot', 'warm'), 'gad', 'g'), 'unidades', '') AS text FROM product_text")
def dictionary_replace(v: Views) -> DataFrame:
    return v.product_text.select("article_id", T.replaced(F.col("text"), WORDS).alias("text"))


@query("""SELECT dictionary.word, count(*) AS hits FROM product_text JOIN (SELECT unnest(['widget', 'old', 'hot', 'pack', 'gr']) AS word) dictionary ON list_contains(string_split(text, ' '), dictionary.word) GROUP BY 1""")
def s03_word_hits(v: Views) -> DataFrame:
    """How many names hold each word: words are exploded and met by equality."""
    words = v.product_text.select("article_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    return words.where(F.col("word").isin("widget", "old", "hot", "pack", "gr")).groupBy("word").agg(F.count("*").alias("hits"))


@query("SELECT article_id, min(b) AS brand FROM (SELECT article_id, lower(text) AS t FROM product_text) x JOIN (SELECT DISTINCT lower(brand) AS b FROM article WHERE brand <> 'Brand#5') y ON list_contains(string_split(t, ' '), b) GROUP BY 1")
def brand_in_text(v: Views) -> DataFrame:
    """The brand that stands as a word in a name."""
    words = v.product_text.select("article_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("word"))
    brands = v.article.where("brand <> 'Brand#5'").select(F.lower("brand").alias("brand")).distinct()
    return words.join(brands, F.col("word") == F.col("brand")).groupBy("article_id").agg(F.min("brand").alias("brand"))


@query("""SELECT article_id, count(*) AS n FROM (SELECT article_id, unnest(string_split(name, ' ')) AS w FROM article) x JOIN (SELECT unnest(['red', 'ring', 'old', 'bolt']) AS b) y ON w = b GROUP BY 1 HAVING count(*) = 1""")
def m16_names_with_one_term(v: Views) -> DataFrame:
    """Names that hold exactly one of several terms."""
    words = v.article.select("article_id", F.explode(F.split("name", " ")).alias("w")).where(F.col("w").isin("red", "ring", "old", "bolt"))
    return words.groupBy("article_id").agg(F.count("*").alias("n")).where("n = 1")


def named_in(texts: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(key, name): the names whose words are a subset of a text's words in their order, of all subsets of all its words.

    Texts meet a name over its first word, so the subsets, two to the power of the words, are never listed.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number that stays: few bytes are much work here
    words = texts.select(key, F.split("text", " ").alias("w")).repartition(parts)
    asked = small(names.select("name", F.split("name", " ").alias("p")).withColumn("head", F.get("p", 0)))  # or the texts, whose size is underestimated, are broadcast
    near = words.select(key, "w", F.explode(F.array_distinct("w")).alias("head")).join(asked, "head")
    return near.where(T.subset_in_order(F.col("w"), F.col("p"))[0]).select(key, "name")


_NAMES = "SELECT DISTINCT brand AS name FROM article UNION SELECT DISTINCT colour || ' ' || brand FROM article UNION SELECT DISTINCT colour || ' ' || CAST(CAST(measure AS BIGINT) AS VARCHAR) FROM article"


@query(f"""SELECT article_id, name AS subset FROM (SELECT article_id, unnest(list_distinct(w)) AS head, w FROM (SELECT article_id, string_split(text, ' ') AS w FROM product_text)) x
    JOIN (SELECT name, split_part(name, ' ', 1) AS p, split_part(name, ' ', 2) AS q FROM ({_NAMES})) y ON head = p WHERE q = '' OR list_contains(w[list_position(w, p) + 1:], q)""")
def token_subsets(v: Views) -> DataFrame:
    """Names of one and two words that some subset of an article's words, all of them, spells."""
    names = [F.col("brand"), F.concat_ws(" ", "colour", "brand"), F.concat_ws(" ", "colour", F.col("measure").cast("long").cast("string"))]
    return named_in(v.product_text, v.article.select(F.explode(F.array(*names)).alias("name")).distinct(), "article_id").withColumnRenamed("name", "subset")


@query(r"SELECT article_id, regexp_replace(text, '(\d+)([a-zA-Z]+)', '\1 \2', 'g') AS text FROM product_text")
def s05_split_digits(v: Views) -> DataFrame:
    return v.product_text.select("article_id", T.split_digits(F.col("text")).alias("text"))


@query("SELECT article_id, array_to_string([w for w in string_split(replace(lower(text), '-', ' '), ' ') if w <> '' AND w NOT IN ('" + "', '".join(T.STOP_WORDS) + "')], ' ') AS text FROM (SELECT article_id, 'The ' || text || ' de la caja-y of x' AS text FROM product_text)")
def s07_stop_words(v: Views) -> DataFrame:
    text = F.concat(F.lit("The "), "text", F.lit(" de la caja-y of x"))
    return v.product_text.select("article_id", T.stop_words_removed(text).alias("text"))


@query("SELECT article_id, array_to_string([w for w in string_split(text, ' ') if regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]')], ' ') AS words FROM product_text")
def s10_mixed_words(v: Views) -> DataFrame:
    return v.product_text.select("article_id", F.array_join(T.mixed_words(F.col("text")), " ").alias("words"))


@query("SELECT article_id, regexp_extract(text, '(?i)((\\d+([.,]\\d+)?\\s*[-–a]\\s*\\d+([.,]\\d+)?)\\s*kg)', 1) AS weights FROM (SELECT article_id, 'bag ' || article_id % 9 || ' - ' || article_id % 9 + 2 || ' kg' AS text FROM article)")
def s12_weight_range(v: Views) -> DataFrame:
    low = F.col("article_id") % 9
    text = F.concat(F.lit("bag "), low.cast("string"), F.lit(" - "), (low + 2).cast("string"), F.lit(" kg"))
    return v.article.select("article_id", T.weight_range(text).alias("weights"))


@query("SELECT article_id, regexp_replace(text, '\\$.*$', '') AS text FROM (SELECT article_id, name || ' $' || article_id AS text FROM article)")
def s21_cut_price(v: Views) -> DataFrame:
    return v.article.select("article_id", F.regexp_replace(F.concat("name", F.lit(" $"), F.col("article_id").cast("string")), r"\$.*$", "").alias("text"))


@query("""SELECT article_id, trim(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(trim(text), '[,\\-.+– ]+$', ''), '^[:!+ ]+', ''), '^pack ', ''), '.,', '  '), ' +', ' ', 'g')) AS text
    FROM (SELECT article_id, ':! pack ' || name || ', 1.5,  x' || CASE WHEN article_id % 2 = 0 THEN ' -' ELSE ' .,' END AS text FROM article)""")
def s22_tidied(v: Views) -> DataFrame:
    text = F.concat(F.lit(":! pack "), "name", F.lit(", 1.5,  x"), F.when(F.col("article_id") % 2 == 0, " -").otherwise(" .,"))
    return v.article.select("article_id", T.tidied(text).alias("text"))


@query("SELECT article_id, regexp_matches(replace(replace(w, '.', ''), ',', ''), '^[0-9]+$') AS number FROM (SELECT article_id, CASE article_id % 4 WHEN 0 THEN '1.5' WHEN 1 THEN '1,5' WHEN 2 THEN 'x1' ELSE '' END AS w FROM article)")
def s23_is_number(v: Views) -> DataFrame:
    k = F.col("article_id") % 4
    return v.article.select("article_id", T.is_number(F.when(k == 0, "1.5").when(k == 1, "1,5").when(k == 2, "x1").otherwise("")).alias("number"))


@query("SELECT page_id, regexp_replace(html, '<.*?>', '', 'g') AS text FROM pages")
def s02_tags_removed(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", T.tags_removed(F.col("html")).alias("text"))


@query("SELECT article_id, split_part(replace(t, '&quot;', ''), '|', 1) AS name, left(regexp_replace(s, '^https?://schema.org/', ''), 20) AS stock FROM (SELECT article_id, '&quot;' || name || '&quot; | shop | x' AS t, 'http://schema.org/InStockAndAvailableToday' || article_id AS s FROM article)")
def s28_name_and_stock(v: Views) -> DataFrame:
    t = F.concat(F.lit("&quot;"), "name", F.lit("&quot; | shop | x"))
    s = F.concat(F.lit("http://schema.org/InStockAndAvailableToday"), F.col("article_id").cast("string"))
    return v.article.select("article_id", F.substring_index(F.replace(t, F.lit("&quot;")), "|", 1).alias("name"), F.substring(F.regexp_replace(s, "^https?://schema.org/", ""), 1, 20).alias("stock"))


@query("SELECT article_id, name || ' ' || brand || CASE WHEN degrees > 0 THEN ' ' || CAST(CAST(round(degrees * 10) AS BIGINT) AS VARCHAR) || '°' ELSE '' END || CASE WHEN measure > 0 THEN ' ' || CAST(CAST(measure AS BIGINT) AS VARCHAR) || ' ' || unit ELSE '' END || CASE WHEN units > 1 THEN ' x' || units ELSE '' END AS title FROM article")
def s30_title(v: Views) -> DataFrame:
    tenths, amount = F.round(F.col("degrees") * 10).cast("long").cast("string"), F.col("measure").cast("long").cast("string")
    title = F.concat(
        "name", F.lit(" "), "brand", F.when(F.col("degrees") > 0, F.concat(F.lit(" "), tenths, F.lit("°"))).otherwise(""), F.when(F.col("measure") > 0, F.concat(F.lit(" "), amount, F.lit(" "), "unit")).otherwise(""), F.when(F.col("units") > 1, F.concat(F.lit(" x"), F.col("units").cast("string"))).otherwise("")
    )
    return v.article.select("article_id", title.alias("title"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS text FROM documents")
def s31_folded(v: Views) -> DataFrame:
    """Letters without accents, other characters as spaces."""
    t = F.translate(F.lower("text"), "áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc")
    folded = F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9 ]", " "), " +", " "))
    return v.table("documents").select("doc_id", folded.alias("text"))


@query("SELECT shop_id, n, round(n * 1.19::DOUBLE, 2) AS gross, round(n / 7.0::DOUBLE, 2) AS weekly, format('{:,}', n) AS shown FROM (SELECT shop_id, count(*) AS n FROM offer GROUP BY 1)")
def s35_number_formats(v: Views) -> DataFrame:
    n = F.col("n")
    rows = v.offer.groupBy("shop_id").agg(F.count("*").alias("n"))
    return rows.select("shop_id", "n", F.round(n * 1.19, 2).alias("gross"), F.round(n / 7.0, 2).alias("weekly"), F.format_number("n", 0).alias("shown"))


def attributes(names: DataFrame, text: str = "text") -> DataFrame:
    """Names turned into attributes in the order of the whole chain: each step reads what the step before left."""
    t = F.lower(F.col(text))
    rows = names.withColumn("_t", T.degree_points(T.split_digits(T.replaced(t, WORDS[:3]))))
    rows = rows.withColumn("degrees", T.degrees(F.col("_t"))).withColumn("_t", T.without_degrees(F.col("_t")))
    quantity, unit = T.measure(F.col("_t"), UNITS)
    rows = rows.withColumn("_q", quantity).withColumn("_u", unit).withColumn("_t", F.trim(F.regexp_replace(F.replace("_t", F.concat_ws(" ", "_q", "_u"), F.lit("")), " +", " ")))
    rows = rows.withColumn("units", T.pack_count(F.col("_t"))).withColumn("_t", F.regexp_replace("_t", r"(pack\s*)?x\s*\d+|\d+ unidades", ""))
    amount, name = T.scaled(T.number(F.col("_q")), T.unit_name(F.col("_u")))
    return rows.select(*names.columns, T.stop_words_removed(T.tidied(F.col("_t"))).alias("name"), "degrees", amount.alias("measure"), name.alias("unit"), "units")


@query(r"""WITH a AS (SELECT article_id, regexp_replace(regexp_replace(replace(replace(replace(lower(text), 'widget', 'gadget'), 'old ', 'vintage '), 'hot', 'warm'), '(\d+)([a-zA-Z]+)', '\1 \2', 'g'), '(\d+),(\d+)°', '\1.\2°', 'g') AS t FROM product_text),
    b AS (SELECT article_id, TRY_CAST(replace(regexp_extract(t, '(\S*°)', 1), '°', '') AS DOUBLE) AS degrees, trim(regexp_replace(t, '\s*\S*°', '', 'g')) AS t FROM a),
    c AS (SELECT *, regexp_extract(t, '^.*(?:^|\s)(\d[\d.,]*)\s?(ml|lt|gr|kg|cl)(?:\s|$)', 1) AS q, regexp_extract(t, '^.*(?:^|\s)(\d[\d.,]*)\s?(ml|lt|gr|kg|cl)(?:\s|$)', 2) AS u FROM b),
    d AS (SELECT article_id, degrees, CAST(q AS DOUBLE) AS q, CASE u WHEN 'ml' THEN 'cc' WHEN 'cl' THEN 'cc' ELSE u END AS u, trim(regexp_replace(replace(t, q || ' ' || u, ''), ' +', ' ', 'g')) AS t FROM c)
    SELECT article_id, trim(regexp_replace(t, '(pack\s*)?x\s*\d+|\d+ unidades', '', 'g')) AS name, degrees, CASE WHEN u IN ('lt', 'kg') AND q <= 5 THEN q * 1000 ELSE q END AS measure, CASE WHEN u = 'lt' AND q <= 5 THEN 'cc' WHEN u = 'kg' AND q <= 5 THEN 'gr' ELSE u END AS unit,
    CAST(@PACK AS BIGINT) AS units FROM d""".replace("@PACK", _PACK.replace("(text,", "(t,")))
def q23_names_to_attributes(v: Views) -> DataFrame:
    return attributes(v.product_text).drop("text")
