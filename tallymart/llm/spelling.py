"""Spelling variants grouped by anagram hashing.

A word's key is the sum of a power of each of its letters, so words of the same letters have the same key, a letter more or less changes it by that
letter's value and a letter for another by the difference of two values. Keys, not words, are compared: each is reduced by each of its letters'
values; what meets a key is a word with one letter less, and two keys that meet reduced differ by an exchange. A meeting place holds at most as many keys as
there are letters, however many words share a key. What a key's moves make of a word, by the places of the letter that moves, is looked up by hash among all
words, and what is found is compared letter by letter; so words of a large class are never paired with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written
from .licenses import LOWER, UPPER

#: The letters of a run after A-Z are lower-cased, and which runs lose a letter.
LETTERS, DIVISOR = "a-zÀ-ÿ", 199
POWER = 5
#: Words of one key that are joined with its moves in one place; more are dealt to several.
CLASS = 4096


def value(letter: Column) -> Column:
    """The power of a letter's place in the alphabet a to z, U+00C0 to U+00FF."""
    code = F.ascii(letter)
    place = F.when(code < 0xC0, code - ord("a") + 1).otherwise(code - 0xC0 + 27).cast("long")
    power = place
    for _ in range(POWER - 1):
        power = power * place
    return power


def _letters(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda x: x != "")


def counted_words(docs: DataFrame, least_length: int = 6, least_n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all runs of letters of that length that occur that often, each 199th run by its checksum without one of its letters."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    runs = F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))  # a maximal run, as a shorter match can't begin it
    rows = docs.select(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).alias("of"), F.explode(runs).alias("run"))
    rows = rows.select("run", F.crc32(F.concat_ws(":", "of", "run").cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = rows.select(F.when(F.col("h") % DIVISOR == 0, less).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where((F.char_length("word") >= least_length) & (F.col("n") >= least_n))


def moves(words: DataFrame) -> DataFrame:
    """(key, size, moves) of the keys of `words` (word, key): letters (c, d) such that some word's key has d for c, or no c where d is empty.

    size is the number of words with the key. A key has no more moves than there are pairs of letters.
    """
    classes = written(words.groupBy("key", F.array_join(F.array_sort(_letters(F.col("word"))), "").alias("letters")).agg(F.count("*").alias("size")), "classes")
    less = classes.select("key", F.explode(F.array_distinct(_letters(F.col("letters")))).alias("c")).withColumn("rest", F.col("key") - value(F.col("c")))
    less = written(less, "reduced")
    removed = less.join(classes.select(F.col("key").alias("rest")).distinct(), "rest").select("key", "c", F.lit("").alias("d"))
    exchanged = less.join(less.select("rest", F.col("c").alias("d")).distinct(), "rest").where("c != d").select("key", "c", "d")
    sizes = classes.groupBy("key").agg(F.sum("size").alias("size"))
    every = removed.unionByName(exchanged).groupBy("key").agg(F.collect_set(F.struct("c", "d")).alias("moves"))
    return written(every.join(sizes, "key"), "moves")


def _moved(word: str, at: str = "at") -> Column:
    return F.concat(F.substring(word, F.lit(1), F.col(at) - 1), F.col("d"), F.substring(word, F.col(at) + 1, F.char_length(word)))


def near_words(words: DataFrame) -> DataFrame:
    """(id, near) of all pairs of rows of `words` (id, word; words distinct) that one inserted, deleted or replaced code point parts, both ways round.

    The letters are those of runs. Made of exact comparisons: the hashes and keys only bring words together.
    """
    key = F.aggregate(_letters(F.col("word")), F.lit(0).cast("long"), lambda s, x: s + value(x))
    keyed = written(words.select("id", "word", key.alias("key"), F.xxhash64("word").alias("h")), "keyed")
    by_key = moves(keyed)
    hot = by_key.where(F.col("size") > CLASS).select("key", F.ceil(F.col("size") / CLASS).cast("int").alias("parts"))
    salted = keyed.join(hot, "key", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod("h", F.col("parts"))).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / CLASS).cast("int") - 1)).alias("part")
    rows = salted.join(by_key.select("key", "moves", copies), ["key", "part"]).select("id", "word", F.explode("moves").alias("m")).select("id", "word", "m.*")
    letter = lambda i: F.substring("word", i, F.lit(1))
    places = F.filter(F.sequence(F.lit(1), F.char_length("word")), lambda i: (letter(i) == F.col("c")) & ((F.col("d") != "") | (i == 1) | (letter(i - 1) != F.col("c"))))  # of a run of c, one place stands for all that lose a letter
    made = rows.select("id", "word", "d", F.explode(places).alias("at")).select("id", "d", "at", F.xxhash64(_moved("word")).alias("h"))  # hashes, as a long word makes many of its length
    other = keyed.select("h", F.col("id").alias("near"), F.col("word").alias("found"))
    met = made.join(other, "h").join(words.select("id", "word"), "id").where(_moved("word") == F.col("found"))
    pairs = written(met.select("id", "near", (F.col("d") == "").alias("shorter")), "pairs")
    return pairs.select("id", "near").unionByName(pairs.where("shorter").select(F.col("near").alias("id"), F.col("id").alias("near")))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form), forms being followed to the last; no form leads back. Each round doubles the steps that are followed."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "roots")
        forget(now)
        now = new.drop("went")
        now.scratch_path = new.scratch_path
        if not new.where("went").limit(1).count():
            return now


def spelling_variants(docs: DataFrame, factor: int = 5, least_length: int = 6, least_n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of that length and number of occurrences.

    A word's form is the near word that occurs most, the first in code-point order of equal ones, where it occurs `factor` times as often or more. Null texts
    have no words, a null doc_id counts as empty text in the checksum, repeated rows count each, and no words give no rows. Other columns are ignored.
    """
    words = written(counted_words(docs, least_length, least_n, id_col, text_col), "words")
    words = written(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "numbered")
    to = words.select(F.col("id").alias("near"), F.struct((-F.col("n")).alias("less"), "word").alias("best"))
    near = near_words(words.select("id", "word")).join(to, "near").groupBy("id").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    rows = words.join(near, "id", "left").withColumn("top", -F.col("best")["less"])
    is_form = F.col("top") >= F.lit(factor) * F.col("n")
    rows = written(rows.select("word", F.when(is_form, F.col("best")["word"]).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("top")).alias("form_n")), "variants")
    roots = followed(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The variants in SQL: checksums bit by bit, near words by what is left without one letter.
ORACLE_SQL = f"""WITH RECURSIVE t AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
    runs AS (SELECT doc, run, count(*) AS n FROM (SELECT doc, unnest(regexp_extract_all(text, '[{LETTERS}]+')) AS run FROM t) WHERE length(run) >= 6 GROUP BY 1, 2),
    bytes AS (SELECT *, flatten([CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + unicode(x)::BIGINT // 64, 128 + unicode(x)::BIGINT % 64] END for x in string_split(doc || ':' || run, '')]) AS b FROM runs),
    steps AS (SELECT doc, run, n, list_reduce(flatten([[x, -1, -1, -1, -1, -1, -1, -1, -1] for x in b]), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295::BIGINT) AS c FROM bytes),
    sums AS (SELECT run, n, xor(c, 4294967295::BIGINT) AS h FROM steps),
    w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % {DIVISOR} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM sums) WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
    less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(generate_series(1, length(word)))::INT AS i FROM w)),
    shorter AS (SELECT DISTINCT l.word AS a, w.word AS b FROM less l JOIN w ON w.word = l.rest),
    near AS (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT a, b FROM shorter UNION SELECT b, a FROM shorter),
    best AS (SELECT near.word, count(*) AS n_near, min((-w.n, w.word)) AS best FROM near JOIN w ON w.word = near.other GROUP BY 1),
    f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 5 * w.n THEN best[2] END AS form, CASE WHEN -best[1] >= 5 * w.n THEN -best[1] END AS form_n FROM w LEFT JOIN best ON best.word = w.word),
    up AS (SELECT word, form, word AS root, form AS next FROM f UNION ALL SELECT up.word, up.form, f.word, f.form FROM up JOIN f ON f.word = up.next)
    SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word AND up.next IS NULL"""
