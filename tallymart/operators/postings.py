"""Posting lists: for each piece of text the rows that hold it, met by search before any row is read.

Pieces are all runs of one to three letters of a text. Ids are cut into ranges of BUCKET, so the list of a frequent piece is many short lists, sorted and stored as
offsets within their range, which Parquet packs closely. A search takes the pieces of its words, meets their lists range by range and keeps the ids
in all of them; only those rows are read and compared whole, so the answer is that of a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = 65_536


def pieces(text: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """All different runs of letters of those sizes."""

    def runs(n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))

    return F.array_distinct(F.flatten(F.array(*map(runs, sizes))))


def posting_lists(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(piece, bucket, ids): the offsets within bucket, ascending, of the rows whose text in lower case holds the piece. Keys are not negative; null keys and texts are left out."""
    lowered = rows.select(F.col(key).cast("long").alias("id"), F.lower(text).alias("t")).dropna()
    each = lowered.select((F.col("id") % BUCKET).cast("int").alias("at"), F.floor(F.col("id") / BUCKET).cast("long").alias("bucket"), F.explode(pieces(F.col("t"))).alias("piece"))
    return each.groupBy("piece", "bucket").agg(F.array_sort(F.collect_set("at")).alias("ids"))


def asked_pieces(words: Column) -> Column:
    """What a text must hold to hold the words: the runs of three letters of each, or a shorter word itself."""
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.when(F.length(w) >= 3, pieces(w, (3,))).otherwise(F.array(w)))))


def met(searches: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """(key, id) of rows in the lists of all pieces of searches (key, words). A search without words meets nothing here."""
    asked = searches.select(key, asked_pieces(F.filter("words", lambda w: w != "")).alias("p"))
    asked = asked.select(key, F.size("p").alias("n"), F.explode("p").alias("piece"))
    both = asked.join(lists, "piece").groupBy(key, "bucket").agg(F.first("n").alias("n"), F.collect_list("ids").alias("lists"))
    common = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.get("lists", 0), lambda a, b: F.array_intersect(a, b))
    return both.where(F.size("lists") == F.col("n")).select(key, "bucket", F.explode(common).alias("at")).select(key, (F.col("bucket") * BUCKET + F.col("at")).alias("id"))


def searched(searches: DataFrame, rows: DataFrame, lists: DataFrame, key: str, row_key: str, text: str) -> DataFrame:
    """(key, row_key) of rows whose text in lower case starts with a search's first word and holds the others. A search without words finds nothing."""
    words = searches.select(key, F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w != "").alias("words"))
    found = met(words, lists, key).withColumnRenamed("id", "_id").join(rows.select(F.col(row_key), F.col(row_key).cast("long").alias("_id"), F.lower(text).alias("t")), "_id").join(words, key)
    return found.where(F.startswith("t", F.get("words", 0)) & F.forall("words", lambda w: F.contains("t", w))).select(key, row_key)
