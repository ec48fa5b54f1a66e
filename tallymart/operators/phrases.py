"""Many phrases in many texts, from a dictionary table.

A dictionary up to `AUTOMATON` letters becomes a trie with failure links: one pass over a text, a batch at a time, finds all phrases in it however many
there are. A larger one is never sent to the workers: the beginnings of texts at each place meet the heads of phrases by hash in a join, and what meets is
compared. Both give the same rows. Phrases are applied in the order of the table, each to what the ones before left, so a replacement can make or break a later match.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staged import Staging

#: Letters of a dictionary that is sent to the workers, and of the head of a phrase.
AUTOMATON, HEAD = 2_000_000, 4


class Automaton:
    """A trie of phrases with failure links; `found` gives the numbers of the phrases that a text holds."""

    def __init__(self, phrases: Sequence[str]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, ...]] = [()]
        for number, phrase in enumerate(phrases):
            at = 0
            for letter in phrase:
                if letter not in self.next[at]:
                    self.next[at][letter] = len(self.next)
                    self.next.append({})
                    self.ends.append(())
                at = self.next[at][letter]
            if at:
                self.ends[at] += (number,)
        self.fail = [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            at = queue.popleft()
            for letter, to in self.next[at].items():
                back = self.fail[at]
                while back and letter not in self.next[back]:
                    back = self.fail[back]
                self.fail[to] = self.next[back].get(letter, 0)
                self.ends[to] += self.ends[self.fail[to]]  # shorter phrases that end here
                queue.append(to)

    def found(self, text: str) -> set[int]:
        at, out = 0, set()
        for letter in text:
            while at and letter not in self.next[at]:
                at = self.fail[at]
            at = self.next[at].get(letter, 0)
            if self.ends[at]:
                out.update(self.ends[at])
        return out


def _small(dictionary: DataFrame, most: int) -> bool:
    return (dictionary.agg(F.sum(F.length("phrase"))).first()[0] or 0) <= most


def _rows(dictionary: DataFrame, *columns: str) -> list[tuple]:
    return [tuple(r) for r in dictionary.orderBy("ord", "phrase").select("ord", "phrase", *columns).collect()]


def _met(texts: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    """(key, ord, phrase) of the phrases that texts hold, over heads of up to HEAD letters."""
    size = F.least(F.length("phrase"), F.lit(HEAD))
    heads = dictionary.select("ord", "phrase", F.xxhash64(F.substring("phrase", F.lit(1), size)).alias("head"))
    places = F.sequence(F.lit(1), F.length("text"))
    begun = lambda n: F.transform(places, lambda i: F.xxhash64(F.substring("text", i, F.lit(n))))
    met = texts.where("text <> ''").select(key, "text", F.explode(F.array_distinct(F.flatten(F.array(*[begun(n) for n in range(1, HEAD + 1)])))).alias("head"))
    return met.join(heads, "head").where(F.contains("text", "phrase")).select(key, "ord", "phrase").distinct()


def phrases_in(texts: DataFrame, dictionary: DataFrame, key: str, most: int = AUTOMATON) -> DataFrame:
    """(key, found) of each text (key, text) that holds a phrase of dictionary (ord, phrase): found lists (ord, phrase) in order.

    Keys are those of one text each. Null texts and null or empty phrases are never found; `most` decides how, not what is found.
    """
    dictionary = dictionary.select(F.col("ord").cast("long").alias("ord"), "phrase").where("phrase <> '' and ord is not null").distinct()
    texts = texts.select(key, "text").where("text is not null")
    if not _small(dictionary, most):
        return _met(texts, dictionary, key).groupBy(key).agg(F.array_sort(F.collect_set(F.struct("ord", "phrase"))).alias("found"))
    phrases = _rows(dictionary)

    def run(batches):
        find = Automaton([p for _, p in phrases])
        kind = pa.list_(pa.struct([("ord", pa.int64()), ("phrase", pa.string())]))
        for batch in batches:
            found = [sorted(find.found(t)) for t in batch.column("text").to_pylist()]
            on = pa.array([bool(f) for f in found], pa.bool_())
            lists = pa.array([[{"ord": phrases[n][0], "phrase": phrases[n][1]} for n in f] for f in found if f], kind)
            yield pa.RecordBatch.from_arrays([batch.column(key).filter(on), lists], [key, "found"])

    return texts.mapInArrow(run, f"`{key}` {dict(texts.dtypes)[key]}, found array<struct<ord:long,phrase:string>>")


def phrases_replaced(texts: DataFrame, dictionary: DataFrame, key: str, padded: bool = False, most: int = AUTOMATON) -> DataFrame:
    """(key, text, hits) of each text (key, text) after each phrase of dictionary (ord, phrase, replacement) in its order.

    A phrase that the text holds is replaced wherever it stands, a null replacement deletes it; padded asks for a space on both sides of one place, the text's ends counting as
    spaces. hits lists the ord of what was replaced. Rows of equal ord follow each other by phrase; null texts stay null.
    """
    dictionary = dictionary.select(F.col("ord").cast("long").alias("ord"), "phrase", F.coalesce("replacement", F.lit("")).alias("replacement")).where("phrase <> '' and ord is not null").distinct()
    texts = texts.select(key, "text")
    if not _small(dictionary, most):
        return _replaced_in_rounds(texts, dictionary, key, padded)
    rows = _rows(dictionary, "replacement")

    def run(batches):
        find = Automaton([p for _, p, _ in rows])

        def rewritten(text):
            last, hits = -1, []
            while True:
                later = sorted(n for n in find.found(text) if n > last)
                last = next((n for n in later if not padded or f" {rows[n][1]} " in f" {text} "), None)
                if last is None:
                    return text, hits
                text = text.replace(rows[last][1], rows[last][2])
                hits.append(rows[last][0])

        for batch in batches:
            out = [(None, []) if t is None else rewritten(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([t for t, _ in out], pa.string()), pa.array([h for _, h in out], pa.list_(pa.int64()))], [key, "text", "hits"])

    return texts.mapInArrow(run, f"`{key}` {dict(texts.dtypes)[key]}, text string, hits array<long>")


def _replaced_in_rounds(texts: DataFrame, dictionary: DataFrame, key: str, padded: bool) -> DataFrame:
    """As phrases_replaced: each round replaces the next phrase of each text that still holds one."""
    staging = Staging(texts.sparkSession, "phrases")
    ranked = dictionary.select(F.struct("ord", "phrase").alias("place"), "phrase", "replacement", F.col("ord").alias("number"))
    now = staging.put(texts.select(key, "text", F.array().cast("array<long>").alias("hits"), F.lit(None).cast("struct<ord:long,phrase:string>").alias("last"), F.lit(True).alias("open")))
    while now.where("open").limit(1).count():
        rows = now.where("open")
        held = _met(rows, dictionary, key).join(rows.select(key, "text", "last"), key).where(F.col("last").isNull() | (F.struct("ord", "phrase") > F.col("last")))
        if padded:
            held = held.where(F.contains(F.concat(F.lit(" "), "text", F.lit(" ")), F.concat(F.lit(" "), "phrase", F.lit(" "))))
        first = held.groupBy(key).agg(F.min(F.struct("ord", "phrase")).alias("place")).join(ranked, "place").drop("place")
        step = now.join(first, key, "left")
        hit = F.col("phrase").isNotNull()
        now = staging.put(step.select(key, F.when(hit, F.replace("text", F.col("phrase"), F.col("replacement"))).otherwise(F.col("text")).alias("text"), F.when(hit, F.array_append("hits", F.col("number"))).otherwise(F.col("hits")).alias("hits"), F.when(hit, F.struct(F.col("number").alias("ord"), "phrase")).otherwise(F.col("last")).alias("last"), hit.alias("open")))
    return now.select(key, "text", "hits")


def padded_by_spaces(text: Column, phrase: Column) -> Column:
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def brands_recognised(names: DataFrame, brands: DataFrame, redirects: DataFrame, key: str, most: int = AUTOMATON) -> DataFrame:
    """(key, brand, name) of names (key, text, brand), with the brands table (ord, brand, enabled) and redirects (brand, target) of disabled ones.

    A given brand that is enabled stays. Else the first enabled brand in order that stands between spaces in the name is taken, else the first that stands in it
    anywhere; else a disabled brand's target, or itself; else a brand of two letters or more; else null. A brand that was given or found is taken out of the name.
    """
    enabled = brands.where("enabled").select("ord", F.col("brand").alias("phrase"))
    given = names.join(enabled.select(F.col("phrase").alias("brand"), F.lit(True).alias("known")).distinct(), "brand", "left")
    found = phrases_in(given.where("known is null"), enabled, key, most)
    rows = given.join(found, key, "left")
    alone = F.filter("found", lambda p: padded_by_spaces(F.col("text"), p["phrase"]))
    first = F.coalesce(F.get(alone, 0)["phrase"], F.get("found", 0)["phrase"])
    rows = rows.select(key, "text", "brand", F.when(F.col("known"), F.col("brand")).otherwise(first).alias("taken"))
    off = brands.where("not enabled").select("brand", F.lit(True).alias("off")).distinct().join(redirects.select("brand", "target"), "brand", "left")
    rows = rows.join(off, "brand", "left")
    other = F.when(F.col("off"), F.coalesce("target", "brand")).when(F.length("brand") >= 2, F.col("brand"))
    return rows.select(key, F.coalesce("taken", other).alias("brand"), F.when(F.col("taken").isNotNull(), F.replace("text", F.col("taken"), F.lit(""))).otherwise(F.col("text")).alias("name"))
