"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

The projection is made of a few columns because array steps build on each other; Spark evaluates them in one stage without
a shuffle, a Python worker or a user function. Repeated windows are found by their 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: What separates words, and the symbols that are counted.
SPACE, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
WINDOW = 8

#: Frequent short words of the four languages.
STOP_WORDS = "the of and to in a is that it for on was be with as by at are this not und der die das den ist nicht mit von zu ein eine auf für im sich dem le la les de des et un une en du que qui dans pour pas sur avec au est el los las del y por con una para se no su al lo es".split()


class Rule(NamedTuple):
    """A text of at least `words` words fails where value / of is above `most` or below `least`; without `of`, the value itself."""

    name: str
    value: str
    of: str
    most: float | None = None
    least: float | None = None
    words: int = 1


#: The production table. Ratios of a part to a whole.
RULES = (
    Rule("symbols", "n_symbols", "word_chars", most=0.06),
    Rule("exclamations", "n_marks", "n_words", most=0.3),
    Rule("long_words", "word_chars", "n_words", most=20.0),
    Rule("short_words", "word_chars", "n_words", least=2.0),
    Rule("stop_words", "n_stop_words", "n_words", least=0.02, words=100),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=0.5, words=1),
    Rule("length", "n_words", "", most=1e6),
)


def failing(rules: Sequence[Rule], c: str = "") -> Column:
    """Whether any rule of the table fails, over columns of counts that follow the prefix c. A ratio to zero doesn't fail."""
    out = F.lit(False)
    for r in rules:
        value, whole = F.col(c + r.value).cast("double"), F.col(c + r.of).cast("double") if r.of else F.lit(1.0)
        bad = F.lit(False)
        if r.most is not None:
            bad = bad | (value > F.lit(r.most) * whole)
        if r.least is not None:
            bad = bad | (value < F.lit(r.least) * whole)
        out = out | ((whole > 0) & (F.col(c + "n_words") >= r.words) & bad)
    return out


def _let(value: Column, use) -> Column:
    """use(value) with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more, of the hashes of all windows by position."""

    def marked(s):
        n = F.size(s)

        def start(k):
            here = F.get(s, k)
            twin = ((k > 0) & (F.get(s, k - 1)["h"] == here["h"])) | ((k < n - 1) & (F.get(s, k + 1)["h"] == here["h"]))
            return F.when(twin, here["i"])

        return F.array_sort(F.filter(F.transform(F.sequence(F.lit(0), n - 1), start), lambda i: i.isNotNull()))

    def merge(acc, i):
        return F.struct((acc["c"] + F.least(F.lit(WINDOW), i - acc["at"])).alias("c"), i.alias("at"))

    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    start = F.struct(F.lit(0).alias("c"), F.lit(-WINDOW).alias("at"))
    return _let(ordered, lambda s: F.aggregate(marked(s), start, merge, lambda acc: acc["c"]))


def _counted(docs: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """docs with a struct of the counts of the text added, and its name."""
    t, w, ls, h, c = unused(docs, "t", "w", "l", "h", "counts")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    words = F.filter(F.split(F.translate(F.col(t), SPACE[1:], " " * (len(SPACE) - 1)), " "), lambda x: x != "")
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: F.translate(x, SPACE, "") != "")
    hashed = F.transform(w, lambda x: F.xxhash64(x))
    windows = F.when(F.size(w) < WINDOW, F.array().cast("array<bigint>")).otherwise(
        _let(hashed, lambda x: F.transform(F.sequence(F.lit(1), F.size(x) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(x, i, WINDOW))))
    )
    rows = docs.select("*", text.alias(t)).select("*", words.alias(w), lines.alias(ls)).select("*", windows.alias(h))
    repeats = F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(F.col(h))).otherwise(F.lit(0))
    counts = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
        F.size(ls).cast("long").alias("n_lines"),
        (F.char_length(t) - F.char_length(F.translate(t, "!", ""))).cast("long").alias("n_marks"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    return rows.select(*docs.columns, counts.alias(c)), c


def _base_failed(c: str) -> Column:
    return (F.col(c + "n_words") < 20) | (F.lit(100) * F.col(c + "n_repeat_words") > F.lit(30) * F.col(c + "n_words"))


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed and kept for each row.

    A null or empty text has no words and fails. Repeated rows and null ids are rows like others; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, c = _counted(rows, "text")
    rows = rows.select("doc_id", f"{c}.*", _base_failed(f"{c}.").alias("base_failed"))
    return rows.withColumn("kept", ~F.col("base_failed") & ~failing(rules))


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of documents (text column `text`) that the rules keep, with all their columns.

    The verdict drives a generator that gives a row or none: a filter would be pushed below the projection of the counts and repeat it for each of its terms.
    """
    rows, c = _counted(docs, "text")
    good = ~(_base_failed(f"{c}.") | failing(rules, f"{c}."))
    return rows.select(*docs.columns, F.explode(F.when(good, F.array(F.lit(True))))).select(docs.columns)
