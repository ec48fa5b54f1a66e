"""Scalar functions that turn free product names into attributes. All are expressions of built-in functions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of each unit, without a point or comma behind them.
UNIT_SPELLINGS = {
    "cc": ("c", "cc", "c.c", "cl", "ml"),
    "lt": ("l", "lt", "lts", "litro", "litros"),
    "gr": ("g", "gr", "grs", "grms"),
    "kg": ("k", "kl", "kg", "kgr", "kilo", "kilos"),
    "mt": ("m", "mt", "mts", "metro", "metros"),
    "w": ("watts",),
    "lumenes": ("lum",),
    "plaza": ("plazas",),
    "pulgadas": ("pulgada",),
}
MARKED_UNITS = ("cc", "lt", "gr", "kg", "mt")

#: Sizes as they are written, with the word for size before them, and what they are called here.
SIZE_NAMES = {
    "talla xs": "talla xp",
    "talla s": "talla p",
    "talla ch": "talla p",
    "talla ch-m": "talla p-m",
    "talla s-m": "talla p-m",
    "talla l": "talla g",
    "talla l-xl": "talla g-xg",
    "talla xl": "talla xg",
    "talla xxl": "talla xxg",
}

#: Litres of a gallon.
GALLON = 3.785411784

#: How pack counts are written, in the order in which they are tried.
PACK_PATTERNS = (r"(\d+)\s*(?:packs?|unidades?|pack)\s*x", r"(\d+)\s*unidades", r"(\d+)\s*unidad", r"(\d+)\s*unid", r"(\d+)\s*uds", r"(\d+)\s*x\s*", r"\s*[^\S\n\t]+x\s*(\d+)", r"^(\d{1,2})")

#: A stop list of our own for product names.
STOP_WORDS = ("de", "del", "la", "el", "los", "las", "con", "sin", "para", "por", "en", "y", "a", "al", "un", "una", "the", "of", "and")


def unit_name(unit: Column) -> Column:
    """The canonical unit; other texts stay."""
    out = unit
    for name, spellings in UNIT_SPELLINGS.items():
        marks = ("", ".", ",") if name in MARKED_UNITS else ("",)
        out = F.when(unit.isin([s + m for s in spellings for m in marks]), name).otherwise(out)
    return out


def number(text: Column) -> Column:
    """A decimal with a comma or point; blank is 0 and what isn't a number 1."""
    t = F.trim(text)
    return F.when(t == "", 0.0).otherwise(F.coalesce(F.regexp_replace(t, ",", ".").try_cast("double"), F.lit(1.0)))


def scaled(quantity: Column, unit: Column) -> tuple[Column, Column]:
    """Quantity and unit with gallons in litres, centilitres in cc, and small litres and kilos in cc and grams."""
    q = F.when(unit == "galon", quantity * GALLON).when(unit == "cl", quantity * 10.0).otherwise(quantity)
    u = F.when(unit == "galon", "lt").when(unit == "cl", "cc").otherwise(unit)
    small = u.isin("lt", "kg") & (q <= 5)
    return F.when(small, q * 1000.0).otherwise(q), F.when(u.eqNullSafe(F.lit("lt")) & small, "cc").when(u.eqNullSafe(F.lit("kg")) & small, "gr").otherwise(u)


def subset_in_order(words: Column, asked: Column) -> tuple[Column, Column]:
    """Whether the asked words are among the words, in their order though not side by side, and the words without the first such ones."""
    left = F.filter(words, lambda w: F.lit(False))
    start = F.struct(F.lit(0).alias("i"), left.alias("rest"))

    def step(s, w):
        hit = F.coalesce(F.get(asked, s["i"]) == w, F.lit(False))
        return F.struct((s["i"] + hit.cast("int")).alias("i"), F.when(hit, s["rest"]).otherwise(F.concat(s["rest"], F.array(w))).alias("rest"))

    done = F.aggregate(words, start, step)
    return F.coalesce((done["i"] == F.size(asked)) & (F.size(asked) > 0), F.lit(False)), done["rest"]


def is_number(text: Column) -> Column:
    """Digits only, points and commas aside."""
    return F.translate(text, ".,", "").rlike("^[0-9]+$")


def split_digits(text: Column) -> Column:
    """A space between digits and the letters behind them."""
    return F.regexp_replace(text, r"(\d+)([a-zA-Z]+)", "$1 $2")


def degree_points(text: Column) -> Column:
    """Decimal points in degrees; a gl behind the sign goes."""
    return F.regexp_replace(F.regexp_replace(text, r"(\d+),(\d+)°", "$1.$2°"), r"°\s*gl", "°")


def degrees(text: Column) -> Column:
    """The last number with a degree sign, or null."""
    found = F.transform(F.filter(F.split(text, " "), lambda w: w.contains("°")), lambda w: F.replace(w, F.lit("°"), F.lit("")).try_cast("double"))
    good = F.filter(found, lambda x: x.isNotNull())
    return F.try_element_at(good, F.lit(-1))


def without_degrees(text: Column) -> Column:
    """The words that aren't a number of degrees."""
    words = F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: ~(w.contains("°") & F.replace(w, F.lit("°"), F.lit("")).try_cast("double").isNotNull()))
    return F.array_join(words, " ")


def pack_count(text: Column) -> Column:
    """Units by the first pattern that matches, else 1."""
    found = [F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit("")) for p in PACK_PATTERNS]
    return F.coalesce(*found, F.lit("1")).cast("long")


def weight_range(text: Column) -> Column:
    """A range of kilograms as it is written, or ''."""
    return F.regexp_extract(text, r"(?i)((\d+([.,]\d+)?\s*[-–a]\s*\d+([.,]\d+)?)\s*kg)", 1)


def measure(text: Column, units: Sequence[str]) -> tuple[Column, Column]:
    """Quantity and unit (as they are written) of the last number with a unit, spaced or not; '' without one."""
    names = "|".join(sorted((u.replace(".", r"\.") for u in units), key=len, reverse=True))
    last = rf"^.*(?:^|\s)(\d[\d.,]*)\s?({names})(?:\s|$)"
    return F.regexp_extract(text, last, 1), F.regexp_extract(text, last, 2)


def size_name(size: Column) -> Column:
    """The canonical size of a size that the word for it stands before; others, bare letters too, stay, with / as -."""
    s = F.trim(F.replace(size, F.lit("/"), F.lit("-")))
    return reduce(lambda out, kv: F.when(s == kv[0], kv[1]).otherwise(out), SIZE_NAMES.items(), s)


def slug(text: Column) -> Column:
    """Lower case without accents; spaces, underscores and slashes as hyphens."""
    plain = F.translate(F.lower(text), "áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc")
    return F.regexp_replace(plain, "[_ /]", "-")


def price_text(text: Column) -> Column:
    """The whole number of a price as it is written; blank is 0 and what isn't a number null."""
    t = F.trim(F.translate(text, ".$", ""))
    return F.when(t == "", F.lit(0).cast("long")).otherwise(t.try_cast("long"))


def price_quantity(text: Column) -> Column:
    """N of a price written NxP, else 1."""
    return F.coalesce(F.nullif(F.regexp_extract(F.trim(text), r"^(\d+)x", 1), F.lit("")).try_cast("long"), F.lit(1).cast("long"))


def json_price(text: Column) -> Column:
    """The truncated price of structured data; blank is 0."""
    t = F.replace(text, F.lit("$"), F.lit(""))
    return F.when(F.trim(t) == "", F.lit(0).cast("long")).otherwise(F.try_divide(t.try_cast("double"), F.lit(1.0)).try_cast("long"))


def barcode(text: Column) -> tuple[Column, Column]:
    """The barcode without marks and leading zeros, or null; and N of a code written CxN, else null."""
    t = F.split_part(F.trim(F.translate(text, "[]}'", "")), F.lit("-"), F.lit(1))
    code = F.split_part(t, F.lit("x"), F.lit(1)).try_cast("long").cast("string")
    units = F.nullif(F.regexp_extract(t, r"^\d+x(\d+)$", 1), F.lit("")).try_cast("long")
    return code, units


def tags_removed(text: Column) -> Column:
    return F.regexp_replace(text, "<.*?>", "")


def stop_words_removed(text: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Lower case, hyphens as spaces, without stop words and empty words."""
    words = F.split(F.translate(F.lower(text), "-", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(list(stop))), " ")


def mixed_words(text: Column) -> Column:
    """Words that hold both a letter and a digit."""
    return F.filter(F.split(text, " "), lambda w: w.rlike("[0-9]") & w.rlike("[A-Za-z]"))


def replaced(text: Column, dictionary: Sequence[tuple[str, str | None]]) -> Column:
    """Each word of the dictionary replaced wherever it stands, in order; a replacement of None deletes."""
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1] or "")), dictionary, text)


def padded_phrases(text: Column, phrases: Sequence[str]) -> tuple[Column, Column]:
    """The phrases that stand between spaces, space-joined in the phrases' order, and the text with each found phrase taken out."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    found = F.lit("")
    for p in phrases:
        here = padded.contains(f" {p} ")
        found = F.when(here, F.concat(found, F.lit(f" {p}"))).otherwise(found)
        padded = F.when(here, F.replace(padded, F.lit(p), F.lit(" "))).otherwise(padded)
    return F.trim(found), F.rtrim(padded)


def tidied(text: Column) -> Column:
    """Trailing and leading marks, a leading "pack ", points and commas, and repeated spaces."""
    t = F.regexp_replace(F.trim(text), r"[,\-.+– ]+$", "")
    t = F.regexp_replace(t, r"^[:!+ ]+", "")
    t = F.regexp_replace(t, "^pack ", "")
    return F.trim(F.regexp_replace(F.translate(t, ".,", "  "), " +", " "))


def token_sorted(text: Column) -> Column:
    """Lower-cased words of letters and digits in alphabetical order."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.array_sort(words), " ")


def similarity(a: Column, b: Column) -> Column:
    """0 to 100: the likeness of token-sorted texts."""
    return likeness(token_sorted(a), token_sorted(b))


def likeness(x: Column, y: Column) -> Column:
    """0 to 100: one minus the edit distance over the longer length, rounded."""
    longest = F.greatest(F.length(x), F.length(y), F.lit(1))
    return F.round(F.lit(100.0) * (F.lit(1.0) - F.levenshtein(x, y) / longest)).cast("long")


def is_mobile(agent: Column) -> Column:
    return F.lower(agent).rlike("(iphone|mobile|androidtouch)")


def tokens_removed(text: Column, words: Sequence[str]) -> tuple[Column, Column]:
    """The tokens of a list, also with a point or comma behind them, out of a text; its first token always stays. Gives the removed ones and the rest."""
    marked = [w + m for w in words for m in ("", ".", ",")]
    parts = F.split(F.trim(text), " +")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    kept = F.concat(F.slice(parts, 1, 1), F.filter(rest, lambda w: ~w.isin(marked)))
    return F.array_join(F.filter(rest, lambda w: w.isin(marked)), " "), F.array_join(kept, " ")


def scanned_measure(text: Column, units: Sequence[str]) -> tuple[Column, Column]:
    """Quantity and unit of the last token that is a unit behind a number, or a number with a unit glued to it; '' without one."""
    glued = rf"^(\d[\d.,]*)({'|'.join(units)})$"

    def candidate(w, i, words):
        before = F.get(words, i - 1)
        pair = w.isin(list(units)) & (i > 0) & F.coalesce(is_number(before), F.lit(False))
        single = w.rlike(glued)
        value = F.when(pair, F.struct(before.alias("q"), w.alias("u"))).when(single, F.struct(F.regexp_extract(w, glued, 1).alias("q"), F.regexp_extract(w, glued, 2).alias("u")))
        return value

    def last(words):
        found = F.filter(F.transform(words, lambda w, i: candidate(w, i, words)), lambda x: x.isNotNull())
        return F.try_element_at(found, F.lit(-1))

    best = F.element_at(F.transform(F.array(F.split(F.trim(text), " +")), last), 1)
    return F.coalesce(best["q"], F.lit("")), F.coalesce(best["u"], F.lit(""))


def measure_taken(text: Column, units: Sequence[str]) -> Column:
    """(quantity, unit, dimension, rest) of the last token of a text that is a measure, and the tokens without it; blank where there is none.

    From the right: a unit with a number before it takes both, a unit alone counts one, a number glued to a unit is split, and AxB with or without a unit is a dimension
    that ends the search. A decimal comma stays as it is written.
    """
    names = "|".join(re.escape(u) for u in sorted(units, key=len, reverse=True))
    glued = rf"^(\d+(?:[.,]\d+)?)({names})$"
    part = lambda q, u, d, n: F.struct(q.alias("quantity"), u.alias("unit"), d.alias("dimension"), F.lit(n).alias("n"))
    blank = F.lit("")

    def of(words):
        def found(w, i):
            unit, before = w.isin(list(units)), F.get(words, i - 1)
            hit = F.when(unit & (i > 0) & F.coalesce(is_number(before), F.lit(False)), part(before, w, blank, 2)).when(unit, part(F.lit("1"), w, blank, 1))
            hit = hit.when(w.rlike(glued), part(F.regexp_extract(w, glued, 1), F.regexp_extract(w, glued, 2), blank, 1)).when(w.rlike(r"^\d+[xX]\d+[a-zA-Z]*$"), part(blank, blank, w, 1))
            return F.when(hit.isNotNull(), F.struct(i.alias("i"), hit.alias("hit")))

        last = F.try_element_at(F.filter(F.transform(words, found), lambda x: x.isNotNull()), F.lit(-1))
        kept = lambda x: F.filter(words, lambda w, i: x.isNull() | ~((i > x["i"] - x["hit"]["n"]) & (i <= x["i"])))
        value = lambda x, c: F.coalesce(x["hit"][c], blank).alias(c)
        return F.element_at(F.transform(F.array(last), lambda x: F.struct(value(x, "quantity"), value(x, "unit"), value(x, "dimension"), F.array_join(kept(x), " ").alias("rest"))), 1)

    return F.element_at(F.transform(F.array(F.split(F.trim(text), " +")), of), 1)


def packs_taken(text: Column) -> Column:
    """(units, rest) by the pack patterns in their order: the first that matches gives the units, and all its own matches go; while units are one, later patterns are tried on what is left."""
    start = F.struct(F.lit(1).cast("long").alias("units"), text.alias("rest"))

    def step(s, p):
        hit = (s["units"] == 1) & F.coalesce(F.regexp_like(s["rest"], p), F.lit(False))
        units = F.coalesce(F.nullif(F.call_function("regexp_extract", s["rest"], p, F.lit(1)), F.lit("")).try_cast("long"), F.lit(1).cast("long"))
        return F.struct(F.when(hit, units).otherwise(s["units"]).alias("units"), F.when(hit, F.trim(F.regexp_replace(s["rest"], p, ""))).otherwise(s["rest"]).alias("rest"))

    return F.aggregate(F.array(*[F.lit("(?i)" + p) for p in PACK_PATTERNS]), start, step)


def units_taken(text: Column, words: Sequence[str]) -> Column:
    """(units, rest): the number before the first of the words, which both go, else 1 and the text."""
    pattern = rf"(?:^| )(\d+(?:[.,]\d+)?) (?:{'|'.join(words)})(?= |$)"
    found = F.regexp_extract(text, pattern, 1)
    one = F.replace(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), F.trim(F.regexp_extract(text, pattern, 0)), F.lit(" ")), F.lit(" "))
    return F.struct(F.when(found == "", 1.0).otherwise(F.replace(found, F.lit(","), F.lit(".")).try_cast("double")).alias("units"), F.when(found == "", text).otherwise(F.trim(one)).alias("rest"))


def trailing_units(text: Column, words: Sequence[str]) -> Column:
    """The number before the first token of the list, else 1."""
    found = F.regexp_extract(F.concat(F.lit(" "), text, F.lit(" ")), rf" (\d+(?:[.,]\d+)?) (?:{'|'.join(words)}) ", 1)
    return F.when(found == "", 1.0).otherwise(F.replace(found, F.lit(","), F.lit(".")).try_cast("double"))


def cut_out(text: Column, remove: Sequence[str] = (), split_by: str | None = None, take: int = 0) -> Column:
    """What configured extraction does after selecting: trim, remove listed strings, split and take one part (negative counts from the end)."""
    out = F.trim(text)
    for r in remove:
        out = F.replace(out, F.lit(r), F.lit(""))
    if split_by:
        out = F.try_element_at(F.split(out, split_by), F.lit(take + 1 if take >= 0 else take))
    return F.trim(out)


def token_set(a: Column, b: Column) -> Column:
    """The best similarity among the words that both have, those with the rest of the one, and those with the rest of the other."""
    x, y = F.array_distinct(F.split(token_sorted(a), " ")), F.array_distinct(F.split(token_sorted(b), " "))
    both = F.array_sort(F.array_intersect(x, y))
    joined = lambda rest: F.array_join(F.concat(both, F.array_sort(rest)), " ")
    shared, one, other = F.array_join(both, " "), joined(F.array_except(x, y)), joined(F.array_except(y, x))
    return F.greatest(likeness(shared, one), likeness(shared, other), likeness(one, other))


def stock_and_category(stock: Column, category: Column) -> tuple[Column, Column]:
    """Stock without the vocabulary's address, cut to twenty letters, and a category cut to fifty."""
    return F.substring(F.regexp_replace(stock, "^https?://schema.org/", ""), 1, 20), F.substring(category, 1, 50)
