"""Licence scans: ordered signature rules, gated by keywords, whose overlapping detections are resolved by priority and containment.

Everything is one projection of built-in functions: no shuffle, no Python worker. A text becomes its words, each between two spaces of its own, so that
matches of whole words may follow each other. One expression of all keywords passes over each text; only texts that hold one are asked which, and only rules of
those keywords are tried. A detection goes where another one of a prior class, or a longer one of its class, covers its words.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import Rule, rules

#: What parts words, and the phrases of the base with their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
PHRASE_WEIGHT = 0.8125

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULE = "array<struct<number:int,label:string,keyword:string,pattern:string,priority:int,weight:double>>"
_SPAN = "array<struct<start:int,end:int,priority:int,number:int,label:string,weight:double>>"


def spaced(words: str) -> str:
    """Words or a pattern of them as they stand in a prepared text: two spaces between, one at each end."""
    return f" {words.replace(' ?', '(?: )?').replace(' ', '  ')} "


def compiled(table: Sequence[Rule]) -> list[dict]:
    """The rules with keywords and patterns for prepared texts. A keyword is the beginning of a word, or several words with the beginning of another."""
    return [r._asdict() | {"keyword": spaced(r.keyword)[:-1], "pattern": spaced(f"(?:{r.pattern})")} for r in table]


def gate(keywords: Sequence[str]) -> str:
    """One expression of all keywords, branching by their first letters."""
    by_letter: dict[str, list[str]] = defaultdict(list)
    for k in sorted(keywords):
        by_letter[k[1]].append(re.escape(k[2:]).replace(r"\ ", " "))
    return f" (?:{'|'.join(f'{first}(?:{"|".join(rest)})' for first, rest in by_letter.items())})"


def _words(s: Column) -> Column:
    return F.shiftright(F.char_length(s) - F.char_length(F.replace(s, F.lit(" "), F.lit(""))), 1)


def _of_rule(d: Column, r: Column) -> Column:
    """The spans of a rule's matches in a prepared text, as places of words, end exclusive."""
    matches = F.regexp_extract_all(d, r["pattern"], F.lit(0))
    steps = lambda found: F.arrays_zip(F.split(d, r["pattern"], -1).alias("gap"), found.alias("match"))  # noqa: E731  the last gap has no match

    def step(acc, x):
        start = acc["at"] + _words(x["gap"])
        end = start + _words(x["match"])
        span = F.struct(start.alias("start"), end.alias("end"), r["priority"].alias("priority"), r["number"].alias("number"), r["label"].alias("label"), r["weight"].alias("weight"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    whole = lambda found: F.aggregate(F.filter(steps(found), lambda x: x["match"].isNotNull()), start, step, lambda acc: acc["out"])
    return F.flatten(F.transform(F.array(matches), lambda found: F.when(F.size(found) > 0, whole(found)).otherwise(F.array().cast(_SPAN))))


def _kept(spans: Column, classes: int) -> Column:
    """The spans that no other covers of a prior class, or of the same class being longer or, with the same words, an earlier rule; by start.

    In order of starts, longer ones first, what covers a span stands before it, so the furthest end of each class so far decides.
    """
    ordered = F.array_sort(spans, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).when(x["end"] != y["end"], y["end"] - x["end"]).when(x["priority"] != y["priority"], x["priority"] - y["priority"]).otherwise(x["number"] - y["number"]))

    def step(acc, x):
        covered = F.exists(F.slice(acc["ends"], 1, x["priority"]), lambda e: e >= x["end"])
        ends = F.transform(acc["ends"], lambda e, i: F.when(i + 1 == x["priority"], F.greatest(e, x["end"])).otherwise(e))
        return F.struct(ends.alias("ends"), F.when(covered, acc["out"]).otherwise(F.array_append(acc["out"], x)).alias("out"))

    start = F.struct(F.array_repeat(F.lit(0), classes).alias("ends"), F.array().cast(_SPAN).alias("out"))
    return F.aggregate(ordered, start, step, lambda acc: acc["out"])


def find_licenses(docs: DataFrame, table: Sequence[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places (label, n, first and last of each phrase of the base that occurs) and detections (start, end, priority, number, label, weight) of each row.

    Starts and ends count words from 0, ends are exclusive. A null text is empty: it has no words and no detections. Repeated rows and null ids are rows
    like others, other columns are ignored, and an empty table gives no rows. Of rules with equal words in one class the first stays.
    """
    table = compiled(rules() if table is None else table)
    keywords = sorted({r["keyword"] for r in table})
    known = F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), _RULE)
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.trim(F.regexp_replace(text, SEPARATORS, " ")).alias("t"))
    d = rows.select("doc_id", F.when(F.col("t") == "", "").otherwise(F.concat(F.lit(" "), F.replace("t", F.lit(" "), F.lit("  ")), F.lit(" "))).alias("d"))

    hits = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains("d", k))
    spans = F.flatten(F.transform(F.array(hits), lambda h: F.flatten(F.transform(F.filter(known, lambda r: F.array_contains(h, r["keyword"])), lambda r: _of_rule(F.col("d"), r)))))
    found = F.when(F.col("d").rlike(gate(keywords)), _kept(spans, max((r["priority"] for r in table), default=1))).otherwise(F.array().cast(_SPAN))

    n_words = _words(F.col("d"))
    phrases = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(spaced(p)).alias("p"), F.lit(len(p.split())).alias("of")) for p, label in PHRASES])

    side = lambda p, n: F.call_function("substring_index", F.col("d"), p, n)

    def place(b):
        first, last = _words(side(b["p"], F.lit(1))), _words(F.col("d")) - _words(side(b["p"], F.lit(-1))) - b["of"]
        return F.struct(b["label"].alias("label"), F.regexp_count("d", b["p"]).alias("n"), first.alias("first"), last.alias("last"))

    places = F.transform(F.filter(phrases, lambda b: F.contains("d", b["p"])), place)
    return d.select("doc_id", n_words.cast("long").alias("n_words"), places.alias("places"), found.alias("detections"))


def license_digest(found: DataFrame) -> DataFrame:
    """Of find_licenses(): n_base, first_word and last_word of the base's places, its labels and all labels, and as score the weight of the strongest detection."""
    own = F.transform("places", lambda p: p["label"])
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    weights = F.concat(F.transform("detections", lambda x: x["weight"]), F.transform("places", lambda _: F.lit(PHRASE_WEIGHT)))
    return found.select(
        "doc_id", "n_words", F.aggregate("places", F.lit(0), lambda s, p: s + p["n"]).cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["first"])).cast("long").alias("first_word"), F.array_max(F.transform("places", lambda p: p["last"])).cast("long").alias("last_word"),
        listed(own).alias("base_labels"), listed(F.concat(own, F.transform("detections", lambda x: x["label"]))).alias("labels"), F.coalesce(F.array_max(weights), F.lit(0.0)).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )


def oracle() -> str:
    """The digest in SQL, with rules as rows and detections as rows that are compared with each other."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({r['number']}, {quoted(r['label'])}, {quoted(r['keyword'])}, {quoted(r['pattern'])}, {r['priority']}, {r['weight']!r}::DOUBLE)" for r in compiled(rules()))
    phrases = ", ".join(f"({quoted(label)}, {quoted(spaced(p))}, {len(p.split())})" for p, label in PHRASES)
    words = lambda x: f"((length({x}) - length(replace({x}, ' ', ''))) // 2)"
    return rf"""WITH r(number, label, keyword, pattern, priority, weight) AS (VALUES {values}), p(label, phrase, size) AS (VALUES {phrases}),
    t AS (SELECT row_number() OVER () AS k, doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}', ' ', 'g'), ' ') AS t FROM documents),
    d AS (SELECT k, doc_id, CASE WHEN t = '' THEN '' ELSE ' ' || replace(t, ' ', '  ') || ' ' END AS d FROM t),
    m AS (SELECT k, r.*, regexp_extract_all(d, pattern) AS ms, string_split_regex(d, pattern) AS gs FROM d JOIN r ON contains(d.d, r.keyword)),
    i AS (SELECT *, unnest(generate_series(1, len(ms))) AS i FROM m WHERE len(ms) > 0),
    s AS (SELECT k, number, label, priority, weight, list_sum([{words('x')} for x in gs[:i]]) + coalesce(list_sum([{words('x')} for x in ms[:i - 1]]), 0) AS a, {words('ms[i]')} AS size FROM i),
    kept AS (SELECT * FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.k = x.k AND y.a <= x.a AND y.a + y.size >= x.a + x.size AND (y.priority, -y.size, y.number) < (x.priority, -x.size, x.number))),
    b AS (SELECT k, label, i, gs, list_sum([{words('x')} for x in gs[:i]]) + (i - 1) * size AS a FROM (SELECT *, unnest(generate_series(1, len(gs) - 1)) AS i FROM (SELECT k, p.*, string_split(d, phrase) AS gs FROM d JOIN p ON contains(d.d, p.phrase)))),
    bs AS (SELECT k, count(*) AS n, min(a) AS first_word, max(a) AS last_word, list(DISTINCT label) AS labels FROM b GROUP BY 1),
    ks AS (SELECT k, count(*) AS n, max(weight) AS weight, list(DISTINCT label) AS labels FROM kept GROUP BY 1)
    SELECT d.doc_id, {words('d.d')} AS n_words, coalesce(bs.n, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(bs.labels), ','), '') AS base_labels,
        coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bs.labels, []), coalesce(ks.labels, [])))), ','), '') AS labels,
        greatest(coalesce(ks.weight, 0), CASE WHEN bs.n > 0 THEN {PHRASE_WEIGHT!r} ELSE 0 END)::DOUBLE AS score, coalesce(ks.n, 0) AS n_detections
    FROM d LEFT JOIN bs ON bs.k = d.k LEFT JOIN ks ON ks.k = d.k"""
