"""License scans against a plain version over lists of words, and defined cases."""

import re

import pytest

from tallymart.llm import licenses
from tallymart.llm.license_rules import Rule, rules

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def plain(text, table):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    d = f" {'  '.join(words)} " if words else ""
    at = lambda k: (k - d.count("  ", 0, k)) and d.count(" ", 0, k) // 2
    spans = []
    for r in table:
        key = " " + r.keyword.replace(" ", "  ")
        if key in d:
            spans += [(at(m.start()), at(m.end()), r.priority, r.number, r.label) for m in re.finditer(licenses.spaced(f"(?:{r.pattern})"), d)]
    rank = lambda x: (x[2], x[0] - x[1], x[3])
    kept = [x for x in spans if not any(y[0] <= x[0] and y[1] >= x[1] and rank(y) < rank(x) for y in spans)]
    places = [(k, label) for p, label in BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    base = sorted({label for _, label in places})
    labels = sorted(set(base) | {x[4] for x in kept})
    return len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(base), ",".join(labels), sorted(kept)


TEXTS = [
    "Released under the MIT License. Under the MIT license under the mit LICENSE", "SPDX-License-Identifier: GPL-2.0-or-later", "GNU General Public License, version 3", "gplv2+ or GPL v2 or later, LGPL-2.1 only",
    "Licensed under the Apache License, Version 2.0 (the Licence)", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International; CC BY-NC-SA 4.0, cc by-nc", "mit der Lizenz: unter der MIT-Lizenz", "sous licence publique générale GNU",
    "cc by nc cc by nc cc by nc", "the gnu general public license as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "no words of it", "µLicense licenseß", "mit license " * 3000,
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "All rights reserved. Copyright (c) 2001 A B C all rights reserved", "under the MİT license", "under the mit license\x00apache license version 2",
]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = licenses.find_licenses(df)
    spans = {r["doc_id"]: sorted((x["start"], x["end"], x["priority"], x["number"], x["label"]) for x in r["detections"]) for r in out.collect()}
    return [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], spans[r["doc_id"]]) for r in licenses.license_digest(out).orderBy("doc_id").collect()]


def test_equals_plain_version(spark):
    table = rules()
    assert len(table) > 300 and len({r.number for r in table}) == len(table)
    texts = TEXTS + ["a " + r.pattern.split("(")[0] + " b" for r in table if "(" not in r.pattern] + [None, "", " \n"]
    assert found(spark, texts) == [plain(t, table) for t in texts]


def test_every_rule_is_behind_its_keyword():
    """A pattern can't match a text without its keyword: the keyword's letters are asked for by each of its alternatives."""
    for r in rules():
        options = [re.sub(r"\[[^]]*\]", "s", x) for x in {r.pattern, *re.findall(r"[^|()]+", r.pattern)}]
        assert any(r.keyword.split()[0][:3] in o or r.keyword.split()[-1][:3] in o for o in options), r


def test_ranges_and_ties(spark):
    table = [Rule(0, "a", "x", "x y z", 2, 0.5), Rule(1, "b", "x", "x y", 2, 0.5), Rule(2, "c", "y", "y z w", 2, 0.5), Rule(3, "d", "x", "x y z", 1, 1.0), Rule(4, "e", "w", "w", 1, 1.0), Rule(5, "f", "w", "w", 1, 1.0)]
    df = spark.createDataFrame([(1, "x y z w")], "doc_id long, text string")
    (row,) = licenses.find_licenses(df, table).collect()
    assert [(x["label"], x["start"], x["end"]) for x in row["detections"]] == [("d", 0, 3), ("c", 1, 4), ("e", 3, 4)]


def test_rows_are_kept(spark, messy, empty):
    rows = licenses.license_digest(licenses.find_licenses(messy)).collect()
    assert len(rows) == messy.count()
    none = [r for r in rows if r["doc_id"] in (3, 4, 5)]
    assert len(none) == 3 and all((r["n_words"], r["n_base"], r["first_word"], r["labels"], r["score"]) == (0, 0, None, "", 0.0) for r in none)
    assert licenses.find_licenses(empty).count() == 0


def test_plan_is_native_and_has_no_shuffle(spark, messy):
    plan = licenses.license_digest(licenses.find_licenses(messy))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan) and "from_json" not in plan


@pytest.mark.parametrize("text,label", [("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"), ("gnu general public license, version 3.", "gpl-3.0"), ("under the MIT License", "mit"), ("Apache License, Version 2.0", "apache-2.0"), ("LGPLv2.1+ or lgpl 2.1 or later", "lgpl-2.1-or-later")])
def test_labels(spark, text, label):
    assert label in found(spark, [text])[0][5].split(",")
