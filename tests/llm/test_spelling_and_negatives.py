"""Spelling variants and hard negatives against plain versions, and defined cases."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from tallymart.llm import hard_negatives as hn
from tallymart.llm import spelling


def near(a, b):
    """Whether exactly one inserted, deleted or replaced code point parts a and b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs, factor=5):
    count = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    forms, out = {}, {}
    for w, n in words.items():
        others = [x for x in words if abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(((-words[x], x) for x in others), default=None)
        forms[w] = best[1] if best and -best[0] >= factor * n else None
        out[w] = (n, len(others))
    def root(w):
        while forms[w]:
            w = forms[w]
        return w
    return {w: (forms[w], root(w), n, k, words[forms[w]] if forms[w] else None) for w, (n, k) in out.items()}


def variants(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r["word"]: tuple(r)[1:] for r in spelling.spelling_variants(df).collect()}


def test_variants_equal_plain_version(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abcdé", k=rng.randint(6, 9))) for _ in range(25)]
    words = []
    for b in base:
        words += [b] * rng.choice((5, 30, 200))
        for _ in range(6):
            k = rng.randrange(len(b))
            words += [rng.choice((b[:k] + b[k + 1 :], b[:k] + rng.choice("abÿz") + b[k:], b[:k] + rng.choice("abcÀ") + b[k + 1 :], b[:k] + b[k : k + 2][::-1] + b[k + 2 :]))] * rng.randint(4, 9)
    words += ["aabbaabb", "aabaabb", "aabbabb", "abcabc", "ABCABC"] * 6 + ["short"] * 9 + ["x" * 3000] * 6 + ["x" * 2999 + "y"] * 40 + ["x" * 3001] * 300 + ["straße×÷"] * 5 + ["mmmmmm"] * 5 + ["mmmmmn"] * 40 + ["mmmmnn"] * 300
    rng.shuffle(words)
    docs = [(k % 31 if k % 37 else None, rng.choice((" ", ", ", "1", "Ā", "\n")).join(words[k : k + 40])) for k in range(0, len(words), 40)] + [(77, None), (78, "")]
    expected = plain_variants(docs)
    assert variants(spark, docs) == expected
    assert sum(f is not None for f, *_ in expected.values()) > 20 and any(r != f for f, r, *_ in expected.values() if f)


@pytest.mark.parametrize("most", [7, 4096])
def test_class_of_many_words_of_the_same_letters(spark, monkeypatch, most):
    """All words of one key, and some that one letter parts from them: no word meets another that isn't near it."""
    monkeypatch.setattr(spelling, "CLASS", most)
    rng = random.Random(5)
    same = sorted({"".join(rng.sample("abcdefgh", 8)) for _ in range(400)})
    words = same + [w[1:] for w in same[:40]] + ["z" + w[1:] for w in same[:60]] + [w[:4] + "h" + w[4:] for w in same[:30]]
    df = spark.createDataFrame(list(enumerate(sorted(set(words)))), "id long, word string")
    found = sorted((r["id"], r["near"]) for r in spelling.near_words(df).collect())
    listed = sorted(set(words))
    assert found == sorted((i, j) for i, a in enumerate(listed) for j, b in enumerate(listed) if near(a, b))


def test_key_of_moves(spark):
    """A key's value is a sum over letters: no two letters have the same value, exchanges are differences."""
    letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    df = spark.createDataFrame([(c,) for c in letters], "c string").select("c", spelling.value(__import__("pyspark").sql.functions.col("c")).alias("v"))
    assert {r["c"]: r["v"] for r in df.collect()} == {c: (k + 1) ** 5 for k, c in enumerate(letters)}


def test_variants_of_messy_rows(spark, messy, empty):
    docs = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert {r["word"]: tuple(r)[1:] for r in spelling.spelling_variants(messy).collect()} == plain_variants(docs)
    assert spelling.spelling_variants(empty).count() == 0


def test_forms_are_followed_to_the_last(spark):
    chain = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(13)] + [("a", "w3"), ("b", "a")], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.followed(chain).collect()} == {w: "w13" for w in ("a", "b", *(f"w{k}" for k in range(13)))}


def plain_negatives(rows):
    """rows of (id, vector, label)."""
    ok = [(i, [math.floor(256 * x) for x in v], str(label), k) for k, (i, v, label) in enumerate(rows) if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, a, label, k in ok:
        if i is None or i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(a, b)), j, other) for j, b, other, m in ok if m != k and len(b) == len(a)]
        for s, j, _ in sorted((x for x in scored if x[2] == label), key=key)[:5]:
            inside = sorted((x for x in scored if x[2] != label and 30 * s <= 100 * x[0] <= 90 * s), key=key)[:10]
            out += [(i, j, r, x[1], s, x[0]) for r, x in enumerate(inside, 1)]
    return collections.Counter(out)


def mined(spark, rows, kind="float", **options):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 1, "k") for i, v, label in rows], f"vec_id long, embedding array<{kind}>, label int, size int, key string")
    return collections.Counter(tuple(r) for r in hn.hard_negatives(df, **options).collect())


def vectors(n, dim, seed, near_copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[n // 2 : n // 2 + near_copies] = x[0] + rng.normal(size=(near_copies, dim)) * 0.01
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float).tolist()


@pytest.mark.parametrize("block,sample", [(64, 200), (4096, 4096), (32, 3)])
def test_negatives_equal_plain_version(spark, monkeypatch, block, sample):
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "ANCHORS", max(2, block // 16))
    rng = random.Random(6)
    rows = [(i if i % 45 else 100 * rng.randint(0, 9), v, rng.randint(0, 3)) for i, v in enumerate(vectors(900, 12, 7, 60))]
    rows += [(5000 + i, rows[7][1], 1) for i in range(70)] + [(None, v, 2) for v in vectors(30, 12, 8)]  # ties, and rows without an id
    rows += [(200, None, 1), (300, rows[0][1], None), (400, [float("nan")] * 12, 1), (500, [None] * 12, 1), (600, [float("inf")] * 12, 2), (700, [], 1), (701, [], 2), (702, [], 1), (800, [0.0] * 12, 1)]
    rows += [(900 + 100 * i, v, i % 2) for i, v in enumerate(vectors(40, 5, 9))]  # another dimension
    assert mined(spark, rows, sample=sample) == plain_negatives(rows)


def test_bounds_hold():
    """A true score lies within the bounds of its code, whatever the code leaves out."""
    rng = np.random.default_rng(2)
    x = np.vstack([rng.integers(-256, 256, (300, 7)), rng.integers(-(1 << 30), 1 << 30, (20, 7)), np.zeros((2, 7), int)]).astype(np.int64)
    for books in (hn.codebooks(x[:100].astype(float)), hn.codebooks(x.astype(float)), None):
        codes, left = hn.encoded(x, books)
        about = hn.table_scores(x, books, codes) if books is not None else 0
        slack = np.sqrt((x.astype(float) ** 2).sum(1))[:, None] * left[None, :]
        true = np.array([[sum(int(p) * int(q) for p, q in zip(a, b)) for b in x] for a in x], float)
        assert (true >= about - slack).all() and (true <= about + slack).all()


def test_codes_spare_work(spark):
    """Of rows that can't come first, most are never scored."""
    v = np.array(vectors(4000, 64, 3))
    x = hn.integers(v)
    books = hn.codebooks(x[:2000].astype(float))
    codes, left = hn.encoded(x, books)
    score, about = x @ x[0], hn.table_scores(x[:1], books, codes)[0]
    slack = np.linalg.norm(x[0]) * left
    tenth = np.partition(about - slack, len(x) - 10)[len(x) - 10]
    wanted = about + slack >= tenth
    assert set(np.argsort(-score)[:10].tolist()) <= set(np.flatnonzero(wanted).tolist()) and wanted.mean() < 0.15  # vectors without any structure: the worst case of codes


def test_windows():
    for p in range(-50, 51):
        (least, most), = hn.windows([p], 30, 90, 100)
        assert [s for s in range(-60, 61) if 30 * p <= 100 * s <= 90 * p] == list(range(least, most + 1))


def test_no_anchors_no_rows_large_components(spark):
    one = [0.5, 0.5]
    assert mined(spark, [(1, one, 0), (2, one, 1)]) == {} and mined(spark, []) == {}
    assert mined(spark, [(100, one, 0)]) == {}
    big = [(100, [2.0**20, 1.0], 0), (1, [2.0**20, 0.0], 0), (2, [2.0**19, 3.0], 1)]
    assert mined(spark, big, "double") == plain_negatives(big)
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(100, [1e30, 1.0], 0), (1, one, 0)], "double")


def test_queries_equal_sql(spark, sf_dir):
    import duckdb

    from tallymart.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name in ("op11_hard_negatives", "op12_spelling_variants", "op13_license_scan"):
        df, expected = QUERIES[name](spark, sf_dir), con.sql(ORACLE_SQL[name])
        by = {c: k for k, c in enumerate(expected.columns)}
        assert sorted(df.columns) == sorted(by)
        assert collections.Counter(tuple(r) for r in df.collect()) == collections.Counter(tuple(r[by[c]] for c in df.columns) for r in expected.fetchall()), name
