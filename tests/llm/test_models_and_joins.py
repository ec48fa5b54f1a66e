"""Language-model scores, toxicity, vectors, components and the pipeline against plain versions and held-out rows."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer
from pyspark.sql import functions as F

from tallymart.llm import embed_dedup, lm, queries, toxicity
from tallymart.llm.common import table
from tallymart.llm.tokenizing import tokenizer_path
from tallymart.llm.components import components
from tallymart.llm.crf import Crf, padded


def rows(df):
    return [r.asDict() for r in df.collect()]


def plain_base(texts):
    """{(id, text): (held_out, n, known, N, base)} as the contract states it."""
    words = [(i, t, (t or "").encode().lower().split() + [b"\n"]) for i, t in texts]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = collections.Counter(w for i, _, ws in words if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, out(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, _, ws in words]


def test_lm_base_and_gain(spark, sf_dir, messy, empty):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = messy.select("doc_id", "text").unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000))
    found = rows(lm.score_texts(df))
    expected = plain_base([(r["doc_id"], r["text"]) for r in df.collect()])
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found), key=key)
    for a, b in zip(got, sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert lm.score_texts(empty).count() == 0
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def plain_tree(train, a, cost, least, depth):
    """log10 P(word | words before) by the tree's definition, over dictionaries."""
    uni = collections.Counter(w for d in train for w in d)
    n, v = sum(uni.values()), len(uni)
    p0 = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    frequent = {w for w in uni if uni[w] >= least or w == "\n"}
    kept: list[dict] = []

    def chance(before, w, upto):
        p = p0(w)
        for k in range(1, upto + 1):
            s = tuple(before[-k:])
            if len(before) < k or before[-k] not in frequent:
                break
            if s in kept[k - 1]:
                own, left = kept[k - 1][s]
                p = own[w] if w in own else left * p
        return p

    for k in range(1, depth + 1):
        whole, by = collections.Counter(), collections.defaultdict(collections.Counter)
        for d in train:
            for i in range(k, len(d)):
                s = tuple(d[i - k : i])
                if all(x in frequent for x in s):
                    whole[s] += 1
                    if d[i] in frequent:
                        by[s][d[i]] += 1
        level = {}
        for s, nxt in by.items():
            nxt = {w: c for w, c in nxt.items() if c >= least}
            if not nxt:
                continue
            rest = whole[s] - sum(nxt.values())
            lower = {w: chance(s, w, k - 1) for w in nxt}
            own = {w: (c + (rest + a) * lower[w]) / (whole[s] + a) for w, c in nxt.items()}
            left = (rest + a) / (whole[s] + a)
            if sum(c * math.log(own[w] / lower[w]) for w, c in nxt.items()) + rest * math.log(left) > cost * (1 + len(nxt)):
                level[s] = own, left
        kept.append(level)
    return (lambda before, w: chance(before, w, depth)), [len(x) for x in kept]


@pytest.mark.parametrize("bucket,depth,alphabet", [(1_500_000, 4, 1_000_000), (20, 4, 1_000_000), (60, 2, 1_000_000), (200, 1, 1_000_000), (1_500_000, 4, 0), (1_500_000, 4, 12), (20, 4, 12), (60, 2, 31)])
def test_lm_tree_equals_definition(spark, monkeypatch, bucket, depth, alphabet):
    """Also where most contexts are split over many buckets, those of the greatest depth too, and where few or no words are broadcast."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    passage = [rng.choice(words) for _ in range(40)]
    texts = []
    for i in range(150):
        d = [rng.choice(words) if rng.random() < 0.9 else f"rare{rng.randrange(400)}" for _ in range(rng.randrange(0, 40))]
        x = [rng.randrange(4) for _ in range(4)]
        for _ in range(30):  # a word that only four before it tell
            x.append((x[-1] + x[-4]) % 4 if rng.random() < 0.95 else rng.randrange(4))
        texts.append((i, " ".join(d + (passage[rng.randrange(10) :] if i % 3 == 0 else [f"w{k}" for k in x]))))
    monkeypatch.setattr(lm, "BUCKET", bucket)
    monkeypatch.setattr(lm, "LITTLE", min(lm.LITTLE, bucket))
    splits = []
    real = lm._split
    monkeypatch.setattr(lm, "_split", lambda *x: splits.append(real(*x)) or splits[-1])
    found = {r["doc_id"]: r["score"] for r in rows(lm.score_texts(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), depth=depth, alphabet=alphabet, cost=2.0))}
    if alphabet > 100:  # contexts that are split hold broadcast words only
        assert (len(splits[0].keys) > 5) == (bucket < 1000) and max(map(len, splits[0].chains), default=0) == depth * (bucket < 1000)
    assert (len(splits[0].keys) > 0) == (bucket < 1000)
    split = {i: t.split() + ["\n"] for i, t in texts}
    p, levels = plain_tree([d for i, d in split.items() if zlib.crc32(str(i).encode()) % 5 != 1], 1.0, 2.0, 2, depth)
    assert all(levels)
    for i, d in split.items():
        assert found[i] == pytest.approx(sum(math.log10(p(d[:k], w)) for k, w in enumerate(d)), rel=1e-9), i


def test_lm_words_beyond_the_broadcast(spark):
    """Nothing depends on how many words are broadcast."""
    texts = [(i, " ".join(f"w{i * k % 37}" for k in range(20))) for i in range(60)] + [(None, None), (7, ""), (61, "once upon"), (61, "once upon")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    one, other = (sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9), round(r["score"], 9)) for r in rows(lm.score_texts(df, alphabet=n))) for n in (5, 1000))
    assert one == other and len(one) == 64


def test_lm_learns_phrases_at_any_size(spark):
    """A phrase that training texts hold twice is learnt among few and among many other texts."""
    rng = random.Random(5)
    phrase = " ".join(f"p{i}" for i in range(40))
    scores = []
    for n in (50, 1500):
        texts = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(40))) for i in range(n)]
        held = next(i for i in range(10_000, 20_000) if zlib.crc32(str(i).encode()) % 5 == 1)
        seen = [i for i in range(20_000, 20_100) if zlib.crc32(str(i).encode()) % 5 != 1][:2]
        df = spark.createDataFrame([*texts, *((i, phrase) for i in (held, *seen))], "doc_id long, text string")
        r = next(r for r in rows(lm.score_texts(df)) if r["doc_id"] == held)
        scores.append(r["score"] - r["base_score"])
    assert min(scores) > 40 * 2


def test_blocks_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 500, dtype=np.uint64))
    counts = np.arange(len(keys)) + 1
    k, c = lm.Blocks.unpack(lm.Blocks.pack(keys, counts))
    assert (k == keys).all() and (c == counts).all()
    k, c = lm.Blocks.total([lm.Blocks.pack(keys, counts), lm.Blocks.pack(keys[::2], counts[::2])])
    assert (k == keys).all() and c[0] == 2 and c[1] == 2
    k, gain = lm.Gains.unpack(lm.Gains.pack(np.array([0, 3, 70_000]), np.array([-1.5, 1e-300, 7.25])))
    assert k.tolist() == [0, 3, 70_000] and gain.tolist() == [-1.5, 1e-300, 7.25]
    columns = [np.arange(7) - 1, np.arange(7) * 100_003, np.full(7, -1)]
    assert (lm.Places.unpack(lm.Places.pack(columns), 3) == np.stack(columns)).all()


def labelled(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 7))) for _ in range(3000)]
    bad = ["grukk", "blarf", "zopple"]
    out = []
    for _ in range(n):
        y = rng.random() < 0.2
        d = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        if y:
            for _ in range(rng.randint(1, 4)):
                d.insert(rng.randrange(len(d)), rng.choice(bad) + rng.choice(("", "ed", "ing", "!", ",")))
        out.append((" ".join(d), int(y)))
    return out


def test_toxicity_held_out():
    data = labelled(1400, 1)
    model = toxicity.ToxicityModel(data[:1000])
    found = model(pa.array([t for t, _ in data[1000:]]))
    right = sum((s >= 0.3) == (y == 1) for (s, _), (_, y) in zip(found, data[1000:]))
    assert right >= 0.98 * 400
    for (s, spans), (t, y) in zip(found, data[1000:]):
        assert all(any(b in t[a:e] for b in ("grukk", "blarf", "zopple")) for a, e, _ in spans)
    assert model(pa.array([" \n grukk x"]))[0][1][0][:2] == (3, 8)


def test_toxicity_equals_whole_chains():
    """Scores and marginals by windows against those of a chain over every token of each text."""
    data = labelled(700, 4)
    model = toxicity.ToxicityModel(data[:600])
    texts = [t for t, _ in data[600:]] + [" ".join(["grukk", "blarf"] * 3_000), " ".join(["zopple"] + ["la"] * 40) * 3, "", "grukk", " ".join(t for t, _ in data[600:640])]
    bounds, codes, _ = model.codes(pa.array(texts))
    windows = model._probabilities(bounds, codes)
    for d, (found, t) in enumerate(zip(windows, texts)):
        a, b = int(bounds[d]), int(bounds[d + 1])
        e = model.crf.emissions(model.rows(codes[a:b])[None])
        whole = model.crf.marginals(e, np.array([b - a]))[0, :, 1]
        assert [k for k, _ in sorted(found)] == np.flatnonzero(codes[a:b]).tolist()
        assert max((abs(p - whole[k]) for k, p in found), default=0.0) < toxicity.FORGET
        score = 1 / (1 + math.exp(-float(np.dot(model._summary([(int(k), float(whole[k])) for k in np.flatnonzero(codes[a:b])], b - a), model.logistic))))
        assert model(pa.array([t]))[0][0] == pytest.approx(score, abs=1e-3)


def test_toxicity_is_reproducible(spark):
    """Of texts that share an id, always the same one is learnt from."""
    data = [(i % 150, t, y) for i, (t, y) in enumerate(labelled(300, 5))]
    docs, labels = spark.createDataFrame([d[:2] for d in data], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in data[:150]], "doc_id long, toxic int")
    one, other = (toxicity.train(d, labels) for d in (docs.repartition(3), docs.repartition(5, "text")))
    assert one.cues == other.cues and one.rate == other.rate


def test_toxicity_small_samples():
    for data in ([], [("a b", 1)], [("a b", 0)], [("", 0), ("", 1)], labelled(30, 2)):
        score, spans = toxicity.ToxicityModel(data)(pa.array(["", "some text"], pa.string()))[0]
        assert 0 <= score <= 1 and spans == []


def test_toxicity_tables(spark, sf_dir, messy, empty):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    assert toxicity.score_toxicity(messy, model).count() == messy.count()
    assert toxicity.score_toxicity(empty, model).count() == 0
    kept = toxicity.keep_clean(messy, model)
    assert kept.columns == messy.columns
    assert toxicity.keep_clean(empty, model).count() == 0
    odd = spark.createDataFrame([(1, None, 1), (None, 1, 1), (2, 0, 1), (2, 0, 0), (3, 0, None)], "doc_id long, quality int, toxic int")
    assert toxicity.train(messy, odd).cues == {}
    assert queries.op6_toxicity(spark, sf_dir).count() == docs.count()


def test_crf_against_enumeration():
    rng = np.random.default_rng(2)
    crf = Crf(4, 3)
    crf.weights[1:], crf.moves[:], crf.first[:] = rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    x, lengths = padded([[[1, 2], [3, 0], [4, 1]], [[2, 0]], [[1, 0], [4, 0]]], 2)
    e = crf.emissions(x)
    marginals, path = crf.marginals(e, lengths), crf.viterbi(e, lengths)
    for i, n in enumerate(lengths):
        total, at, best = 0.0, np.zeros((n, 3)), (-np.inf, None)
        for tags in np.ndindex(*(3,) * n):
            s = crf.first[tags[0]] + sum(e[i, k, t] for k, t in enumerate(tags)) + sum(crf.moves[a, b] for a, b in zip(tags, tags[1:]))
            total += math.exp(s)
            for k, t in enumerate(tags):
                at[k, t] += math.exp(s)
            best = max(best, (s, tags))
        assert np.allclose(marginals[i, :n], at / total)
        assert tuple(path[i, :n]) == best[1]


def plain_vectors(data):
    ok = [x is not None and len(x) and all(v is not None and math.isfinite(v) for v in x) and any(v != 0 for v in x) and lab is not None for _, x, lab in data]
    n, root, links = len(data), list(range(len(data))), [0] * len(data)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and data[i][2] == data[j][2] and len(data[i][1]) == len(data[j][1]):
                a, b = np.array(data[i][1]), np.array(data[j][1])
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    p, q = root[i], root[j]
                    root = [min(p, q) if r in (p, q) else r for r in root]
    least = [min((data[k][0] for k in range(n) if root[k] == root[i] and data[k][0] is not None), default=None) for i in range(n)]
    return collections.Counter((d[0], k, c, d[0] is not None and d[0] == c) for d, k, c in zip(data, links, least))


def test_vectors_of_any_size(spark):
    """Components whose squares over- or underflow in double, and labels that are texts."""
    data = [(1, [1e-170, 2e-170], "x"), (2, [1e160, 2e160], "x"), (3, [1.0, 2.0], "x"), (4, [1.0, 2.0], "y"), (5, [2.0, -1.0], "x"), (6, [5e-324, 1e-323], "x"), (7, [1e308, 1.7e308], "x")]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows(embed_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label string")))}
    assert found == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (0, 4), 5: (0, 5), 6: (4, 1), 7: (4, 1)}


def test_hot_label_is_sent_few_times(spark, monkeypatch):
    """The blocks of one label are sent once for each tile, not for each block."""
    monkeypatch.setattr(embed_dedup, "BLOCK", 64)
    monkeypatch.setattr(embed_dedup, "TILE_BYTES", 64 * 16 * 8 * 8)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4_000, 16)) * 0.02 + 1  # all near each other
    data = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    sent = []
    real = embed_dedup.written

    def written(df, what, *a):
        out = real(df, what, *a)
        if what == "wanted":
            sent.append(out.count())
        return out

    monkeypatch.setattr(embed_dedup, "written", written)
    found = rows(embed_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label long")))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert sorted((r["vec_id"], r["n_links"]) for r in found) == list(enumerate(((unit @ unit.T >= 0.98).sum(1) - 1).tolist()))
    blocks = -(-4_000 // 64)
    assert sent[0] <= blocks * (blocks / 8 + 6)


@pytest.mark.parametrize("block,many", [(8, 64), (8, 0), (2048, 64)])
def test_vectors(spark, monkeypatch, block, many):
    """Also where the blocks of every label meet by cells of two directions."""
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    monkeypatch.setattr(embed_dedup, "MANY", many)
    monkeypatch.setattr(embed_dedup, "TILE_BYTES", block * 6 * 8 * 3)
    monkeypatch.setattr(embed_dedup, "LEAF", 4)
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(12, 6))
    data = []
    for i in range(160):
        v = centre[i % 12] + rng.normal(size=6) * rng.choice([0.02, 0.15, 1.0])
        data.append((i, [float(x) for x in v], int(i % 5) if i % 17 else None))
    data += [(200 + i, data[3][1], data[3][2]) for i in range(20)]
    data += [(300, None, 1), (301, [], 1), (302, [0.0] * 6, 1), (303, [float("nan")] + [1.0] * 5, 1), (304, [None] + [1.0] * 5, 1), (305, [float("inf")] + [1.0] * 5, 1), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1), (None, [2.0, 4.0], 1), (None, [9.0, -4.0], 1), (5, data[5][1], data[5][2])]
    df = spark.createDataFrame([(*d, "x", 1, "y") for d in data], "vec_id long, embedding array<double>, label int, key string, block int, vector string")
    found = embed_dedup.near_vectors(df)
    assert collections.Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows(found)) == plain_vectors(data)
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_components(spark, empty):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(5, 5), (None, 3), (1, 0), (1, 0)]
    root = {x: x for e in edges for x in e if x is not None}
    for _ in range(200):
        for a, b in edges:
            if a is not None and b is not None:
                root[a] = root[b] = min(root[a], root[b])
    found = {r["node"]: r["root"] for r in rows(components(spark.createDataFrame(edges, "a long, b long")))}
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert all(root[n] == r for n, r in found.items())
    assert {n for n in linked if root[n] != n} == {n for n, r in found.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, sf_dir, tmp_path, messy):
    import corpus_pipeline as P

    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    assert [n for n, _ in P.STAGES] == ["quality", "toxicity", "near_duplicates", "pii", "packing"]
    done, columns, counts = docs, docs.columns, []
    for k, (name, stage) in enumerate(P.STAGES):
        before = done
        stage(spark, done, sf_dir).write.parquet(str(tmp_path / name))
        done = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert done.columns == columns
            assert done.join(before, "doc_id", "left_anti").count() == 0
        counts.append(done.count())
    assert counts[0] > counts[2] == counts[3] > 0
    kept = spark.read.parquet(str(tmp_path / "quality")).join(labels, "doc_id").groupBy("quality").count().collect()
    assert {r["quality"]: r["count"] for r in kept}.get(1, 0) > 0
    assert sorted(map(tuple, P.run(spark, sf_dir).select("doc_id", "piece", "length").collect())) == sorted(map(tuple, done.select("doc_id", "piece", "length").collect()))
    good = spark.read.parquet(str(tmp_path / "near_duplicates")).orderBy("doc_id").first()["text"]
    some = spark.createDataFrame([(90_020, good), (90_020, good), (90_021, good), (None, good)], "doc_id long, text string")
    odd = docs.unionByName(some, allowMissingColumns=True).unionByName(messy.select("doc_id", "text"), allowMissingColumns=True)
    for _, stage in P.STAGES:
        odd = stage(spark, odd, sf_dir)
    whole = len(Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode(good, add_special_tokens=False).ids) + 1
    lengths = collections.Counter()
    for r in odd.collect():
        lengths[r["doc_id"]] += r["length"]
    assert not {90_020, 90_021} & set(lengths)  # copies of a document with a smaller id
    assert lengths[None] == whole or "[" in good  # of the rows without an id the good one stays, the messy ones are too short; personal data would be masked
    alone = some.where("doc_id = 90021")
    assert P.quality_stage(spark, alone, sf_dir).count() == 1 and P.toxicity_stage(spark, alone, sf_dir).count() == 0  # no label at all: every score is 0.5
