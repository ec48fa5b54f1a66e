"""Hard negatives by product quantisation with stored residual norms.

Vectors become integers. A codebook for each pair of components, fitted on a bounded sample, gives each vector a code of bytes and the norm of what the code
leaves out. For an anchor, a lookup table turns codes into scores; the true score lies within the anchor's norm times the residual's of that. So a block tells
without its vectors which of its rows may come first, and only those are scored exactly, in integers. The sample changes speed, never results: a vector of
another dimension than the sample's has the zero code and its whole norm as residual.

Anchors are a stated query set (every 100th id) against all rows, in blocks: a task holds a block of anchors with what is best for them so far and reads blocks
of vectors one after another. Blocks hold rows as they come, so neither a label nor repeated vectors make a large group. Only the best rows of each task leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, tasks, tidy, written

BLOCK, ANCHORS, SUB, WIDTH = 4096, 4096, 32, 2
NO_ID = (1 << 63) - 1


def codebooks(sample: np.ndarray, codes: int = 256, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """(parts, codes, WIDTH) centres of the parts of WIDTH components, by Lloyd's rounds from a seeded draw; padded with zeros."""
    n, dim = sample.shape
    parts = -(-dim // WIDTH)
    padded = np.zeros((n, parts * WIDTH))
    padded[:, :dim] = sample
    rng = np.random.default_rng(seed)
    out = np.zeros((parts, codes, WIDTH))
    for p in range(parts):
        x = padded[:, p * WIDTH : (p + 1) * WIDTH]
        centres = x[rng.choice(n, codes, replace=n < codes)]
        for _ in range(rounds):
            near = nearest(x, centres)
            count = np.bincount(near, minlength=codes)
            for w in range(WIDTH):
                total = np.bincount(near, x[:, w], codes)
                centres[:, w] = np.where(count, total / np.maximum(count, 1), centres[:, w])
        out[p] = centres
    return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The index of the centre nearest to each row."""
    return np.argmin((centres**2).sum(1)[None, :] - 2 * (x @ centres.T), axis=1)


def encoded(x: np.ndarray, books: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, residual norms) of integer rows. The norms are upper bounds: they make up for what rounding takes from a table's score."""
    dim = x.shape[1]
    x = x.astype(np.float64)
    whole = np.sqrt((x**2).sum(1))
    if books is None or -(-dim // WIDTH) != len(books):
        return np.zeros((len(x), 0), np.uint8), whole * (1 + 1e-9)
    padded = np.zeros((len(x), len(books) * WIDTH))
    padded[:, :dim] = x
    codes = np.empty((len(x), len(books)), np.uint8)
    left = np.zeros(len(x))
    for p, centres in enumerate(books):
        part = padded[:, p * WIDTH : (p + 1) * WIDTH]
        codes[:, p] = nearest(part, centres)
        left += ((part - centres[codes[:, p]]) ** 2).sum(1)
    return codes, np.sqrt(left) * (1 + 1e-9) + whole * 1e-9


def table_scores(anchors: np.ndarray, books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Scores of anchors (rows) and codes (columns) by lookup."""
    padded = np.zeros((len(anchors), len(books) * WIDTH))
    padded[:, : anchors.shape[1]] = anchors
    out = np.zeros((len(anchors), len(codes)))
    for p, centres in enumerate(books):
        out += np.take(padded[:, p * WIDTH : (p + 1) * WIDTH] @ centres.T, codes[:, p], axis=1)
    return out


def exact(x: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows with one row, in floating point where that is exact."""
    if len(x) and float(np.abs(x).max(initial=0)) * float(np.abs(anchor).max(initial=0)) * max(1, x.shape[1]) < 1 << 53:
        return (x.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    return x @ anchor


def best(score: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id, then by key."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        on = np.flatnonzero(score >= least)
        return on[np.lexsort((keys[on], ids[on], -score[on]))[:k]]
    return np.lexsort((keys, ids, -score))[:k]


class Block:
    """Rows of one dimension: keys, ids (NO_ID for none, known by a negative key), labels as numbers of `known`, integers, codes and residual norms."""

    def __init__(self, row: dict, known: dict[str, int]):
        self.keys, self.ids = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["ids"], np.int64)
        self.labels = np.array([known.setdefault(x, len(known)) for x in row["labels"]], np.int64)
        self.x = np.frombuffer(row["vectors"], row["kind"]).astype(np.int64).reshape(len(self.keys), row["size"])
        self.codes = np.frombuffer(row["codes"], np.uint8).reshape(len(self.keys), len(row["codes"]) // len(self.keys))
        self.left = np.frombuffer(row["left"], np.float64)
        self.norm = np.sqrt((self.x.astype(np.float64) ** 2).sum(1))

    def bounds(self, anchors: np.ndarray, norms: np.ndarray, books: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of anchors (rows) with this block (columns)."""
        about = table_scores(anchors, books, self.codes) if self.codes.shape[1] else np.zeros((len(anchors), len(self.keys)))
        slack = norms[:, None] * (1 + 1e-9) * self.left[None, :]
        return about - slack, about + slack


SCHEMA = pa.schema([("size", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("labels", pa.list_(pa.string())), ("kind", pa.string()), ("vectors", pa.binary()), ("codes", pa.binary()), ("left", pa.binary())])
BLOCK_DDL = "size int, n int, keys binary, ids binary, labels array<string>, kind string, vectors binary, codes binary, left binary"


def integers(lists) -> np.ndarray:
    """floor(256 x) of rows of equal length; ValueError where a score could leave 64 bits."""
    x = np.floor(256.0 * np.asarray(lists, np.float64))
    if x.size and np.abs(x).max() > 1 << 62 or x.size and np.sqrt((x**2).sum(1)).max() >= 1 << 31:
        raise ValueError("components too large: an integer score may leave 64 bits")
    return x.astype(np.int64)


def _blocks(books: np.ndarray | None, most: int):
    """Cuts rows (key, vec_id, label, size, vector), sorted by size, into blocks."""

    def pack(rows: pa.Table):
        rows = rows.combine_chunks()
        x = integers(np.asarray(rows["vector"].combine_chunks().flatten(), np.float64).reshape(rows.num_rows, rows["size"][0].as_py()))
        kind = next(k for k in ("<i2", "<i4", "<i8") if not x.size or np.abs(x).max() <= np.iinfo(k).max)
        codes, left = encoded(x, books)
        has = np.asarray(rows["vec_id"].is_valid())
        ids, keys = np.where(has, np.asarray(rows["vec_id"].fill_null(NO_ID)), NO_ID), np.asarray(rows["key"])
        keys = np.where(has, keys, -keys - 1)
        row = {"size": x.shape[1], "n": len(x), "keys": keys.tobytes(), "ids": ids.astype(np.int64).tobytes(), "labels": rows["label"].to_pylist(), "kind": kind, "vectors": x.astype(kind).tobytes(), "codes": codes.tobytes(), "left": left.tobytes()}
        return pa.RecordBatch.from_pylist([row], schema=SCHEMA)

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            held = None
            size = np.asarray(rows["size"])
            cuts = np.r_[0, np.flatnonzero(size[1:] != size[:-1]) + 1, len(size)] if len(size) else np.zeros(1, int)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                last = b == len(size)
                while b - a >= most or (b > a and not last):
                    yield pack(rows.slice(a, min(most, b - a)))
                    a = min(a + most, b)
                if b > a:
                    held = rows.slice(a)
        if held is not None and held.num_rows:
            yield pack(held)

    return run


class Top:
    """The k best rows of each of n lists so far, by score, id and key."""

    def __init__(self, n: int, k: int):
        self.k, self.of = k, [(np.zeros(0, np.int64),) * 3] * n

    def least(self, i: int) -> int | None:
        """The score that a further row must reach, once the list is full."""
        score = self.of[i][0]
        return int(score[-1]) if len(score) == self.k else None

    def add(self, i: int, score, ids, keys) -> None:
        score, ids, keys = (np.r_[a, b] for a, b in zip(self.of[i], (score, ids, keys)))
        on = best(score, ids, keys, self.k)
        self.of[i] = (score[on], ids[on], keys[on])


def _positives(a: Block, b: Block, books, top: Top) -> None:
    """Takes the rows of b into the lists of a's anchors that have the same label and another key."""
    for label in np.intersect1d(a.labels, b.labels).tolist():
        mine, theirs = np.flatnonzero(a.labels == label), np.flatnonzero(b.labels == label)
        some = Block.__new__(Block)
        some.keys, some.codes, some.left = b.keys[theirs], b.codes[theirs], b.left[theirs]
        for s in range(0, len(mine), SUB):
            on = mine[s : s + SUB]
            low, high = some.bounds(a.x[on], a.norm[on], books)
            for i, lo, hi in zip(on.tolist(), low, high):
                other = some.keys != a.keys[i]
                least = top.least(i)
                sure = lo[other]
                if least is None and len(sure) >= top.k:
                    least = np.partition(sure, len(sure) - top.k)[len(sure) - top.k]
                at = theirs[other & (hi >= least)] if least is not None else theirs[other]
                if len(at):
                    top.add(i, exact(b.x[at], a.x[i]), b.ids[at], b.keys[at])


def _negatives(a: Block, b: Block, books, top: Top, low_high: list[list[tuple[int, int]]], first: list[int]) -> None:
    """Takes the rows of b of other labels into the lists of the windows of a's anchors: low <= score <= high, the highest first."""
    for s in range(0, len(a.keys), SUB):
        on = range(s, min(s + SUB, len(a.keys)))
        lows, highs = b.bounds(a.x[s : s + SUB], a.norm[s : s + SUB], books)
        for i, lo, hi in zip(on, lows, highs):
            other, wanted = b.labels != a.labels[i], np.zeros(len(b.keys), bool)
            for w, (least, most) in enumerate(low_high[i], first[i]):
                if least > most:
                    continue
                bar = least if top.least(w) is None else max(least, top.least(w))
                sure = lo[other & (lo >= least) & (hi <= most)]
                if len(sure) >= top.k:
                    bar = max(bar, np.partition(sure, len(sure) - top.k)[len(sure) - top.k])
                wanted |= other & (hi >= bar) & (lo <= most)
            at = np.flatnonzero(wanted)
            if len(at):
                score = exact(b.x[at], a.x[i])
                for w, (least, most) in enumerate(low_high[i], first[i]):
                    inside = (score >= least) & (score <= most)
                    top.add(w, score[inside], b.ids[at[inside]], b.keys[at[inside]])


def windows(positives: list[int], low: int, high: int, of: int) -> list[tuple[int, int]]:
    """The integer scores s with low * p <= of * s <= high * p, as a least and a most for each p."""
    return [(-(-low * p // of), high * p // of) for p in positives]


def _mined(books, k: int, bounds: tuple[int, int, int] | None):
    """Rows sorted by part, its anchors first: what is best for each anchor, or with bounds for each of its windows."""

    def run(batches):
        state, at, known = None, None, {}

        def out():
            a, top, slots, block, _, _ = state
            for i in range(0, len(slots), 2048):
                rows = [(int(a.keys[j]), w, score.tolist(), keys.tolist(), ids.tolist()) for (j, w), (score, ids, keys) in zip(slots[i : i + 2048], top.of[i : i + 2048]) if len(score)]
                flat = [(key, w, s, n, m) for key, w, score, keys, ids in rows for s, n, m in zip(score, keys, ids)]
                if flat:
                    columns = [pa.array(c, pa.int64()) for c in zip(*flat)]
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(flat), pa.int64()), columns[0], columns[1].cast(pa.int32()), *columns[2:]], ["of", "anchor", "slot", "score", "key", "id"])

        for batch in batches:
            for row in batch.to_pylist():
                here = (row["of"], row["chunk"])
                if here != at:
                    if state is not None:
                        yield from out()
                    a, at = Block(row, known), here
                    scores: list[list[int]] = [[] for _ in range(row["n"])]
                    if bounds is not None:
                        place = dict(zip(a.keys.tolist(), range(row["n"])))
                        for x in sorted(row["positives"] or [], key=lambda x: x["slot"]):
                            scores[place[x["anchor"]]].append(x["score"])
                    slots = [(i, w) for i in range(row["n"]) for w in range(1 if bounds is None else len(scores[i]))]
                    asked = None if bounds is None else [windows(p, *bounds) for p in scores]
                    state = (a, Top(len(slots), k), slots, row["of"], asked, np.cumsum([0, *map(len, scores)]).tolist())
                elif bounds is None:
                    _positives(a, Block(row, known), books, state[1])
                else:
                    _negatives(a, Block(row, known), books, state[1], state[4], state[5])
        if state is not None:
            yield from out()

    return run


def _dealt(blocks: DataFrame, anchors: DataFrame, n_asked: int, chunks: int) -> DataFrame:
    """Each block of anchors to each of its parts (of, chunk), and each block of vectors to the part of its chunk with each block of anchors of its dimension."""
    names = ["size", "n", "keys", "ids", "labels", "kind", "vectors", "codes", "left"]
    none = F.lit(None).cast("array<struct<anchor:long,slot:int,score:long>>").alias("positives")
    asked = anchors.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select("of", "chunk", F.lit(0).alias("first"), *names, "positives")
    sizes = anchors.groupBy("size").agg(F.collect_list("of").alias("ofs"))  # eight bytes for ANCHORS anchors
    given = blocks.withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int")).join(sizes, "size").select(F.explode("ofs").alias("of"), "chunk", F.lit(1).alias("first"), *names, none)
    return asked.unionByName(given).repartition(n_asked * chunks, "of", "chunk").sortWithinPartitions("of", "chunk", "first")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each (anchor, slot) with their rank; a slot has at most k rows of each part."""
    w = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id", F.abs("key"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, of: int = 100, sample: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for the rows whose id is divisible by `every` as anchors.

    An anchor's positives are its first other rows of its label, its negatives for each of them the first rows of other labels with
    low * positive_score <= of * negative_score <= high * positive_score; first are higher scores, then smaller ids. Rows with a null label or vector, or null or
    non-finite components, take no part; vectors are compared with those of their dimension. Rows with the same id are separate rows; a row without
    one is never an anchor and comes after all ids. An empty vector scores 0. Components beyond 2**23, whose scores might leave 64 bits, raise ValueError. `sample` bounds what the codebooks are fitted on.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(kind).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).withColumn("size", F.size("vector")).withColumn("key", F.monotonically_increasing_id())
    rows = written(rows, "rows")
    taken = rows.orderBy(F.xxhash64("vec_id", "key"), "key").limit(sample).select("vector").toPandas()["vector"].tolist()
    sizes, counts = np.unique([len(x) for x in taken], return_counts=True) if taken else ([], [])
    some = [x for x in taken if len(x) == sizes[int(np.argmax(counts))]] if taken else []
    books = codebooks(integers(some).astype(np.float64)) if some and len(some[0]) else None
    is_anchor = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    names = ["key", "vec_id", "label", "size", "vector"]
    order = ["size", F.xxhash64("key")]  # rows of all labels in each block

    def blocks(some: DataFrame, most: int, what: str) -> DataFrame:
        parts = max(1, -(-some.count() // (4 * most)))
        cut = some.select(names).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(tidy(_blocks(books, most)), BLOCK_DDL)
        return written(cut.withColumn("block", F.monotonically_increasing_id()), what)

    held, asked = blocks(rows, BLOCK, "blocks"), blocks(rows.where(is_anchor), ANCHORS, "anchors")
    n_blocks, n_asked = held.count(), asked.count()
    if not n_asked:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    chunks = max(1, min(n_blocks, -(-2 * tasks(held) // n_asked)))
    found_ddl = "of long, anchor long, slot int, score long, key long, id long"
    asked = asked.withColumn("of", F.col("block"))
    none = asked.withColumn("positives", F.lit(None).cast("array<struct<anchor:long,slot:int,score:long>>"))
    found = written(_dealt(held, none, n_asked, chunks).mapInArrow(tidy(_mined(books, positives, None)), found_ddl), "positives")
    ranked = _merged(found, positives).select("of", "anchor", (F.col("rank") - 1).cast("int").alias("slot"), "score", F.when(F.col("key") >= 0, F.col("id")).alias("positive_id"))
    first = written(ranked, "first")
    forget(found)
    of_block = first.groupBy("of").agg(F.collect_list(F.struct("anchor", "slot", "score")).alias("positives"))  # a block's anchors with their few positives
    mined = _dealt(held, asked.join(of_block, "of"), n_asked, chunks).mapInArrow(tidy(_mined(books, negatives, (low, high, of))), found_ddl)
    found = written(mined, "negatives")
    last = _merged(found, negatives).select("anchor", "slot", "rank", F.when(F.col("key") >= 0, F.col("id")).alias("negative_id"), F.col("score").alias("negative_score"))
    named = first.select("anchor", "slot", "positive_id", F.col("score").alias("positive_score")).join(rows.select(F.col("key").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return last.join(named, ["anchor", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


#: All anchors against all rows.
ORACLE_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
    SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER w AS INT) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
    WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) QUALIFY row_number() OVER w <= 10"""
