"""Similarity joins of names: pairs by edit distance, found without comparing all names of a group.

Everything works on the distinct names of a group, never on its rows. From `PREFIX` on, names meet in an inverted index of their rarest pieces of
p letters: names within k edits share one of each other's p k + 1 rarest pieces, at places that differ by at most k, and their lengths differ
by at most k; what meets is then compared exactly. Below, the names of a group are dealt to tiles of bounded
size; in a tile a bound from letter counts and lengths leaves out most pairs before any edit distance is computed.
Scores are one minus the edit distance over the longer length, 0 to 100, rounded.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import likeness
from .staged import Staging

#: The least score for which the index is used, that for which its pieces are longer, names of a side of a tile.
PREFIX, FINER, TILE = 80, 90, 1024
#: Letter classes of the bound; merging letters only weakens it.
CLASSES = 48


def allowed(length: Column, least: int) -> Column:
    """Edits of two names of which the longer one has that length, for a score of at least `least`."""
    return F.floor(F.lit((100.5 - least) / 100) * length + F.lit(1e-9)).cast("int")


def piece_length(least: int) -> int:
    """Three letters where every name of three or more has more pieces than the edits that the score leaves it, times three, else two (from PREFIX on, names of two or more have those)."""
    return 3 if least >= FINER else 2


def _pieces(name: str, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(name) - (size - 1)), lambda i: F.struct(F.substring(F.col(name), i, F.lit(size)).alias("piece"), i.alias("at")))


def _longer(name: str, least: int) -> Column:
    """Edits that a partner of the name may need which is longer than it."""
    share = (100.5 - least) / 100
    return F.floor(F.lit(share / (1 - share)) * F.length(name) + F.lit(1e-9)).cast("int")


def _indexed(names: DataFrame, counts: DataFrame, by: Sequence[str], edits: Column, size: int) -> DataFrame:
    """(by, name, edits, piece, at) of the edits * size + 1 rarest pieces of each name of `size` letters or more, which has as many."""
    each = names.where(F.length("name") >= size).withColumn("edits", edits)
    pieces = each.select(*by, "name", "edits", F.explode(_pieces("name", size)).alias("p")).select(*by, "name", "edits", "p.*").join(counts, "piece")
    gathered = pieces.groupBy(*by, "name", "edits").agg(F.array_sort(F.collect_list(F.struct("n", "piece", "at"))).alias("all"))  # a name's own pieces
    return gathered.select(*by, "name", "edits", F.explode(F.slice("all", F.lit(1), F.col("edits") * size + 1)).alias("p")).select(*by, "name", "edits", F.col("p.piece").alias("piece"), F.col("p.at").alias("at"))


def _met(shorter: DataFrame, longer: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, x, y) of names that meet in the index, x no longer than y; the edits are those that y allows."""
    one = shorter.select(*by, "piece", F.col("name").alias("x"), F.col("at").alias("p"))
    two = longer.select(*by, "piece", F.col("name").alias("y"), F.col("at").alias("q"), "edits")
    near = (F.length("x") <= F.length("y")) & (F.length("y") - F.length("x") <= F.col("edits")) & (F.abs(F.col("p") - F.col("q")) <= F.col("edits"))
    return one.join(two, [*by, "piece"]).where(near).select(*by, "x", "y").distinct()


def distances(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Edit distances of rows of padded code points, a letter of all pairs at a time."""
    width = int(ny.max(initial=0)) + 1
    steps = np.arange(width, dtype=np.int32)
    now = np.broadcast_to(steps, (len(x), width)).copy()
    out = np.where(nx == 0, ny, 0)
    for i in range(int(nx.max(initial=0))):
        best = now + 1
        np.minimum(best[:, 1:], now[:, :-1] + (y[:, : width - 1] != x[:, i : i + 1]), out=best[:, 1:])
        now = np.minimum.accumulate(best - steps, axis=1) + steps
        done = np.flatnonzero(nx == i + 1)
        out[done] = now[done, ny[done]]
    return out


class Names:
    """Names as padded code points with their lengths and letter counts."""

    def __init__(self, names: list[str]):
        self.names = names
        self.length = np.array([len(n) for n in names], np.int32)
        self.letters = np.zeros((len(names), int(self.length.max(initial=0))), np.uint32)
        self.counts = np.zeros((len(names), CLASSES), np.int16)
        for k, n in enumerate(names):
            code = np.frombuffer(n.encode("utf-32-le"), np.uint32)
            self.letters[k, : len(code)] = code
            self.counts[k] = np.minimum(np.bincount(code % CLASSES, minlength=CLASSES), 30_000)

    def bound(self, other: Names) -> np.ndarray:
        """The highest score that each pair can have, by letters that one has and the other hasn't."""
        apart = np.zeros((len(self.names), len(other.names)), np.int32)
        for c in range(CLASSES):
            a, b = self.counts[:, c], other.counts[:, c]
            if a.any() or b.any():
                apart += np.abs(a[:, None] - b[None, :])
        gap = np.abs(self.length[:, None] - other.length[None, :])
        return scored((apart + gap) // 2, np.maximum(self.length[:, None], other.length[None, :]))

    def scores(self, other: Names, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The scores of pairs."""
        out = np.zeros(len(i), np.int64)
        step = max(1, 4_000_000 // (int(other.length.max(initial=0)) + 1))
        for at in range(0, len(i), step):
            p, q = i[at : at + step], j[at : at + step]
            edits = distances(self.letters[p], self.length[p], other.letters[q], other.length[q])
            out[at : at + step] = scored(edits, np.maximum(self.length[p], other.length[q]))
        return out


def scored(edits: np.ndarray, longest: np.ndarray) -> np.ndarray:
    return np.floor(100.0 * (1.0 - edits / np.maximum(longest, 1)) + 0.5).astype(np.int64)


def close(x: Names, y: Names, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of all pairs of at least that score."""
    i, j = np.nonzero(x.bound(y) >= least)
    score = x.scores(y, i, j)
    on = score >= least
    return i[on], j[on], score[on]


def closest(x: Names, y: Names, ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, id, score) of the best y of each x: the highest score, then the least id. A few of the likeliest are scored first, then what may still be as good."""
    bound = x.bound(y)
    few = min(4, bound.shape[1])
    first = np.argpartition(-bound, few - 1, axis=1)[:, :few]
    i, j = np.repeat(np.arange(len(bound)), few), first.ravel()
    floor = np.maximum(x.scores(y, i, j).reshape(-1, few).max(1), least)
    i, j = np.nonzero(bound >= floor[:, None])
    score = x.scores(y, i, j)
    on = np.flatnonzero(score >= floor[i])
    order = on[np.lexsort((ids[j[on]], -score[on], i[on]))]
    head = order[np.r_[True, i[order][1:] != i[order][:-1]]] if len(order) else order
    return i[head], ids[j[head]], score[head]


def _tiles(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Names of left (side 0) and right (side 1; name, id) in tiles: each part of a group's left names with each part of its right ones."""

    def cut(side: DataFrame, parts: str) -> DataFrame:
        counts = side.groupBy(*by).agg(F.ceil(F.count("*") / TILE).cast("int").alias(parts))
        return counts

    sizes = cut(left, "rows").join(cut(right, "columns"), list(by))
    part = lambda of: F.pmod(F.xxhash64("name"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    a = left.join(sizes, list(by)).withColumn("i", part("rows")).withColumn("j", every("columns")).select(*by, "i", "j", F.lit(0).alias("side"), "name", F.lit(None).cast("long").alias("id"))
    b = right.join(sizes, list(by)).withColumn("j", part("columns")).withColumn("i", every("rows")).select(*by, "i", "j", F.lit(1).alias("side"), "name", "id")
    return a.unionByName(b).repartition(*by, "i", "j").sortWithinPartitions(*by, "i", "j", "side")


def _in_tiles(compare, by: Sequence[str], fields: list[tuple[str, pa.DataType]]):
    """compare(left names, right names, ids), giving columns, for each tile of the sorted rows; the group's columns are put before."""
    keys = [*by, "i", "j"]

    def run(batches):
        held: dict[int, list] = {0: [], 1: []}
        tile, schema = None, None

        def out():
            if held[0] and held[1]:
                columns = compare([n for n, _ in held[0]], [n for n, _ in held[1]], np.array([i if i is not None else -1 for _, i in held[1]], np.int64))
                n = len(columns[0])
                if n:
                    group = [pa.array([v] * n, schema.field(c).type) for c, v in zip(by, tile)]
                    yield pa.RecordBatch.from_arrays([*group, *[pa.array(c, t) for c, (_, t) in zip(columns, fields)]], [*by, *[f for f, _ in fields]])

        for batch in batches:
            schema = batch.schema
            for here, side, name, i in zip(zip(*[batch.column(k).to_pylist() for k in keys]), batch.column("side").to_pylist(), batch.column("name").to_pylist(), batch.column("id").to_pylist()):
                if here != tile:
                    yield from out()
                    held, tile = {0: [], 1: []}, here
                held[side].append((name, i))
        yield from out()

    return run


def _ddl(df: DataFrame, by: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return "".join(f"`{c}` {types[c]}, " for c in by)


def similar_names(left: DataFrame, right: DataFrame, by: Sequence[str], least: int) -> DataFrame:
    """(by, x, y, score) of all distinct names x of left and y of right (columns by, name) in one group whose score is at least `least`.

    Equal names are a pair too. Groups with a null column and null names match nothing; an empty name is like another empty one alone.
    """
    by = list(by)
    a, b = (side.select(*by, "name").dropna().distinct() for side in (left, right))
    if least < PREFIX:
        return _similar_in_tiles(a, b, by, least)
    size = piece_length(least)
    counts = a.unionByName(b).where(F.length("name") >= size).select(F.explode(_pieces("name", size)).alias("p")).groupBy("p.piece").agg(F.count("*").alias("n"))
    own, more = allowed(F.length("name"), least), _longer("name", least)
    short, long = {s: _indexed(d, counts, by, more, size) for s, d in (("a", a), ("b", b))}, {s: _indexed(d, counts, by, own, size) for s, d in (("a", a), ("b", b))}
    met = _met(short["a"], long["b"], by).unionByName(_met(short["b"], long["a"], by).select(*by, F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    found = met.withColumn("score", likeness(F.col("x"), F.col("y"))).where(F.col("score") >= least)
    tiny = a.where(F.length("name") < size).join(b, [*by, "name"])  # names of no piece are like equal ones alone
    return found.unionByName(tiny.select(*by, F.col("name").alias("x"), F.col("name").alias("y"), F.lit(100).cast("long").alias("score")))


def _similar_in_tiles(a: DataFrame, b: DataFrame, by: Sequence[str], least: int) -> DataFrame:
    def compare(x, y, ids):
        i, j, score = close(Names(x), Names(y), least)
        return [x[k] for k in i.tolist()], [y[k] for k in j.tolist()], score

    fields = [("x", pa.string()), ("y", pa.string()), ("score", pa.int64())]
    return _tiles(a, b.withColumn("id", F.lit(None).cast("long")), by).mapInArrow(_in_tiles(compare, by, fields), _ddl(a, by) + "x string, y string, score long")


def pairs_of_rows(rows: DataFrame, pairs: DataFrame, by: Sequence[str], key: str, other: str, block: int = 1024, per_task: int = 4_000_000) -> DataFrame:
    """(key, other, score) of rows (by, name, key) whose names are a pair (by, x, y, score), key below other: each pair of names once a block of each side's keys.

    Keys of one name stand in blocks, so what is moved grows with the rows and the pairs of names, and tasks are dealt by the pairs that come out of them.
    """
    by = list(by)
    sizes = rows.groupBy(*by, "name").agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    keyed = rows.select(*by, "name", key).join(sizes, [*by, "name"]).withColumn("_block", F.pmod(F.xxhash64(key, F.lit(3)), F.col("_n")))
    blocks = Staging(rows.sparkSession, "blocks").put(keyed.groupBy(*by, "name", "_block").agg(F.collect_list(key).alias("keys")))
    one, two = blocks.select(*by, F.col("name").alias("x"), F.col("keys").alias("_a")), blocks.select(*by, F.col("name").alias("y"), F.col("keys").alias("_b"))
    met = Staging(rows.sparkSession, "met").put(one.join(pairs, [*by, "x"]).join(two, [*by, "y"]).where(F.array_min("_a") < F.array_max("_b")).select("_a", "_b", "score"))
    found = met.agg(F.sum(F.size("_a").cast("long") * F.size("_b"))).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-found // per_task))
    each = met.repartition(parts).select(F.explode("_a").alias(key), "_b", "score").select(key, F.explode(F.filter("_b", lambda b: b > F.col(key))).alias(other), "score")
    return each.select(key, other, "score")


def best_names(left: DataFrame, right: DataFrame, by: Sequence[str], least: int, id_col: str = "id") -> DataFrame:
    """(by, x, id, score) of the most similar row of right (by, name, id) for each distinct name x of left in its group: the highest score, then the least id.

    Only scores of at least `least` count. Names that the index finds a match for from PREFIX on are done; only the others are looked up in tiles, so
    that a low level costs nothing where names are misspelt. Null groups and names match nothing.
    """
    by = list(by)
    a = left.select(*by, "name").dropna().distinct()
    b = right.select(*by, "name", F.col(id_col).cast("long").alias("id")).dropna(subset=[*by, "name"]).groupBy(*by, "name").agg(F.min("id").alias("id"))
    high = similar_names(a, b, by, max(least, PREFIX)).join(b.select(*by, F.col("name").alias("y"), "id"), [*by, "y"])
    found = high.groupBy(*by, "x").agg(F.max(F.struct("score", (-F.col("id")).alias("m"))).alias("top")).select(*by, "x", (-F.col("top.m")).alias("id"), F.col("top.score").alias("score"))
    if least >= PREFIX:
        return found

    def compare(x, y, ids):
        i, best, score = closest(Names(x), Names(y), ids, least)
        return [x[k] for k in i.tolist()], best, score

    fields = [("x", pa.string()), ("id", pa.int64()), ("score", pa.int64())]
    open_ = a.join(found.select(*by, F.col("x").alias("name")), [*by, "name"], "left_anti")
    tiles = _tiles(open_, b, by).mapInArrow(_in_tiles(compare, by, fields), _ddl(a, by) + "x string, id long, score long")
    low = tiles.groupBy(*by, "x").agg(F.max(F.struct("score", (-F.col("id")).alias("m"))).alias("top")).select(*by, "x", (-F.col("top.m")).alias("id"), F.col("top.score").alias("score"))
    return found.unionByName(low)
