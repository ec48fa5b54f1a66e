"""SimHash near-duplicates, linked by bit-sliced comparison.

A document's fingerprint has bit k where more than half of its shingle hashes have it. Only distinct fingerprints are
compared. Two that differ in at most `radius` bits agree on at least two of radius + 2 bands of bits, so each pair of bands deals the
fingerprints into buckets, and each bucket is compared whole: its members stand as vertical bit planes, 64 in a word, and each
query's distances to all of them grow through carry-save counters one plane at a time. Queries whose every distance in
the block exceeds the radius are abandoned. A bucket beyond TILE members is cut into parts by a hash; each pair of parts is a tile of
its own, so no task meets a whole hot bucket and no pair is lost. A tile gives a spanning forest of its links, not the links.

Near copies of some hundred words differ in ten bits or more, at which unrelated texts may meet too. Where a similarity is asked for
(`least`), further candidates therefore come from bands of MinHashes, and the Jaccard similarity of all distinct shingles decides. At 0.8 a
pair shares none of BANDS bands of DEPTH with probability (1 - 0.8 ** 4) ** 18 = 7.6e-5, less above.
There too the fingerprints are compared first: what they link within the radius is decided exactly, and the buckets of bands only add links between what this left apart.
Of each bucket first the pairs with its least node are decided. Then the sets of shingles of buckets that verified links haven't connected
are dealt to tiles, each of which counts what its sets share, whole, and gives a spanning forest of the links between them: no
pair of a bucket is left out, and no more links than nodes leave a tile. Only verified links connect.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, settled, steps, tasks, tidy, unused, written
from .components import components

TILE, CHUNK = 2048, 512
#: Sets of shingles, and shingles, in a part of a bucket whose sets are compared exactly.
SOME, ELEMENTS = 512, 2_000_000
#: Bands of MinHashes and MinHashes in each; a byte of each makes the signature. SLACK: how far it may lie below the similarity asked for.
BANDS, DEPTH, SLACK = 18, 4, 0.2
SEEDS = np.random.default_rng(11).integers(0, 1 << 64, (3, BANDS * DEPTH), np.uint64, False) | np.uint64(1)
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def hashes(text: str, shingle: int = 4) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of words, A-Z lower-cased; a text with fewer words is one shingle, one without has none."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begin, end = np.r_[0, ends[: n - 1] + 1].tolist(), ends[-n:].tolist()
    return np.fromiter(map(xxh64_intdigest, [joined[i:j] for i, j in zip(begin, end)], repeat(42)), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes, unsigned."""
    over = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        over += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * over > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash; 0 for a text without words."""
    return majority(hashes(text, shingle))


def _fingerprints(rows: DataFrame, shingle: int) -> DataFrame:
    """The rows of longs and a text with fp in place of the text."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches):
        for given, texts in steps(batches):
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*map(given.column, names), pa.array(fp)], [*names, "fp"])

    return rows.mapInArrow(tidy(run), "".join(f"{c} long, " for c in names) + "fp long")


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for each row; a null text is empty."""
    return _fingerprints(id_text(docs, id_col, text_col), shingle)


def bit_planes(fp: np.ndarray) -> np.ndarray:
    """64 rows; bit j of row p is bit p of fp[j], in words of 64."""
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    short = -len(fp) % 64
    packed = np.packbits(np.pad(bits, ((0, short), (0, 0))), axis=0, bitorder="little")
    return np.ascontiguousarray(packed.T).view(np.uint64)


def within(queries: np.ndarray, block: np.ndarray, radius: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all queries[i] and block[j] that differ in at most `radius` bits.

    The counters hold the distances so far, one array of words for each binary digit; what is carried beyond the last digit stays in `past`.
    """
    planes = bit_planes(block)
    alive, left = np.arange(len(queries)), queries
    shape = (len(queries), planes.shape[1])
    counters, past = [np.zeros(shape, np.uint64) for _ in range(max(1, radius.bit_length()))], np.zeros(shape, np.uint64)

    def over():
        """Distances above the radius so far, compared digit by digit from the highest."""
        more, same = past, ~past
        for k in range(len(counters) - 1, -1, -1):
            if radius >> k & 1:
                same = same & counters[k]
            else:
                more = more | (same & counters[k])
                same = same & ~counters[k]
        return more

    for p in range(64):
        carry = planes[p][None, :] ^ np.where(left >> np.uint64(p) & np.uint64(1), ALL, np.uint64(0))[:, None]
        for c in counters:
            both = c & carry
            c ^= carry
            carry = both
        past |= carry
        if p in (15, 23, 31, 39, 47, 55):
            some = (over() != ALL).any(axis=1)
            if not some.all():
                alive, left, past = alive[some], left[some], past[some]
                counters = [c[some] for c in counters]
            if not len(alive):
                break
    near = np.unpackbits((~over()).view(np.uint8), axis=1, bitorder="little")[:, : len(block)]
    i, j = np.nonzero(near)
    return alive[i], j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component under the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def closest_forest(i: np.ndarray, j: np.ndarray, distance: np.ndarray, n: int) -> np.ndarray:
    """The places of links (i, j) that make a spanning forest of n nodes out of the closest ones: each round, each tree takes its closest link outwards."""
    order = np.argsort(distance.astype(np.uint8), kind="stable")
    i, j, chosen = i[order], j[order], np.zeros(0, np.int64)
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        out = np.flatnonzero(a != b)
        if not len(out):
            return order[chosen]
        first = np.full((2, n), len(i))
        first[0, a[out[::-1]]] = out[::-1]  # the last written is the first in order
        first[1, b[out[::-1]]] = out[::-1]
        taken = first.min(0)
        chosen = np.union1d(chosen, taken[taken < len(i)])
        root = forest(n, i[chosen], j[chosen])


def band_keys(fp: Column, radius: int = 4) -> list[Column]:
    """For each pair of radius + 2 bands the bits of both, with the pair's number on top."""
    n = radius + 2
    cuts = [round(64 * i / n) for i in range(n + 1)]
    band = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    width = [b - a for a, b in zip(cuts, cuts[1:])]
    return [(F.lit(k) * F.lit(1 << 48)) + F.shiftleft(band[i], width[j]) + band[j] for k, (i, j) in enumerate(combinations(range(n), 2))]


def _linked(radius: int):
    def run(batches):
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 4

        def edges(columns, last):
            """Compare whole groups of equal (key, tile); the last, which may go on, waits unless it is the end."""
            key, tile, side, fp = columns
            n = len(key)
            starts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1, n] if n else np.zeros(1, int)
            upto = n if last or not n else int(starts[-2])
            starts = starts[starts <= upto]
            found = []
            i = 0
            while i < len(starts) - 1:
                j = i + 1
                while j < len(starts) - 1 and starts[j + 1] - starts[i] <= CHUNK and not side[starts[i] : starts[j + 1]].any():  # small groups share a block: a link between groups is a link
                    j += 1
                some, sides = fp[starts[i] : starts[j]].view(np.uint64), side[starts[i] : starts[j]]
                i = j
                if len(some) < 2:
                    continue
                root = np.arange(len(some))
                for at in range(0, len(some), CHUNK):
                    own = np.arange(at, min(at + CHUNK, len(some)))
                    rest = np.arange(at, len(some))
                    if sides.any():  # a tile of two parts: each part is compared within itself in its own tile
                        own, rest = own[sides[own] == 0], np.flatnonzero(sides == 1)
                    if len(own) and (root[own] == root[own[0]]).all():
                        rest = rest[root[rest] != root[own[0]]]  # what is connected already needs no further link
                    if not len(own) or not len(rest):
                        continue
                    a, b = within(some[own], some[rest], radius)
                    a, b = own[a], rest[b]
                    a, b = a[root[a] != root[b]], b[root[a] != root[b]]
                    if not len(a):
                        continue
                    kept = closest_forest(root[a], root[b], np.bitwise_count(some[a] ^ some[b]), len(some))
                    a, b = a[kept], b[kept]
                    found.append((some[a], some[b]))
                    root = forest(len(some), np.r_[np.arange(len(some)), a], np.r_[root, b])
            return [c[upto:] for c in columns], found

        def out(found):
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*found)], ["a", "b"])

        for batch in batches:
            columns = [np.concatenate((h, batch.column(c).to_numpy())) for h, c in zip(held, ("key", "tile", "side", "fp"))]
            held, found = edges(columns, False)
            yield from out(found)
        yield from out(edges(held, True)[1])

    return run


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints in column fp that connect all pairs within the radius, and no others.

    Each edge is itself a pair within the radius, a close one rather than another, so that it can be examined further.
    """
    keyed = distinct.select("fp", F.explode(F.array(*band_keys(F.col("fp"), radius))).alias("key"))
    hot = keyed.groupBy("key").count().where(F.col("count") > TILE).select("key", F.ceil(F.col("count") / TILE).cast("long").alias("parts"))
    rows = keyed.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))).withColumn("own", F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    dealt = rows.withColumn("other", other).select(
        "key", "fp", (F.least("own", "other") * F.lit(1 << 31) + F.greatest("own", "other")).alias("tile"), (F.col("own") > F.col("other")).cast("long").alias("side")
    )
    return dealt.repartition(tasks(distinct, 2_000_000), "key", "tile").sortWithinPartitions("key", "tile", "side", "fp").mapInArrow(tidy(_linked(radius)), "a long, b long").distinct()


def minhashes(h: np.ndarray) -> np.ndarray:
    """BANDS * DEPTH least values of the hashes under as many mixings; zeros for a text without words."""
    least = np.full(BANDS * DEPTH, 0 if not len(h) else ALL, np.uint64)
    for i in range(0, len(h), 1024):
        mixed = (h[None, i : i + 1024] ^ SEEDS[0][:, None]) * SEEDS[1][:, None]
        mixed ^= mixed >> np.uint64(32)
        mixed *= SEEDS[2][:, None]
        least = np.minimum(least, mixed.min(axis=1))
    return least


def _bands(least: np.ndarray) -> np.ndarray:
    """A key for each band of each row of MinHashes; the band's number is mixed in."""
    rows = least.reshape(-1, BANDS, DEPTH)
    key = np.broadcast_to(SEEDS[0][:BANDS], rows.shape[:2]).copy()
    for d in range(DEPTH):
        key = (key ^ rows[:, :, d]) * SEEDS[1][d]
        key ^= key >> np.uint64(29)
    return key


def _prints(shingle: int):
    """Row, fingerprint, node (a hash of the set of distinct shingles), band keys and signature of each text."""
    from xxhash import xxh64_intdigest

    def run(batches):
        for given, texts in steps(batches):
            made = [hashes(t, shingle) for t in texts]
            sets = [np.unique(h) for h in made]
            least = np.array([minhashes(u) for u in sets], np.uint64).reshape(-1, BANDS * DEPTH)
            fp = np.array([majority(h) for h in made], np.uint64).view(np.int64)
            node = np.array([xxh64_intdigest(u.tobytes(), 7) for u in sets], np.uint64).view(np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(sets) + 1, BANDS), pa.int32()), pa.array(_bands(least).ravel().view(np.int64)))
            sig = pa.array([x.tobytes() for x in (least >> np.uint64(20)).astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([given.column("row"), given.column("doc_id"), pa.array(fp), pa.array(node), keys, sig], ["row", "doc_id", "fp", "node", "keys", "sig"])

    return run


def _sets(shingle: int):
    """The distinct shingles' hashes of each text."""

    def run(batches):
        for given, texts in steps(batches):
            sets = [np.unique(hashes(t, shingle)).view(np.int64) for t in texts]
            ends = np.cumsum([0, *map(len, sets)])
            yield pa.RecordBatch.from_arrays([given.column("node"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], ["node", "shingles"])

    return run


def _bytes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * DEPTH)


def _loosely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs whose signatures agree in all but SLACK of the share that is asked for; only for pairs that are looked at again if they are left out."""

    bar = least - SLACK

    def run(batches):
        for b in batches:
            on = pa.array((_bytes(b.column("x")) == _bytes(b.column("y"))).mean(axis=1) >= bar)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(on), b.column("b").filter(on)], ["a", "b"])

    ends = [nodes.select(F.col("node").alias(end), F.col("sig").alias(name)) for end, name in (("a", "x"), ("b", "y"))]
    return pairs.join(ends[0], "a").join(ends[1], "b").mapInArrow(tidy(run), "a long, b long")


def linked_sets(sets: list[np.ndarray], root: np.ndarray, own: np.ndarray, rest: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs (i of own, j of rest) of a Jaccard similarity of at least `least` that connect all such pairs whose roots differ; no more pairs than sets.

    Every shared element has a number, so one pass over all elements of `rest` counts what a set has in common with each of them.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    _, number = np.unique(np.concatenate([sets[k] for k in (*own, *rest)]), return_inverse=True)
    cuts = np.cumsum(sizes[own])
    mine = np.split(number[: cuts[-1]], cuts[:-1])
    theirs = number[cuts[-1] :]
    at = np.cumsum(sizes[rest]) - sizes[rest]
    full = np.flatnonzero(sizes[rest])
    marked, out = np.zeros(number.max(initial=0) + 1, bool), []
    root = root.copy()
    for i, elements in zip(own.tolist(), mine):
        if not (root[rest] != root[i]).any():
            continue
        marked[elements] = True
        both = np.zeros(len(rest), np.int64)
        if len(full):
            both[full] = np.add.reduceat(marked[theirs], at[full], dtype=np.int64)
        marked[elements] = False
        whole = sizes[i] + sizes[rest] - both
        for j in rest[(both >= least * whole) & (root[rest] != root[i])].tolist():
            if root[j] != root[i]:
                out.append((i, j))
                root[root == max(root[i], root[j])] = min(root[i], root[j])
    return out


def _connected(least: float):
    """Of each (key, tile) links that connect all nodes of at least that similarity which earlier links haven't; each is such a pair itself."""

    def links(rows):
        if len(rows) < 2:
            return
        root = np.array([r[2] for r in rows])
        side = np.array([r[0] for r in rows])
        own, rest = np.flatnonzero(side == 0), np.flatnonzero(side == side.max())
        if len(own) and len(rest) and (root != root[0]).any():
            yield from linked_sets([r[3] for r in rows], root, own, rest, least)

    def run(batches):
        held, tile = [], None

        def out():
            found = [(rows[i][1], rows[j][1]) for rows in (held,) for i, j in links(rows)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], ["a", "b"])

        for batch in batches:
            sets = batch.column("shingles")
            ends, flat = np.asarray(sets.offsets), np.asarray(sets.values)
            for k, here in enumerate(zip(batch.column("key").to_pylist(), batch.column("tile").to_pylist())):
                if here != tile:
                    yield from out()
                    held, tile = [], here
                held.append((batch.column("side")[k].as_py(), batch.column("node")[k].as_py(), batch.column("root")[k].as_py(), flat[ends[k] : ends[k + 1]].copy()))
        yield from out()

    return run


def _dealt(rows: DataFrame, by: str) -> DataFrame:
    """Rows of (key, parts) with tile and side: each pair of the parts of a key is a tile."""
    own, other = F.pmod(F.xxhash64(F.col(by), F.lit(7)), F.col("parts")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    rows = rows.withColumn("own", own).withColumn("other", other)
    return rows.withColumn("tile", F.least("own", "other") * F.lit(1 << 31) + F.greatest("own", "other")).withColumn("side", (F.col("own") > F.col("other")).cast("long"))


def _decided(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose Jaccard similarity over all distinct shingles is at least that."""
    ends = [sets.select(F.col("node").alias(end), F.col("shingles").alias(name)) for end, name in (("a", "x"), ("b", "y"))]
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(ends[0], "a").join(ends[1], "b").where(both / (F.size("x") + F.size("y") - both) >= F.lit(least)).select("a", "b")


def _close(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints are equal or within the radius: one node of each fingerprint stands for it."""
    firsts = written(nodes.groupBy("fp").agg(F.min("node").alias("first")), "firsts")
    equal = nodes.join(firsts, "fp").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    ends = [firsts.select(F.col("fp").alias(end), F.col("first").alias(name)) for end, name in (("a", "x"), ("b", "y"))]
    near = links(firsts.select("fp"), radius).where("a != b").join(ends[0], "a").join(ends[1], "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return written(equal.unionByName(near), "close")


def alike(rows: DataFrame, nodes: DataFrame, shingle: int, least: float, radius: int = 4) -> DataFrame:
    """Edges (a, b) that connect all nodes of a similarity of at least `least` whose fingerprints the radius links or that share a band, each such a pair itself.

    rows has row and text; nodes has node, row, fp, keys and sig, one row for each set of shingles.
    """
    close = _close(nodes, radius)
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1")
    shared = written(keyed.join(buckets, "key"), "buckets")
    stars = written(shared.where("node != first").groupBy(F.col("first").alias("a"), F.col("node").alias("b")).agg(F.min("n").alias("n")), "stars")
    asked = shared.select("node").unionByName(close.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    taking_part = nodes.select("node", "row").join(asked, "node")
    sets = written(taking_part.join(rows.select("row", "text"), "row").select("node", "text").mapInArrow(tidy(_sets(shingle)), "node long, shingles array<long>"), "shingles")
    by_print = written(_decided(close, sets, least), "links")
    tied = components(by_print)
    ends = [tied.select(F.col("node").alias(end), F.col("root").alias(name)) for end, name in (("a", "x"), ("b", "y"))]
    apart = stars.join(ends[0], "a", "left").join(ends[1], "b", "left").where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b", "n")
    near = apart.where("n = 2").select("a", "b").unionByName(_loosely(apart.where("n > 2").select("a", "b"), nodes, least))  # a bucket of two is decided here and never again
    first = by_print.unionByName(written(_decided(near, sets, least), "links"))
    rooted = written(shared.join(components(first), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "rooted")
    h = F.xxhash64("node", F.lit(5))
    open_ = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.bit_xor(h).alias("x"), F.sum(h % 1_000_000_007).alias("y"))
    open_ = open_.where("low != high and n > 2").groupBy("n", "x", "y").agg(F.min("key").alias("key"))  # a pair is decided, and of buckets with the same nodes one is enough
    members = rooted.join(open_.select("key"), "key").join(sets, "node")
    members = written(members, "members")
    large = members.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / SOME), F.ceil(F.sum(F.size("shingles")) / ELEMENTS)).cast("long").alias("parts"))
    tiles = _dealt(members.join(large, "key"), "node").select("key", "tile", "side", "node", "root", "shingles").repartition(tasks(members, 8_000_000), "key", "tile").sortWithinPartitions("key", "tile")
    return first.unionByName(tiles.mapInArrow(tidy(_connected(least)), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", least: float | None = None) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id among all documents reachable by links, for each row.

    Rows with the same id or text each have a row; a null id has a component_id too, null only where no id is reachable.
    Texts without words have fingerprint 0 and link like any other. An empty table gives no rows.
    least: two texts are linked whose distinct shingles have at least that Jaccard similarity; what fingerprints link within the radius is decided first.
    """
    rows = id_text(docs, id_col, text_col)
    if least is not None:
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    return _placed(rows, radius, shingle, least).select("doc_id", "fp", "component_id")


def _placed(rows: DataFrame, radius: int, shingle: int, least: float | None) -> DataFrame:
    """doc_id, fp, root and component_id of each row, and its row if rows have one; with `least` they are a table and have one."""
    if least is None:
        prints = written(_fingerprints(rows, shingle).withColumn("node", F.col("fp")), "fingerprints")
        nodes = written(prints.groupBy("node").agg(F.min("doc_id").alias("least")), "nodes")
        found = settled(rows.sparkSession, lambda: components(links(nodes.select(F.col("node").alias("fp")), radius)))
    else:
        prints = written(rows.select("row", "doc_id", "text").mapInArrow(tidy(_prints(shingle)), "row long, doc_id long, fp long, node long, keys array<long>, sig binary"), "fingerprints")
        one = F.min(F.struct("row", "fp", "keys", "sig"))
        nodes = written(prints.groupBy("node").agg(F.min("doc_id").alias("least"), one.alias("one")).select("node", "least", "one.*"), "nodes")
        prints = prints.drop("keys", "sig")
        found = settled(rows.sparkSession, lambda: components(alike(rows, nodes, shingle, least, radius)))
    named = nodes.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    smallest = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")  # a table, so that a component of many fingerprints can be split in the join
    of = named.select("node", "root").join(smallest, "root")
    return prints.join(of, "node")


def keep_first(docs: DataFrame, radius: int = 4, shingle: int = 5, least: float | None = 0.8) -> DataFrame:
    """The rows of documents of which each component keeps one, that with the smallest doc_id; columns stay as they are.

    Rows stay and go by themselves, whatever other rows have their doc_id: of a component's rows with the smallest, the first in order of
    text stays. Rows without a doc_id can't be told apart by it and all stay.
    """
    r, n, root = unused(docs, "row", "n", "root")
    numbered = written(docs.withColumn(r, F.monotonically_increasing_id()), "numbered")
    rows = numbered.select(F.col(r).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kept = _placed(rows, radius, shingle, least).where("doc_id = component_id").select(F.col("row").alias(r), F.col("root").alias(root))
    first = numbered.join(kept, r).withColumn(n, F.row_number().over(Window.partitionBy(root).orderBy("text", r))).where(F.col(n) == 1)
    return first.select(docs.columns).unionByName(numbered.where("doc_id is null").select(docs.columns))
