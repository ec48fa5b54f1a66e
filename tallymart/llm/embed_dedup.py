"""Near-duplicate vectors by an epsilon grid order join.

Vectors with a cosine of at least t lie, as unit vectors, within eps = sqrt(2 - 2 t) of each other, and so do their projections on any
orthonormal directions with the length of the remainder as a last coordinate. Directions are the leading principal ones of a bounded sample;
they only order the vectors, so the sample changes speed and never results. Distinct vectors are sorted by the grid cells of side eps of these
projections and cut into blocks, within a label and dimension. Blocks whose boxes are farther apart than eps are never paired: blocks meet by the cells of the first direction, in labels of many blocks by those of the second as well. A pair of blocks
is joined by halving the longer interval of the order again and again, skipping what is provably distant, down to small intervals compared by
matrix products. A pair of blocks gives each vector's number of links and a spanning forest, never the links. Exact copies (known by 128 bits
of hashes) are one vector with a weight. Neighbouring blocks make tiles of TILE_BYTES, and a task compares two tiles: a block is sent once to
each tile that holds a block near it, not to each such block. A hot label or cell is many tiles, dealt to many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, tasks, tidy, written
from .components import components
from .simhash import forest

BLOCK, LEAF, TILE_BYTES = 2048, 96, 16_000_000
#: Blocks of a label beyond which they meet by cells of the second direction too, and the least width of those.
MANY, SECOND = 64, 0.125


def directions(sample: np.ndarray, dims: int) -> np.ndarray:
    """The `dims` leading principal directions of the rows as orthonormal columns."""
    sample = scaled(sample)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    _, _, v = np.linalg.svd(unit - unit.mean(0), full_matrices=False)
    return v[:dims].T


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to 0.5 or above, so that no square over- or underflows and no digit is lost."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0, keepdims=True))[1])


def _located(axes: np.ndarray | None, eps: float, dims: int):
    """Adds to (key, label, vector, copies) the projection and the remainder's length, and the cells that the order sorts by."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            place = np.zeros((n, dims + 1))
            if axes is not None:
                lists = batch.column("vector")
                size = np.asarray(lists.value_lengths())
                on = np.flatnonzero(size == axes.shape[0])
                if len(on):
                    x = scaled(np.asarray(lists.take(pa.array(on)).flatten(), np.float64).reshape(len(on), -1))
                    place[on, : axes.shape[1]] = x @ axes / np.linalg.norm(x, axis=1, keepdims=True)
                    place[on, dims] = np.sqrt(np.maximum(0.0, 1 - (place[on, :dims] ** 2).sum(1)))
            cells = np.floor(place / eps).astype(np.int32)
            columns = [*batch.columns, *[pa.array(cells[:, k]) for k in range(dims)], pa.array(list(place), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *[f"c{k}" for k in range(dims)], "place"])

    return run


def _blocks(dims: int, store: str, per_tile: int):
    """Cuts the sorted rows of a partition into blocks of one label and dimension, `per_tile` of which make a tile."""

    def run(batches):
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, None

        def block(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            rows = rows.combine_chunks()
            place = np.asarray(rows["place"].combine_chunks().flatten()).reshape(-1, dims + 1)
            vectors = np.asarray(rows["vector"].combine_chunks().flatten(), np.float64)
            row = {
                "block": part << 32 | number, "tile": part << 32 | number // per_tile, "label": rows["label"][0].as_py(), "size": rows["size"][0].as_py(), "n": rows.num_rows,
                "low": place.min(0).tolist(), "high": place.max(0).tolist(), "keys": np.asarray(rows["key"].combine_chunks()).tobytes(),
                "copies": np.asarray(rows["copies"].combine_chunks()).tobytes(), "places": place.tobytes(), "vectors": vectors.astype(store).tobytes(),
            }
            number += 1
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("block", pa.int64()), ("tile", pa.int64()), ("label", pa.string()), ("size", pa.int32()), ("n", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("keys", pa.binary()), ("copies", pa.binary()), ("places", pa.binary()), ("vectors", pa.binary())]))

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            label, size = np.asarray(rows["label"]), np.asarray(rows["size"])
            starts = np.r_[0, np.flatnonzero((label[1:] != label[:-1]) | (size[1:] != size[:-1])) + 1, len(label)] if len(label) else np.zeros(1, int)
            held = None
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                last = b == len(label)
                while b - a >= BLOCK or (not last and b > a):
                    yield block(rows.slice(a, min(BLOCK, b - a)))
                    a = min(a + BLOCK, b)
                if last and b > a:
                    held = rows.slice(a)
        if held is not None and held.num_rows:
            yield block(held)

    return run


BLOCK_SCHEMA = "block long, tile long, label string, size int, n int, low array<double>, high array<double>, keys binary, copies binary, places binary, vectors binary"


def ego_join(a: tuple, b: tuple, eps: float, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs of the two sequences (places, vectors, norms) with a cosine of at least `least`; i < j if they are the same."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def join(i0, i1, j0, j1):
        if same and j1 <= i0 + 1:
            return
        p, q = a[0][i0:i1], b[0][j0:j1]
        gap = np.maximum(np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)), 0)
        if gap @ gap > eps * eps:
            return
        n, m = i1 - i0, j1 - j0
        if n <= LEAF and m <= LEAF:
            cosine = a[1][i0:i1] @ b[1][j0:j1].T / (a[2][i0:i1, None] * b[2][None, j0:j1])
            i, j = np.nonzero(cosine >= least)
            i, j = i + i0, j + j0
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                found.append((i, j))
        elif n >= m:
            join(i0, i0 + n // 2, j0, j1)
            join(i0 + n // 2, i1, j0, j1)
        else:
            join(i0, i1, j0, j0 + m // 2)
            join(i0, i1, j0 + m // 2, j1)

    join(0, len(a[0]), 0, len(b[0]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _joined(dims: int, eps: float, least: float, store: str):
    """Of rows sorted by the two tiles that a task compares, the links and a forest of each pair of blocks of both."""

    def read(row):
        keys, copies = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["copies"], np.int64)
        vectors = scaled(np.frombuffer(row["vectors"], store).astype(np.float64).reshape(len(keys), -1))
        return keys, copies, (np.frombuffer(row["places"]).reshape(-1, dims + 1), vectors, np.linalg.norm(vectors, axis=1))

    def pair(a, b):
        same = a["block"] == b["block"]
        keys, copies, first = read(a)
        other_keys, other_copies, second = (keys, copies, first) if same else read(b)
        i, j = ego_join(first, second, eps, least, same)
        if not len(i):
            return
        if not same:
            j = j + len(keys)
            keys, copies = np.r_[keys, other_keys], np.r_[copies, other_copies]
        links = np.bincount(i, copies[j], len(keys)) + np.bincount(j, copies[i], len(keys))
        root = forest(len(keys), i, j)
        on = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(keys[on]), pa.array(links[on].astype(np.int64)), pa.array(keys[root[on]])], ["key", "links", "root"])

    def pairs(rows):
        for a in rows:
            for b in rows:
                gap = np.maximum(np.maximum(np.subtract(a["low"], b["high"]), np.subtract(b["low"], a["high"])), 0)
                own = (a["tile"], b["tile"]) == (a["first"], a["second"])
                if own and a["block"] <= b["block"] and (a["label"], a["size"]) == (b["label"], b["size"]) and gap @ gap <= eps * eps:
                    yield from pair(a, b)

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (held[0]["first"], held[0]["second"]) != (row["first"], row["second"]):
                    yield from pairs(held)
                    held = []
                held.append(row)
        yield from pairs(held)

    return run


def near_vectors(vectors: DataFrame, least: float = 0.98, dims: int = 8, sample: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept for each row; only vectors of equal, non-null label and equal dimension are compared.

    Null, empty or zero vectors, and those with null or non-finite components, link with nothing and are their own components. Rows with
    the same id are separate vectors; a row without an id takes part, and its own component_id is null if it links with none that has one; kept
    is then false. `sample` bounds the vectors that the directions are fitted on. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    eps = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6
    kind, store = ("array<float>", "<f4") if dict(vectors.dtypes)[vector_col] == "array<float>" else ("array<double>", "<f8")  # as many bytes as the components came with; all arithmetic is double
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"), F.col(label_col).cast("string").alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = written(rows.select("*", good.alias("good"), F.xxhash64("label", "vector").alias("h"), F.xxhash64(F.lit(7), "vector", "label").alias("g")), "vectors")
    same = F.first(F.struct("label", "vector")).alias("one")
    each = rows.where("good").groupBy("h", "g").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), same).select("h", "g", "copies", "least", "one.*")
    each = written(each.withColumn("size", F.size("vector")).withColumn("key", F.monotonically_increasing_id()), "distinct")
    taken = each.orderBy(F.xxhash64("key"), "key").limit(sample).select("vector").toPandas()["vector"].tolist()
    sizes, counts = np.unique([len(x) for x in taken], return_counts=True) if taken else ([], [])
    axes = None
    if len(taken):
        some = np.array([x for x in taken if len(x) == sizes[int(np.argmax(counts))]], np.float64)
        axes = directions(some, dims) if len(some) > 1 else None

    cells = [f"c{k}" for k in range(dims)]
    located = each.select("key", "label", "size", "vector", "copies").mapInArrow(_located(axes, eps, dims), f"key long, label string, size int, vector {kind}, copies long, " + "".join(f"{c} int, " for c in cells) + "place array<double>")
    located = written(located, "located")
    order = ["label", "size", *cells, "key"]
    many, widest = located.agg(F.count("*"), F.max("size")).first()
    per_tile = max(1, TILE_BYTES // (BLOCK * (widest or 1) * int(store[2])))
    ranges = max(1, -(-many * 5 // (4 * BLOCK * per_tile)))  # about as many as there are tiles
    blocks = written(located.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(_blocks(dims, store, per_tile), BLOCK_SCHEMA), "blocks")
    forget(located)

    boxes = blocks.select("block", "tile", "label", "size", "low", "high")
    second = F.when(F.col("many") > MANY, max(eps, SECOND)).otherwise(4.0).alias("second")  # projections lie in [-1, 1]
    boxes = boxes.join(boxes.groupBy("label", "size").agg(F.count("*").alias("many")).select("label", "size", second), ["label", "size"])
    start = lambda x, k: F.floor(x[k] / (F.col("second") if k else eps)).cast("int")
    cells_of = lambda k: F.explode(F.sequence(start(F.col("low"), k), start(F.col("high"), k) + 1))
    grid = ["label", "size", "cell", "second_cell"]
    dealt = boxes.withColumn("cell", cells_of(0)).withColumn("second_cell", cells_of(1))
    one = dealt.select(F.col("block").alias("a"), F.col("tile").alias("first"), *grid, F.col("low").alias("low_a"), F.col("high").alias("high_a"), "second")
    two = dealt.select(F.col("block").alias("b"), F.col("tile").alias("second_tile"), *grid, F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    met = [F.col(c) == F.greatest(start(F.col("low_a"), k), start(F.col("low_b"), k)) for k, c in enumerate(grid[2:])]  # the first cell that both have: a pair meets once
    gaps = F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    close = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= eps * eps
    pairs = one.join(two, grid).where((F.col("a") <= F.col("b")) & met[0] & met[1] & close).select("a", "b", "first", F.col("second_tile").alias("second"))
    block = F.explode(F.array("a", "b")).alias("block")
    wanted = written(pairs.select("first", "second", block).distinct(), "wanted")  # tiles ascend with blocks, so first <= second
    work = wanted.join(blocks, "block").repartition(tasks(blocks, TILE_BYTES), "first", "second").sortWithinPartitions("first", "second", "block")
    found = written(work.mapInArrow(tidy(_joined(dims, eps, least, store)), "key long, links long, root long"), "links")
    forget(blocks)
    forget(wanted)

    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    named = each.select("key", "h", "g", "copies", "least").join(links, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left")
    named = named.withColumn("root", F.coalesce("root", "key"))
    smallest = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")  # a table, so that a large component can be split in the join
    result = written(named.join(smallest, "root").select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id"), "named")
    linked = rows.where("good").select("h", "g", "vec_id").join(result, ["h", "g"]).select("vec_id", "n_links", "component_id")
    out = linked.unionByName(rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
