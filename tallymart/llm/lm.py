"""Language-model scoring with a probabilistic suffix tree over words.

The tree's root is the smoothed unigram distribution of all training words, however rare. Below it are contexts of one to `depth` words. A
context or successor is listed from `least` (two) occurrences on, at every size of the corpus, so the tree grows with the corpus. Counts are
exact, over all training documents. A context is retained where its successors diverge from those of its suffix: where coding them by its own
distribution saves more than `cost` nats for itself and each listed successor. Distributions are smoothed by their suffix's:
P(w|s) = (c(s,w) + (r(s) + a) P(w|suffix)) / (c(s) + a), with c(s,w) for listed successors and r(s) the count of the others. A text is scored
word by word, each by the longest retained suffix of what stands before it.

All contexts that end in the same word form a subtree that needs nothing of the others. So each place of a text is sent, as a few numbers in
sorted, compressed blocks, to the bucket of the word before it; a bucket builds its subtrees and scores its places, and only sums go back.
A context with more places than a bucket should hold (found on a sample, which changes speed and never results) is split: its places are dealt
by the word before it, or by their number at the greatest depth, and the counts of its successors, added up beforehand, are sent to each part.

Texts are read twice: once to count words, once to replace words by numbers. The most frequent words, up to `alphabet` of them, are sent to
the workers, which number them on the spot; `alphabet` bounds that broadcast and changes speed, never results. All other words are joined with the vocabulary
by the word, once for each document that holds them, which gives their unigram terms and the numbers of those that are listed. The numbered texts stand in
buckets by chunk, so these numbers, a small part of all, are sent to their chunks and the texts stay where they are. Numbers ascend as counts descend, so a
worker tells a word's count from its number by the few places where the count changes. A context ends at a word below `least` occurrences.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, forget, id_text, parts, placed, tasks, tidy, written

#: The end of a text as a word of the vocabulary; no word can hold a line feed.
END = "\n"
#: Bytes of text in a step of counting and in a chunk, distinct words held before they are sent on, compression of what is shuffled.
STEP, CHUNK, HELD, LEVEL = 4_000_000, 8_000_000, 1_000_000, 6
#: Places that a bucket should hold at most and at least, and words of the sample that split contexts are found on.
BUCKET, LITTLE, SAMPLE = 1_500_000, 50_000, 2_000_000


def _words(texts: pa.Array) -> pa.ListArray:
    """Runs between the six white space characters of ASCII, A-Z lower-cased; empty strings stand at white space at the ends."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts))


def _counted(batches):
    held: list[pa.Table] = []
    size = docs = 0

    def out():
        table = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])
        return table.combine_chunks().to_batches()

    for part in parts(batches, STEP):
        docs += part.num_rows
        flat = _words(part.column("text")).flatten()
        found = pc.value_counts(flat.filter(pc.not_equal(flat, "")))
        held.append(pa.table({"word": found.field("values"), "c": found.field("counts")}))
        size += len(found)
        if size > HELD:
            held = [pa.Table.from_batches(out())]
            size = held[0].num_rows
            if size > HELD // 2:
                yield from held[0].to_batches()
                held, size = [], 0
    if docs:
        held.append(pa.table({"word": [END], "c": pa.array([docs], pa.int64())}))
        yield from out()


def vocabulary(docs: DataFrame, train) -> DataFrame:
    """word and c, its count in the documents for which the condition on doc_id holds, as a table; END counts the documents."""
    rows = docs.where(train).select("text").mapInArrow(tidy(_counted), "word string, c long")
    return written(rows.groupBy("word").agg(F.sum("c").alias("c")), "words")


class Blocks:
    """Sorted keys with counts, as compressed differences."""

    @staticmethod
    def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
        import zstandard

        gaps = np.diff(keys, prepend=np.uint64(0))
        wide, many = int(gaps.max(initial=0)) >> 32 > 0, int(counts.max(initial=0)) > 255
        body = gaps.astype("<u8" if wide else "<u4").tobytes() + counts.astype("<u4" if many else "u1").tobytes()
        return bytes([wide | many << 1]) + zstandard.ZstdCompressor(level=1).compress(body)

    @staticmethod
    def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        import zstandard

        body = zstandard.ZstdDecompressor().decompress(data[1:])
        w, m = (8 if data[0] & 1 else 4), (4 if data[0] & 2 else 1)
        n = len(body) // (w + m)
        return np.cumsum(np.frombuffer(body, f"<u{w}", n).astype(np.uint64)), np.frombuffer(body, f"<u{m}", n, n * w).astype(np.int64)

    @staticmethod
    def total(blocks) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*map(Blocks.unpack, blocks)))
        keys, inverse = np.unique(keys, return_inverse=True)
        return keys, np.bincount(inverse, counts).astype(np.int64)


def _flat(batch) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all documents, each followed by its END, and the document each belongs to."""
    ids = [np.frombuffer(x, "<i4") for x in batch.column("ids").to_pylist()]
    lengths = np.array([len(x) for x in ids], np.int64)
    return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), np.repeat(np.arange(len(ids)), lengths)


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def contexts(ids: np.ndarray, doc: np.ndarray, depth: int) -> list[np.ndarray]:
    """The word 1, 2, ... `depth` places before each place, -1 from the text's beginning or a rare word on."""
    out, alive = [], np.ones(len(ids), bool)
    for k in range(1, depth + 1):
        c = np.full(len(ids), -1, np.int32)
        if len(ids) > k:
            c[k:] = np.where(alive[k:] & (doc[k:] == doc[:-k]), np.maximum(ids[:-k], -1), -1)
        alive = c >= 0
        out.append(c)
    return out


def context_keys(before: list[np.ndarray]) -> list[np.ndarray]:
    """A hash of the last 1, 2, ... words before each place."""
    out, key = [], np.full(len(before[0]), 17, np.uint64)
    for c in before:
        key = mixed(key + (c.astype(np.int64) + 2).astype(np.uint64))
        out.append(key)
    return out


class Split:
    """How places are dealt: to `root` buckets by the word before, but those of split contexts to buckets of the context.

    chains: for each split context the split contexts that are its suffixes, shortest first, itself last.
    """

    def __init__(self, root: int, found: list[tuple[int, int, int, int]] = ()):
        """found: (depth, key, key of its suffix, parts) of split contexts."""
        found = sorted(found)
        self.root = root
        self.keys = np.array([f[1] for f in found], np.uint64)
        self.sorted = np.argsort(self.keys)
        of = {f[1]: i for i, f in enumerate(found)}
        self.parts = np.array([f[3] for f in found], np.int64)
        self.offsets = root + np.cumsum(self.parts) - self.parts
        self.buckets = int(root + self.parts.sum())
        self.chains: list[list[int]] = []
        for i, f in enumerate(found):
            self.chains.append([*(self.chains[of[f[2]]] if f[0] > 1 else []), i])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of the split context with each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = self.sorted[np.minimum(np.searchsorted(self.keys, keys, sorter=self.sorted), len(self.keys) - 1)]
        return np.where(self.keys[at] == keys, at, -1)

    def place(self, before: list[np.ndarray]) -> np.ndarray:
        """The bucket of each place."""
        keys = context_keys(before if len(self.keys) else before[:1])
        out = (keys[0] % np.uint64(self.root)).astype(np.int64)
        inside = np.flatnonzero(self.find(keys[0]) >= 0) if len(self.keys) else np.zeros(0, np.int64)
        for k in range(len(before)):
            if not len(inside):
                break
            node = self.find(keys[k][inside])
            inside, node = inside[node >= 0], node[node >= 0]
            finer = keys[k + 1][inside] if k + 1 < len(before) else mixed(inside.astype(np.uint64))
            out[inside] = self.offsets[node] + (mixed(finer) % self.parts[node].astype(np.uint64)).astype(np.int64)
            if k + 1 < len(before):
                inside = inside[before[k + 1][inside] >= 0]
        return out

    def above(self) -> list[tuple[int, int]]:
        """(split context, bucket) of all buckets that need the context's successors."""
        return [(j, b) for i, chain in enumerate(self.chains) for j in chain for b in range(int(self.offsets[i]), int(self.offsets[i] + self.parts[i]))]


def _split(coded: DataFrame, total: int, depth: int) -> Split:
    """The split contexts of all places, estimated on about SAMPLE of them."""
    root = max(tasks(coded), -(-total // BUCKET))
    most, every = max(LITTLE, min(BUCKET, 2 * total // root)), max(1, total // SAMPLE)
    if total <= most:
        return Split(root)
    rows = [np.frombuffer(r["ids"], "<i4") for r in coded.where(F.pmod(F.xxhash64("chunk", "k"), F.lit(every)) == 0).select("ids").toLocalIterator()]
    before = contexts(np.concatenate([np.zeros(0, np.int32), *rows]), np.repeat(np.arange(len(rows)), [len(x) for x in rows]), depth)
    del rows
    keys, found = context_keys(before), []
    for k, here in enumerate(keys):
        on = before[k] >= 0
        values, first, counts = np.unique(here[on], return_index=True, return_counts=True)
        suffix = keys[max(0, k - 1)][on][first]
        found += [(k + 1, int(values[i]), int(suffix[i]), int(-(-counts[i] * every * 3 // (2 * most)))) for i in np.flatnonzero(counts * every > most)]
    return Split(root, found)


class Places:
    """Places of texts as columns of 32 bits (the words before, the word, twice the row's number plus 1 for training), as compressed bytes."""

    @staticmethod
    def pack(columns: list[np.ndarray]) -> bytes:
        import zstandard

        body = np.stack([c.astype("<i4") for c in columns]).view(np.uint8).reshape(-1, 4).T  # bytes of equal weight stand together
        return zstandard.ZstdCompressor(level=LEVEL).compress(np.ascontiguousarray(body).tobytes())

    @staticmethod
    def unpack(data: bytes, width: int) -> np.ndarray:
        import zstandard

        body = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
        return np.ascontiguousarray(body.T).view("<i4").reshape(width, -1)


class Gains:
    """What rows of a chunk gain: their numbers, ascending, and doubles."""

    @staticmethod
    def pack(k: np.ndarray, gain: np.ndarray) -> bytes:
        import zstandard

        planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(k), -1).T).tobytes() for x in (np.diff(k.astype("<i4"), prepend=np.int32(0)), gain.astype("<f8"))]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))

    @staticmethod
    def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        import zstandard

        body = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
        n = len(body) // 12
        k, gain = (np.ascontiguousarray(x.reshape(-1, n).T) for x in (body[: 4 * n], body[4 * n :]))
        return np.cumsum(k.view("<i4").ravel()), gain.view("<f8").ravel()


def _numbered(scale: float):
    """Of the joined words of a chunk: the number of each of its unlisted words (-1: none), and what its rows have of known words and unigram terms."""

    def run(key, table):
        at, number, c, k, tf = (np.asarray(table.column(x)).astype(np.int64) for x in ("at", "number", "c", "k", "tf"))
        numbers = np.full(int(at.max(initial=-1)) + 1, -1, "<i4")
        numbers[at] = number
        rows, which = np.unique(k, return_inverse=True)
        known, base = np.bincount(which, np.where(c > 0, tf, 0)), np.bincount(which, tf * np.log10((c + 0.5) / scale))
        columns = [pa.array([key[0].as_py()], pa.int64()), pa.array([numbers.tobytes()], pa.binary())]
        columns += [pa.array([x.tolist()], pa.list_(t)) for x, t in ((rows, pa.int32()), (known.astype(np.int64), pa.int64()), (base, pa.float64()))]
        return pa.table(columns, ["chunk", "numbers", "rows", "known", "base"])

    return run


NUMBERED_SCHEMA = "chunk long, numbers binary, rows array<int>, known array<long>, base array<double>"


def _whole(coded: pa.Table, numbers: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk, the numbers of all its words, the row of each and whether it is for training; -1 for words that aren't listed."""
    ids, doc = _flat(coded)
    open_ = np.flatnonzero(ids < -1)
    if len(open_):
        ids[open_] = np.frombuffer(numbers.column("numbers")[0].as_py(), "<i4")[-2 - ids[open_]]
    return coded.column("chunk")[0].as_py(), ids, np.asarray(coded.column("k"))[doc], ~np.asarray(coded.column("held_out").to_pylist(), bool)[doc]


BLOCK_SCHEMA = "bucket int, node int, chunk long, block binary"


def _places(split: Split, depth: int):
    """Of a chunk a block of places for each bucket. Places without a word before them are left out."""
    schema = pa.schema([("bucket", pa.int32()), ("node", pa.int32()), ("chunk", pa.int64()), ("block", pa.binary())])

    def run(coded, numbers):
        if not coded.num_rows:
            return schema.empty_table()
        chunk, ids, row, train = _whole(coded, numbers)
        before = contexts(ids, row, depth)
        on = np.flatnonzero(before[0] >= 0)
        before = [c[on] for c in before]
        bucket = split.place(before)
        order = np.argsort(before[1], kind="stable") if depth > 1 else np.arange(len(on))
        order = order[np.argsort(bucket[order] << 32 | before[0][order], kind="stable")]
        columns = [c[order] for c in (*before, ids[on], row[on] << 1 | train[on])]
        bucket = bucket[order]
        del before, order
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()
        blocks = [Places.pack([c[i:j] for c in columns]) for i, j in zip(cuts[:-1], cuts[1:])]
        n = len(blocks)
        return pa.table([pa.array(bucket[cuts[:-1]], pa.int32()), pa.array([-1] * n, pa.int32()), pa.array([chunk] * n, pa.int64()), pa.array(blocks, pa.binary())], schema=schema)

    return run


#: In place of a word: the count of all places of a context.
WHOLE = 0xFFFFFFFF


def _successors(coded: DataFrame, numbered: DataFrame, split: Split, depth: int, least: int) -> DataFrame:
    """BLOCK_SCHEMA: the successors of each split context, a block with counts from `least` on and the whole count, for each bucket that needs it."""
    spark = coded.sparkSession
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def local(texts, numbers):
        rows = []
        if texts.num_rows:
            _, ids, row, train = _whole(texts, numbers)
            before, held = contexts(ids, row, depth), []
            for k, key in enumerate(context_keys(before)):
                node = np.where(train & (before[k] >= 0), split.find(key), -1)
                on = np.flatnonzero(node >= 0)
                held.append(node[on] << 32 | WHOLE)
                on = on[ids[on] >= 0]
                held.append(node[on] << 32 | ids[on])
            keys, counts = np.unique(np.concatenate(held).astype(np.uint64), return_counts=True)
            of = mixed(keys) % np.uint64(spread)
            rows = [(int(b), Blocks.pack(keys[of == b], counts[of == b])) for b in np.unique(of).tolist()]
        return pa.table({"part": pa.array([b for b, _ in rows], pa.int32()), "block": pa.array([x for _, x in rows], pa.binary())})

    def total(table):
        keys, counts = Blocks.total(table.column("block").to_pylist())
        on = (counts >= least) | (keys & np.uint64(WHOLE) == WHOLE)
        node, word, counts = (keys[on] >> np.uint64(32)).astype(np.int64), keys[on] & np.uint64(WHOLE), counts[on]
        rows = [(int(n), Blocks.pack(word[node == n], counts[node == n])) for n in np.unique(node).tolist()]
        return pa.table({"node": pa.array([n for n, _ in rows], pa.int32()), "block": pa.array([x for _, x in rows], pa.binary())})

    rows = coded.where("not held_out").groupBy("chunk").cogroup(numbered.groupBy("chunk")).applyInArrow(local, "part int, block binary")
    summed = written(rows.groupBy("part").applyInArrow(total, "node int, block binary"), "successors")
    needed = spark.createDataFrame(pa.table({"node": pa.array([n for n, _ in split.above()], pa.int32()), "bucket": pa.array([b for _, b in split.above()], pa.int32())}))
    return summed.join(needed, "node").select("bucket", "node", F.lit(-1).cast("long").alias("chunk"), "block")


class Terms:
    """The unigram terms of words by their numbers: one each for the first, one for all from each further number on at which the count changes."""

    def __init__(self, first: np.ndarray, starts: np.ndarray, values: np.ndarray, size: int):
        self.first, self.starts, self.values, self.size = first, starts, values, size

    def __getitem__(self, word: np.ndarray) -> np.ndarray:
        out = self.first[np.clip(word, 0, len(self.first) - 1)]
        if len(self.starts):
            far = np.flatnonzero(word >= len(self.first))
            out[far] = self.values[np.searchsorted(self.starts, word[far], side="right") - 1]
        return out

    def __len__(self) -> int:
        return self.size


class Tree:
    """Scores the places of one bucket, level by level."""

    def __init__(self, unigram: Terms, split: Split, depth: int, least: int, a: float, cost: float):
        self.unigram, self.split, self.depth, self.least, self.a, self.cost = unigram, split, depth, least, a, cost

    def _kept(self, gain, successors):
        return (successors > 0) & (gain * math.log(10) > self.cost * (1 + successors))

    def given(self, tables: list[tuple[np.ndarray, np.ndarray, float]], word: np.ndarray, now: np.ndarray) -> np.ndarray:
        """log10 P of the words by contexts that all places share, shortest first; tables: words, counts, and the whole count of each context."""
        levels = []

        def applied(w, p, upto):
            for words, left, own in levels[:upto]:
                at = np.minimum(np.searchsorted(words, w), max(0, len(words) - 1))
                p = np.where((words[at] == w) & (w >= 0), own[at], left + p) if len(words) else left + p
            return p

        for words, counts, total in tables:
            rest = max(0.0, total - counts.sum())
            left = math.log10((rest + self.a) / (total + self.a))
            lower = applied(words, self.unigram[words], len(levels))
            own = np.log10((counts + (rest + self.a) * 10.0**lower) / (total + self.a))
            if self._kept((counts * (own - lower)).sum() + rest * left, len(words)):
                levels.append((words, left, own))
        return applied(word, now, len(levels))

    def score(self, before: list[np.ndarray], word: np.ndarray, train: np.ndarray, tables: list) -> np.ndarray:
        """log10 P of each place's word less its unigram term; of a rare word (-1) what its contexts leave to their suffixes."""
        start = np.where(word >= 0, self.unigram[word], 0.0)
        now = self.given(tables, word, start.copy())
        alive, group, wide = np.arange(len(word)), np.zeros(len(word), np.int64), len(self.unigram) + 1
        for k, c in enumerate(before):
            alive, group = alive[c[alive] >= 0], group[c[alive] >= 0]
            if not len(alive):
                break
            group = np.unique(group * wide + c[alive], return_inverse=True)[1]
            if k < len(tables):
                continue
            n, learnt = int(group.max()) + 1, train[alive]
            total = np.bincount(group, learnt, n)
            seen = total[group] >= self.least
            alive, group, learnt = alive[seen], group[seen], learnt[seen]
            on = word[alive] >= 0
            pairs, which = np.unique(group[on] * wide + word[alive[on]], return_inverse=True)
            count = np.bincount(which, learnt[on], len(pairs)).astype(np.float64)
            lower = np.empty(len(pairs))
            lower[which] = now[alive[on]]
            listed, s = count >= self.least, pairs // wide
            rest = total - np.bincount(s[listed], count[listed], n)
            left = np.log10((rest + self.a) / (total + self.a))
            own = np.log10((count + (rest[s] + self.a) * 10.0**lower) / (total[s] + self.a))
            gain = np.bincount(s[listed], (count * (own - lower))[listed], n) + rest * left
            kept = self._kept(gain, np.bincount(s[listed], minlength=n))
            new = np.where(kept[group], left[group] + now[alive], now[alive])
            at = np.flatnonzero(on)
            hit = listed[which] & kept[group[at]]
            new[at[hit]] = own[which[hit]]
            now[alive] = new
        return now - start


def _scored(tree):
    """Of rows sorted by bucket, first its successors, then its places: what each row of a chunk gains, as blocks."""

    def run(batches):
        model = tree.value
        held: list[dict] = []

        def out():
            if not held or all(r["node"] >= 0 for r in held):
                return
            tables: dict[int, list] = {}
            for r in held:
                if r["node"] >= 0:
                    tables.setdefault(r["node"], []).append(Blocks.unpack(r["block"]))
            given = []
            for node in sorted(tables):  # numbers ascend with depth
                words, counts = (np.concatenate(x) for x in zip(*tables[node]))
                whole = words == WHOLE
                order = np.argsort(words[~whole])
                given.append((words[~whole].astype(np.int64)[order], counts[~whole].astype(np.float64)[order], float(counts[whole].sum())))
            own = [r for r in held if r["node"] < 0]
            blocks = [Places.unpack(r["block"], model.depth + 2) for r in own]
            ends = np.cumsum([0, *(b.shape[1] for b in blocks)])
            columns = np.concatenate(blocks, axis=1)
            del blocks
            gains = model.score(list(columns[: model.depth]), columns[model.depth].astype(np.int64), (columns[-1] & 1).astype(bool), given)
            rows = []
            for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()):
                k, inverse = np.unique(columns[-1][i:j] >> 1, return_inverse=True)
                total = np.bincount(inverse, gains[i:j])
                on = np.flatnonzero(total)
                rows.append(Gains.pack(k[on], total[on]) if len(on) else b"")
            yield pa.RecordBatch.from_arrays([pa.array([r["chunk"] for r in own], pa.int64()), pa.array(rows, pa.binary())], ["chunk", "block"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["bucket"] != row["bucket"]:
                    yield from out()
                    held = []
                held.append(row)
        yield from out()

    return run


def _summed(key, table):
    """The gains of a chunk's rows over all buckets."""
    blocks = [Gains.unpack(x) for x in table.column("block").to_pylist() if x]
    k, gain = (np.concatenate(x) for x in zip((np.zeros(0, "<i4"), np.zeros(0)), *blocks))
    rows, inverse = np.unique(k, return_inverse=True)
    return pa.table({"chunk": pa.array([key[0].as_py()] * len(rows), pa.int64()), "k": pa.array(rows.astype(np.int32)), "score": pa.array(np.bincount(inverse, gain) if len(rows) else np.zeros(0))})


def _far(listed: DataFrame, first: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """word, c and number of the listed words that aren't broadcast, numbered from `first` on by descending count; the first number of each count, and the counts.

    Words are sorted once, in ranges; a word's number is what stands in the ranges before its own and its place there. What comes to the driver is one row a range
    and one a count; counts here are at most a few times the training tokens divided by the words that are broadcast.
    """
    spark = listed.sparkSession
    ranked = written(listed.orderBy(F.desc("c"), "word").select("word", "c", F.monotonically_increasing_id().alias("place")), "ranked")
    counts = ranked.groupBy("c").count().orderBy(F.desc("c")).collect()
    if not counts:
        forget(ranked)
        return spark.createDataFrame([], "word string, c long, number int"), np.zeros(0, np.int64), np.zeros(0)
    ranges = ranked.groupBy(F.shiftright("place", 33).alias("range")).count().orderBy("range").collect()
    before = np.cumsum([first, *(r["count"] for r in ranges)])
    offsets = spark.createDataFrame([(int(r["range"]), int(n)) for r, n in zip(ranges, before)], "range long, before long")
    number = (F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias("number")
    far = ranked.withColumn("range", F.shiftright("place", 33)).join(F.broadcast(offsets), "range").select("word", "c", number)
    far.scratch_path = ranked.scratch_path
    return far, np.cumsum([first, *(r["count"] for r in counts[:-1])]), np.array([r["c"] for r in counts], np.float64)


def score_texts(docs: DataFrame, least: int = 2, depth: int = 4, alphabet: int = 1_000_000, a: float = 1.0, cost: float = 4.0, held_mod: int = 5, held: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score all texts with a tree learnt from those whose crc32(doc_id as text) mod 5 isn't 1; one row for each row.

    Columns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram) and score. A null or empty text is its end alone. A
    null id counts as the empty text in the crc; rows that repeat an id are separate documents. An empty table gives no rows. `alphabet` bounds what is
    broadcast and changes no result; more than 2 ** 31 - 1 words of `least` occurrences raise an error.
    """
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    out = crc_mod(F.col("doc_id"), held_mod) == held
    words = vocabulary(rows, ~out)
    total, distinct, ends = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("c"))), F.lit(0))).first()
    scale = total + 0.5 * (distinct + 1)
    listed = words.where((F.col("c") >= least) & (F.col("word") != END))
    steps = sorted((tuple(r) for r in listed.groupBy(F.floor(F.log2("c") * 8).alias("b")).agg(F.count("*"), F.min("c")).collect()), reverse=True)
    sizes = np.cumsum([0, *(n for _, n, _ in steps)])
    if sizes[-1] >= 2**31 - 1:
        raise ValueError(f"{sizes[-1]} words occur {least} times or more; numbers go to 2 ** 31 - 1")
    lowest = [c for (_, _, c), n in zip(steps, sizes[1:]) if n <= alphabet]  # a few hundred classes of counts, of which the highest fit
    near = F.col("c") >= lowest[-1] if lowest else F.lit(False)
    top = listed.where(near).toArrow()
    top = top.take(np.argsort(-np.asarray(top["c"]), kind="stable"))
    names, count = pa.concat_arrays([pa.array([END]), *(c.cast(pa.string()) for c in top["word"].chunks)]), np.r_[float(ends), np.asarray(top["c"], np.float64)]
    del top
    unigram = np.log10((count + 0.5) / scale)
    far, starts, counts = _far(listed.where(~near), len(names))
    common = spark.sparkContext.broadcast((names, count, unigram))

    def code(batches):
        from pyspark import TaskContext

        names, count, unigram = common.value
        chunk = TaskContext.get().partitionId() << 32
        for part in parts(batches, CHUNK):
            lists = _words(part.column("text"))
            flat = lists.flatten()
            bounds = np.asarray(lists.offsets) - np.asarray(lists.offsets)[0]
            number = pc.fill_null(pc.index_in(flat, names), -1).to_numpy(zero_copy_only=False).astype(np.int32)
            real = np.asarray(pc.not_equal(flat, "")).astype(bool) if len(flat) else np.zeros(0, bool)
            unlisted = np.flatnonzero((number < 0) & real)
            owner = np.searchsorted(bounds, unlisted, side="right") - 1
            strings = flat.take(pa.array(unlisted)).dictionary_encode()
            at = np.asarray(strings.indices).astype(np.int64)
            number[unlisted] = -2 - at  # until its number is known
            each, times = np.unique(owner << 32 | at, return_counts=True)  # such a word counts once a document
            cuts = np.searchsorted(each >> 32, np.arange(part.num_rows + 1))
            found = pa.StructArray.from_arrays([pa.array((each & 0xFFFFFFFF).astype(np.int32)), strings.dictionary.take(pa.array(each & 0xFFFFFFFF)), pa.array(times, pa.int64())], ["at", "word", "tf"])
            ids = [np.append(number[i:j][real[i:j]], np.int32(0)) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
            all_ids = np.concatenate([np.zeros(0, np.int32), *ids])
            there, safe = all_ids >= 0, np.maximum(all_ids, 0)
            sums = [np.bincount(doc, x, part.num_rows) for x in (np.ones(len(doc)), there & (count[safe] > 0), np.where(there, unigram[safe], 0.0))]
            columns = [
                pa.array(np.full(part.num_rows, chunk)), pa.array(np.arange(part.num_rows, dtype=np.int32)), part.column("doc_id"), part.column("held_out"), pa.array([x.astype("<i4").tobytes() for x in ids], pa.binary()),
                pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), found),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "k", "doc_id", "held_out", "ids", "n", "known", "base", "rare"])
            chunk += 1

    made = rows.withColumn("held_out", out).mapInArrow(tidy(code), "chunk long, k int, doc_id long, held_out boolean, ids binary, n long, known long, base double, rare array<struct<at:int,word:string,tf:long>>")
    coded = placed(made, "coded", "chunk", tasks(rows))
    places = coded.select("chunk", "k", "held_out", "ids")

    each = coded.select("chunk", "k", F.explode("rare").alias("_r")).select("chunk", "k", "_r.*")
    others = words.where((F.col("c") < least) & (F.col("word") != END)).select("word", "c", F.lit(-1).alias("number")).unionByName(far)
    joined = each.join(others, "word", "left").select("chunk", "k", "at", "tf", F.coalesce("number", F.lit(-1)).alias("number"), F.coalesce("c", F.lit(0)).alias("c"))
    numbered = written(joined.groupBy("chunk").applyInArrow(_numbered(float(scale)), NUMBERED_SCHEMA), "numbered")
    forget(words)
    if len(starts):
        forget(far)

    split = _split(places, int(total) * held_mod // max(1, held_mod - 1), depth)
    terms = Terms(unigram, starts, np.log10((counts + 0.5) / scale), max(len(names), int(sizes[-1]) + 1))
    tree = spark.sparkContext.broadcast(Tree(terms, split, depth, least, a, cost))
    numbers = numbered.select("chunk", "numbers")
    dealt = places.groupBy("chunk").cogroup(numbers.groupBy("chunk")).applyInArrow(_places(split, depth), BLOCK_SCHEMA)
    if len(split.keys):
        dealt = dealt.unionByName(_successors(places, numbers, split, depth, least))
    dealt = dealt.repartition(split.buckets, "bucket").sortWithinPartitions("bucket", F.desc("node"))
    gains = dealt.mapInArrow(tidy(_scored(tree)), "chunk long, block binary").groupBy("chunk").applyInArrow(_summed, "chunk long, k int, score double")

    none = {c: F.lit(0).cast("long").alias(c) for c in ("n", "known")}
    nobody = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out")]
    frequent = coded.select("chunk", "k", "doc_id", "held_out", "n", "known", "base", F.col("base").alias("score"))
    gained = gains.select("chunk", "k", *nobody, *none.values(), F.lit(0.0).alias("base"), "score")
    rare = numbered.select("chunk", F.explode(F.arrays_zip("rows", "known", "base")).alias("_r")).select("chunk", F.col("_r.rows").alias("k"), *nobody, none["n"], "_r.known", "_r.base", F.col("_r.base").alias("score"))
    summed = frequent.unionByName(rare).unionByName(gained).groupBy("chunk", "k").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n", "known", "base", "score")])
    return summed.select("doc_id", "held_out", F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
