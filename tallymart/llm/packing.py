"""Best-fit packing of token sequences with a bounded number of open bins.

Every partition packs what it reads, one document after another: a bitset has bit f set while an open bin has f free
places, so the tightest bin that takes a piece is the lowest set bit from the piece's length on. When more than
`open_bins` are open, the fullest is closed. Bins that are still open when the partition ends are few (at most
`open_bins`); a second round takes those of `merge` partitions apart and packs their pieces as they come by the same rule, with
the same bound. Neither round needs the texts or ids of another partition, so only rows of a few numbers are shuffled, and neither
holds more than `open_bins` bins.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, parts, tidy, written
from .tokenizing import STEP, encoder, tokenizer_path

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Bins:
    """Open bins of `size` places, at most `most` of them."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.bits, self.count, self.next = 0, 0, 0
        self.by_free: dict[int, list[list]] = defaultdict(list)

    def _take(self, free: int) -> list:
        found = self.by_free[free].pop()
        self.count -= 1
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        return found

    def add(self, item, length: int) -> list[tuple]:
        """Place an item; the rows (item, bin, offset) of a bin that closes through it."""
        fitting = self.bits >> length
        if fitting:
            free = length + ((fitting & -fitting).bit_length() - 1)
            bin_ = self._take(free)
        else:
            free, bin_ = self.size, [self.next, []]
            self.next += 1
        bin_[1].append((item, self.size - free))
        if free == length:
            return self._rows(bin_)
        left = free - length
        self.by_free[left].append(bin_)
        self.bits |= 1 << left
        self.count += 1
        if self.count > self.most:
            return self._rows(self._take((self.bits & -self.bits).bit_length() - 1))
        return []

    @staticmethod
    def _rows(bin_: list) -> list[tuple]:
        return [(item, bin_[0], at) for item, at in bin_[1]]

    def rest(self) -> Iterator[list[tuple]]:
        for bins in self.by_free.values():
            for bin_ in bins:
                yield self._rows(bin_)
        self.by_free.clear()


def pieces(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length): one piece if the n tokens fit, else a first of n mod size tokens, if any, and full ones."""
    if n <= size:
        return [(0, n)]
    first = n % size
    return ([(0, first)] if first else []) + [(at, size) for at in range(first, n, size)]


def _packed(path: str, size: int, open_bins: int, end: int):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        base, bins, encode, closed = part << 36, Bins(size, open_bins), encoder(path, "spaced", "I"), []
        tail = encode.pack([end])
        types = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int32()), ("open", pa.bool_())])

        def batch(rows, still_open):
            columns = list(zip(*[(*item, base + b, at, part, still_open) for item, b, at in rows]))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)

        for given in parts(batches, STEP):
            for doc, ids in zip(given.column("doc_id").to_pylist(), encode(given.column("text"))):
                ids += tail
                for k, (start, length) in enumerate(pieces(len(ids) // 4, size)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    closed += bins.add((doc, k, start, length, crc), length)
            if len(closed) > 5_000:
                yield batch(closed, False)
                closed = []
        if closed:
            yield batch(closed, False)
        last = [row for rows in bins.rest() for row in rows]
        if last:
            yield batch(last, True)

    return run


def _repacked(size: int, open_bins: int):
    def run(batches):
        from pyspark import TaskContext

        base, bins, closed = (1 << 62) | (TaskContext.get().partitionId() << 36), Bins(size, open_bins), []
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        types = [pa.int32() if n == "piece" else pa.int64() for n in names]

        def out(rows):
            columns = zip(*[(*item, base + b, at) for item, b, at in rows])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            for item in zip(*[batch.column(n).to_pylist() for n in names[:5]]):
                closed += bins.add(item, item[3])
            if closed:
                yield out(closed)
                closed = []
        last = [row for rows in bins.rest() for row in rows]
        if last:
            yield out(last)

    return run


def best_fit_pack(docs: DataFrame, tokenizer: str | None = None, size: int = 2048, open_bins: int = 512, merge: int = 16, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most `size` tokens; one row per piece.

    A null or empty text is the end id alone. A null id stays null, and rows with the same id are separate documents.
    An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    rows = written(id_text(docs, id_col, text_col).mapInArrow(tidy(_packed(path, size, open_bins, end)), f"{SCHEMA}, part int, open boolean"), "packing")
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    sets = ((rows.agg(F.max("part")).first()[0] or 0) + merge) // merge
    dealt = rows.where("open").withColumn("set", F.col("part") % sets).repartition(sets, "set").sortWithinPartitions("set", "part", "sequence_id", "offset")
    again = written(dealt.select(names).mapInArrow(tidy(_repacked(size, open_bins)), SCHEMA), "repacked")  # a table: sequences are numbered by task
    return rows.where("not open").select(names).unionByName(again)
