"""Token ids as length-delimited binary records, with an offset index beside them.

A file holds records in ascending doc_id order. Its first record, the head, has no ids and says which file it is: range << 32 | place within the
range, by which files ascend; their names, which Spark chooses, mean nothing. A file ends with the record that fills FILE_BYTES, so a reader that takes a file whole is bounded. A record is

    u64  length of the payload in bytes, little-endian
    u32  masked CRC-32 of those 8 bytes
    ...  payload
    u32  masked CRC-32 of the payload
    u8   0x0A

and a payload is: i64 doc_id, u8 flags (bit 0: doc_id is null, bit 1: ids take 4 bytes, else 2, bit 2: the head, whose number stands for doc_id), then the ids. The mask
turns a checksum c into (c >> 15 | c << 17) + 0xa282ead8 modulo 2**32, so that a checksum of stored checksums isn't
degenerate. Spark's text sink writes the files and ends each record with the line feed: it commits each task's files once, in any
store that Spark reaches, whichever executors are lost. The index has a row for each record: file, byte offset and
length, and the number of ids before it in its file, so that a reader can shuffle records without scanning files.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_text, parts, scratch, tasks, tidy
from .tokenizing import STEP, encoder, tokenizer_path

FILE_BYTES = 16_000_000
HEAD, INDEX_SCHEMA = struct.Struct("<QI"), "file string, number long, offset long, length long, doc_id long, file_start long, n_tokens long, ids_crc32 long"


def masked(data) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, wide: bool, head: bool = False) -> bytes:
    """A record without its last byte, which the sink adds."""
    payload = struct.pack("<qB", doc_id or 0, (doc_id is None) | wide << 1 | head << 2) + ids
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def parse(content: bytes, heads: bool = False):
    """(offset, length, doc_id, ids as an array) of each record of a file, on request of its head alone; ValueError where it is damaged."""
    at, view = 0, memoryview(content)
    while at < len(content):
        if len(content) - at < HEAD.size:
            raise ValueError(f"record cut off at byte {at}")
        size, check = HEAD.unpack_from(content, at)
        if masked(view[at : at + 8]) != check or len(content) < (end := at + HEAD.size + size) + 5:
            raise ValueError(f"damaged length at byte {at}")
        payload = view[at + HEAD.size : end]
        if masked(payload) != struct.unpack_from("<I", content, end)[0] or content[end + 4] != 10:
            raise ValueError(f"damaged record at byte {at}")
        doc_id, flags = struct.unpack_from("<qB", payload)
        if heads == bool(flags & 4):
            yield at, end + 5 - at, None if flags & 1 else doc_id, np.frombuffer(payload[9:], "<u4" if flags & 2 else "<u2")
        if heads:
            return
        at = end + 5


def _framed(path: str, end: int, wide: bool, most_records: int, most_bytes: int):
    """One row for each file: its records, all but the last with their line feed."""

    def run(batches):
        from pyspark import TaskContext

        encode = encoder(path, "words", "I" if wide else "H")
        tail, held, size, number = encode.pack([end]), [], 0, TaskContext.get().partitionId() << 32

        def out():
            return pa.RecordBatch.from_arrays([pa.array([b"\n".join((frame(number, b"", wide, True), *held))], pa.binary())], ["value"])

        for given in parts(batches, STEP):
            for doc_id, ids in zip(given.column("doc_id").to_pylist(), encode(given.column("text"))):
                held.append(frame(doc_id, ids + tail, wide))
                size += len(held[-1]) + 1
                if size >= most_bytes or len(held) >= most_records:
                    yield out()
                    held, size, number = [], 0, number + 1
        if held:
            yield out()

    return run


def _indexed(batches):
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows, start, held = [], 0, content.as_buffer().to_pybytes()
            number = next((x[2] for x in parse(held, heads=True)), None)
            for offset, length, doc_id, ids in parse(held):
                rows.append((path, number, offset, length, doc_id, start, len(ids), zlib.crc32(ids.astype("<u4"))))
                start += len(ids)
            if rows and number is None:
                raise ValueError(f"no head in {path}")
            if rows:
                types = [pa.string()] + [pa.int64()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [f.split()[0] for f in INDEX_SCHEMA.split(", ")])


def write_records(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = 2, wide: bool = False, records_per_file: int = 20_000, file_bytes: int = FILE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, add the id `end` and write the records under `path`. wide: 4 bytes an id, for vocabularies beyond 65,536.

    Texts are dealt by ranges of doc_id and of how the text begins, of which Spark samples the bounds, and sorted within them; rows with the
    same id follow each other in order of their texts, and many of them are many ranges. A null id comes first, a null text is empty.
    """
    rows = id_text(docs, id_col, text_col)
    dealt = rows.repartitionByRange(tasks(docs), F.col("doc_id"), F.substring("text", 1, 24)).sortWithinPartitions("doc_id", "text")
    files = dealt.mapInArrow(tidy(_framed(tokenizer or tokenizer_path("word_bpe_49k.json"), end, wide, records_per_file, file_bytes)), "value binary")
    files.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Read the record files under `path` back, checking every checksum: the rows of their offset index."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(tidy(_indexed), INDEX_SCHEMA)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (array of int) of all records under `path`."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = [(doc_id, ids.astype("int32")) for _, _, doc_id, ids in parse(content.as_buffer().to_pybytes())]
                for i in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i : i + 500]], pa.int64()), pa.array([r[1] for r in rows[i : i + 500]], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, "doc_id long, ids array<int>")


def with_starts(index: DataFrame) -> DataFrame:
    """The index of read_index() with `start`, the ids of all records before, by the numbers in the files' heads.

    Only the totals of ranges meet in one task.
    """
    totals = index.groupBy("number").agg(F.sum("n_tokens").alias("total")).withColumn("range", F.shiftright("number", 32))
    ahead = lambda w: F.coalesce(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = totals.withColumn("inside", ahead(Window.partitionBy("range").orderBy("number")))
    ranges = totals.groupBy("range").agg(F.sum("total").alias("total")).select("range", ahead(Window.orderBy("range")).alias("outside"))
    before = files.join(ranges, "range").select("number", (F.col("inside") + F.col("outside")).alias("before"))
    return index.join(before, "number").withColumn("start", F.col("before") + F.col("file_start")).drop("before")


def token_records(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write records and their index (path/records, path/index), and give the index with `start`, the ids of all documents before.

    Rows with the same id, or none, each have a record, in order of their texts; null texts are empty and have the id `end` alone; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "records")
    write_records(docs, f"{path}/records", **options)
    read_index(spark, f"{path}/records").write.parquet(f"{path}/index")
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")
    return with_starts(index)
