"""What the operators of this package share: sources, scratch tables, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Bytes of text that one step of a Python operator holds as Python objects.
STEP_BYTES = 1_500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_folder(spark)}/tallymart/{what}-{uuid.uuid4().hex}"
    spark_tables(spark).append(path)
    return path


def written(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """The rows of df as a Parquet table in the shared folder, which cuts the lineage and outlives executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def placed(df: DataFrame, what: str, key: str, buckets: int) -> DataFrame:
    """As written(), in buckets by the key: a grouping or join on it by as many tasks doesn't move these rows.

    The table is known to the catalog only while it is written and looked up.
    """
    spark, path, name = df.sparkSession, scratch(df.sparkSession, what), f"tallymart_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(name, format="parquet")
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay: they lie outside the warehouse
    out.scratch_path = path
    return out


def spark_tables(spark: SparkSession) -> list[str]:
    """Scratch paths that this driver has taken and not deleted."""
    sc = spark.sparkContext
    if not hasattr(sc, "_tallymart_tables"):
        sc._tallymart_tables = []
        atexit.register(_at_end, spark)
    return sc._tallymart_tables


def _at_end(spark: SparkSession) -> None:
    """Delete what a driver left that ends while its session is alive."""
    with contextlib.suppress(Exception):
        if not spark.sparkContext._jsc.sc().isStopped():
            clear(spark)


def settled(spark: SparkSession, make) -> DataFrame:
    """make(), a table of written() or components(), after which the other scratch tables that it took are deleted."""
    before = set(spark_tables(spark))
    out = make()
    for path in spark_tables(spark)[:]:
        if path not in before and path != out.scratch_path:
            remove(spark, path)
    return out


def tasks(df: DataFrame, per_task: int = 64_000_000) -> int:
    """Tasks for a shuffle of df, a source or a table of written(): as many as its bytes on disk ask for, spark.sql.shuffle.partitions at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // per_task)) if size < 1 << 60 else least  # Spark gives the largest number where it doesn't know


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables of this driver, once no DataFrame of this package is needed any more."""
    for path in spark_tables(spark)[:]:
        remove(spark, path)


def forget(df: DataFrame) -> None:
    """Delete a table of written() that nothing reads any more."""
    remove(df.sparkSession, df.scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path of this package."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in spark_tables(spark):
        spark_tables(spark).remove(path)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id as long and text with null as empty; other columns are not read."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names with underscores added until no column of df has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"_{n}"
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def crc_mod(column, n: int):
    """crc32 of the column as text, modulo n. A null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def parts(batches: Iterator, most: int, text: str = "text") -> Iterator:
    """The Arrow batches cut into parts of about `most` bytes of text; a longer text comes alone."""
    import pyarrow.compute as pc

    for batch in batches:
        at, size = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
            if size and size + n > most:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n
        if at < batch.num_rows:
            yield batch.slice(at)


def steps(batches: Iterator, text: str = "text") -> Iterator[tuple[object, list[str]]]:
    """(part of an Arrow batch, its texts)."""
    for part in parts(batches, STEP_BYTES, text):
        yield part, part.column(text).to_pylist()


def give_back() -> None:
    """Memory that this Python process no longer uses goes back to the machine."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """The Arrow function, after whose end a worker gives memory that it no longer uses back to the machine."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped
