"""Tables that are replaced in steps which a failure can't leave half done.

The tables of a version are written whole to folders of their own and become the tables when its manifest is put in place by one rename; readers resolve the newest manifest
and so see the old rows or the new ones. A manifest carries the number of the batch that made it: a batch that is there already is not
applied again, so retries and replays change nothing. Tables whose partitions are replaced by themselves take Spark's dynamic overwrite.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


class Staging:
    """Intermediate tables of one computation, which cut its lineage; the one before last goes when a new one is put."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.path, self.made = spark, f"{shared_folder(spark)}/staging/{what}-{uuid.uuid4().hex}", []

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{len(self.made)}"
        df.write.parquet(path)
        self.made.append(path)
        if len(self.made) > 1:
            files = _files(self.spark, self.made[-2])
            files[0].delete(files[1], True)
        return self.spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


class StagedTables:
    """Tables under `path` that change together. One writer at a time: of two that make the same version, the later one gets an error and changes nothing."""

    def __init__(self, spark: SparkSession, path: str, schemas: Mapping[str, str]):
        self.spark, self.path = spark, path.rstrip("/")
        self.schemas = {name: spark.createDataFrame([], schema).schema for name, schema in schemas.items()}

    def _manifests(self) -> list[str]:
        files, where = _files(self.spark, f"{self.path}/log")
        names = [str(s.getPath().getName()) for s in files.listStatus(where)] if files.exists(where) else []
        return sorted(n for n in names if n.endswith(".json"))

    def _manifest(self, name: str) -> dict:
        files, where = _files(self.spark, f"{self.path}/log/{name}")
        stream = files.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def current(self) -> dict:
        """The newest manifest: version, the last batch of each writer, and the folder of each table."""
        names = self._manifests()
        return self._manifest(names[-1]) if names else {"version": 0, "batches": {}, "folders": {}}

    def read(self, name: str) -> DataFrame:
        """The rows of the newest version; none before the first."""
        folder, schema = self.current()["folders"].get(name), self.schemas[name]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}") if folder else self.spark.createDataFrame([], schema)

    def applied(self, writer: str, batch: int) -> bool:
        return self.current()["batches"].get(writer, -1) >= batch

    def _publish(self, before: dict, folders: Mapping[str, str], writer: str | None, batch: int | None) -> None:
        version = before["version"] + 1
        batches = before["batches"] | ({writer: batch} if writer is not None else {})
        text = json.dumps({"version": version, "batches": batches, "folders": before["folders"] | dict(folders)})
        files, part = _files(self.spark, f"{self.path}/log/.{uuid.uuid4().hex}")
        _, whole = _files(self.spark, f"{self.path}/log/{version:012}.json")
        stream = files.create(part)
        stream.write(bytearray(text.encode()))
        stream.close()
        if files.exists(whole) or not files.rename(part, whole):
            files.delete(part, False)
            raise RuntimeError(f"version {version} of {self.path} was written by another writer")

    def replace(self, tables: Mapping[str, DataFrame], writer: str | None = None, batch: int | None = None) -> bool:
        """The given tables' rows in place of theirs, all at once; False if the writer's batch is there already."""
        before = self.current()
        if writer is not None and before["batches"].get(writer, -1) >= batch:
            return False
        folders = {}
        for name, rows in tables.items():
            folders[name] = f"data/{before['version'] + 1}-{name}-{uuid.uuid4().hex}"
            rows.select([F.col(f.name).cast(f.dataType) for f in self.schemas[name]]).write.parquet(f"{self.path}/{folders[name]}")
        self._publish(before, folders, writer, batch)
        return True

    def upsert(self, name: str, rows: DataFrame, keys: Sequence[str], writer: str | None = None, batch: int | None = None, merge: Mapping[str, Callable[[Column, Column], Column]] | None = None) -> bool:
        """The rows in or over those of the same key; merge[c](old, new) gives a column where both have a row. Null keys match null keys."""
        if writer is not None and self.applied(writer, batch):
            return False
        names = [f.name for f in self.schemas[name]]
        old, new = self.read(name).withColumn("_o", F.lit(True)).alias("o"), rows.select(names).withColumn("_n", F.lit(True)).alias("n")
        both = old.join(new, reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]), "full_outer")
        value = lambda c: (merge or {}).get(c, lambda o, n: n)(F.col(f"o.{c}"), F.col(f"n.{c}"))
        out = [F.when(F.col("_o") & F.col("_n"), value(c)).when(F.col("_n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in names]
        return self.replace({name: both.select(out)}, writer, batch)

    def sink(self, name: str, keys: Sequence[str], writer: str, **options):
        """A function for foreachBatch which upserts each batch of a stream once, however often it is tried."""
        return lambda rows, batch: self.upsert(name, rows, keys, writer, batch, **options)

    def forget_old(self, keep: int = 2) -> None:
        """Deletes what only versions before the newest `keep` have; readers of those must be done."""
        names = self._manifests()
        held = {f for n in names[-keep:] for f in self._manifest(n)["folders"].values()}
        for n in names[:-keep]:
            for path in (*(f"{self.path}/{f}" for f in set(self._manifest(n)["folders"].values()) - held), f"{self.path}/log/{n}"):
                files, where = _files(self.spark, path)
                files.delete(where, True)


def replace_partitions(rows: DataFrame, path: str, *partitions: str) -> None:
    """The rows in place of those partitions of the Parquet table under `path` that they have; other partitions stay. Repeating it changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
