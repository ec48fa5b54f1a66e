"""Running a stream over what is there, into a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """The rows a stream gives for all that is available now, written under `folder` with its checkpoint."""
    spark: SparkSession = stream.sparkSession
    path = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
