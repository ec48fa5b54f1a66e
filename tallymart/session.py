"""Session settings that the library is meant to run with."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or that of setCheckpointDir. A local master without either gets a local one for this session.

    On a cluster each executor would write to a disk of its own and rows would vanish, so there a missing setting is an error.
    """
    sc = spark.sparkContext
    chosen = sc._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (chosen.get() if chosen.isDefined() else None) or getattr(sc, "_tallymart_dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = sc._tallymart_dir = tempfile.mkdtemp(prefix="tallymart-")
        atexit.register(shutil.rmtree, base, True)
    return base.rstrip("/")


def session(name: str = "tallymart", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; further settings by their names with underscores for points."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
