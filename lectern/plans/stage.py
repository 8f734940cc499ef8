"""Tables between steps, in the folder that the cluster shares."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Seconds between collections of the driver's garbage, each of which halts all its threads.
GC_SECONDS = 2.0
_collected = -GC_SECONDS


def shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a local one if the session is of one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{os.path.join(tempfile.gettempdir(), 'lectern-audit')}"
    return f"{named.rstrip('/')}/audit"


def folder(spark: SparkSession, what: str) -> str:
    """A path for a table that nobody else uses."""
    return f"{shared(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df written once to the shared folder and read back."""
    path = folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, n: int, path: str) -> str:
    """df written once to path, dealt into n files by key; the name of the table, whose joins, windows and groups by key are not dealt out again."""
    name = f"lectern_{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    return name


def deleted(df: DataFrame) -> None:
    """Delete the files of a written table that nothing will read again."""
    files, spark = df.inputFiles(), df.sparkSession
    if files:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Delete the shuffle files of what is written: they stay until the driver collects its garbage, which may be never.

    Jobs that end within GC_SECONDS of a collection leave theirs to the next."""
    global _collected
    if time.monotonic() - _collected < GC_SECONDS:
        return
    _collected = time.monotonic()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def held(spark: SparkSession, settings: dict[str, str]):
    """Settings of the session for as long as the block runs."""
    was = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in was.items():
            spark.conf.set(key, value)


def stamp(spark: SparkSession, path: str, names: list[str]) -> tuple:
    """What tells whether tables under path are still the same: their sizes and times."""
    jvm = spark.sparkContext._jvm
    out = []
    for name in names:
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.parquet")
        s = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
        out.append((name, s.getLen(), s.getModificationTime()))
    return tuple(out)
