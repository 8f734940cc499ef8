"""Shared plumbing of the training-data operators: table access and lineage cuts."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only a session of one machine (master local) may go without that setting: a local folder is then
    made and recorded.  On a cluster its absence is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{os.path.join(tempfile.gettempdir(), 'lectern-shared')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_STAGED: list[str] = []


def released(spark: SparkSession, but: DataFrame) -> None:
    """Delete all staged tables except those that `but` reads.

    A pipeline calls this when a stage begins: what earlier stages staged has done its work, since
    their results are written.  Shuffle files that nothing refers to any more go too."""
    reads = but.inputFiles()
    for path in [p for p in _STAGED if not any(p.split("://")[-1].lstrip("/") in r for r in reads)]:
        _deleted(spark, path)
        _STAGED.remove(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def began() -> None:
    """Forget what was staged before, so that a pipeline releases only what its own stages stage."""
    _STAGED.clear()


def _deleted(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write df once to a table in the shared folder and read it back.

    The lineage ends there, and a lost executor costs no recomputation of what led to df.  The
    table is compressed and columnar, so later reads take only the columns they need."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern/{what}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read again."""
    files = df.inputFiles()
    if files:
        _deleted(spark, files[0].rsplit("/", 1)[0])
