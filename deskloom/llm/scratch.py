"""Shared-folder tables that cut lineage and survive the loss of executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local one where that is unset, as in tests, and never on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "deskloom-checkpoints")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str, *used: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back, so that later plans start from files all executors share.

    ``used`` are tables made here that nothing needs once ``df`` is written; their folders are deleted then.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch_path = path
    for x in used:
        drop(x)
    return made


def drop(made: DataFrame) -> None:
    """Delete the folder of a table that ``table`` made."""
    spark = made.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(made.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
