"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from stratamill.types import Refusal


def folder(spark: SparkSession) -> str:
    """The shared folder for tables that are written and read again; one is set only where the session has none and runs on this machine alone, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise Refusal("checkpoint_dir", "set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints", "stratamill"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    spark = df.sparkSession
    shared = folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder by columns and read again: for long tables, of which later steps read some columns."""
    path = f"{folder(df.sparkSession)}/stratamill/{uuid.uuid4().hex}/written"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Write a small file to any store that Spark reaches."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop)
    out.write(bytearray(content))
    out.close()
