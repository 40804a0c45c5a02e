"""Shared storage for intermediate tables.

Multi-pass operators cut their lineage by writing a Parquet table into the
folder named by ``spark.checkpoint.dir``: every executor sees that folder, so a
lost executor costs a re-read and not a recomputation, and the planner knows the
table's real size when it decides on a broadcast.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a default is set only where the session has none and runs on this machine alone, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints", "stratamill")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """Where this application's tables are."""
    return f"{shared_dir(spark)}/stratamill/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path) -> None:
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_stages(spark: SparkSession) -> None:
    """Remove all tables that this application staged; results that weren't written elsewhere go with them."""
    _delete(spark, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session_dir(spark)))


def drop_stage(df: DataFrame) -> None:
    """Remove a table that stage() wrote and that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if f"/stratamill/{spark.sparkContext.applicationId}/" in str(path):
            _delete(spark, path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df under the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that nothing refers to any more; it finds them when the driver collects its garbage, which a large heap puts off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of an Arrow batch: those that wait on both sides of the pipe count as an executor's memory, outside its heap.
BATCH = 8 << 20


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower an Arrow batch to `rows` rows and BATCH bytes: texts and token blocks are long, and a batch of 10,000 texts takes some 100 MB on each side of the pipe."""
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH)):
        key = f"spark.sql.execution.arrow.{key}"
        now = size(spark.conf.get(key))
        if now <= 0 or now > most:
            spark.conf.set(key, most)


def free_name(name: str, columns: list[str]) -> str:
    """name, with as many underscores before it as it takes to clash with no column (Spark tells no case apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str, batch: int = 1000) -> DataFrame:
    bound_batches(spark, batch)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
