"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Settings the jobs rely on.  All are runtime settings a cluster profile may override.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Times with least and largest values in the files, which date ranges are cut by.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # Archive rows carry whole files; small batches keep a Python worker's memory bounded.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build_session(master: str | None = None, app_name: str = "mailweave", **conf: str) -> SparkSession:
    """Create or reuse a session with the defaults; keyword settings use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else a folder in the warehouse, if that is not one machine's own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not spark.sparkContext.master.startswith("local") and ("://" not in warehouse or warehouse.startswith("file:")):
        raise RuntimeError("on a cluster spark.checkpoint.dir names the folder that all executors share; it is not set")
    return os.path.join(warehouse, "scratch")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one that nothing will read again."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def files_stamp(spark: SparkSession, *paths: str) -> tuple:
    """Lengths and times of all files below some paths: it changes when they do."""
    found = []
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(target, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def materialise(df, name: str, *partition_by: str):
    """Write ``df`` once below the shared folder and read it back, cutting its lineage.

    Unlike an executor-local cache the files outlive lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
