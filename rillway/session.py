"""Session settings and shared scratch space."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot join keys: AQE splits a shuffle partition that is much larger than the median.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # ... also where the split costs the grouping after the join a further shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Documents go to Python in batches: few, as one may be large.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def shuffle_settings(shuffled_bytes: int, partition_bytes: int = 256 * 1024 * 1024, cores: int = 8) -> dict[str, str]:
    """Number of shuffle partitions for the largest shuffle, so that one fits in a task's memory.

    AQE merges small partitions at run time, so a generous number costs little; it cannot make more.
    """
    wanted = max(cores, -(-shuffled_bytes // partition_bytes))
    return {"spark.sql.shuffle.partitions": str(wanted)}


def build_session(app: str, master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Where a local session may keep scratch that names no folder.
LOCAL_SCRATCH = "/tmp/rillway-scratch"


def scratch_root(spark: SparkSession) -> str:
    """This application's folder for written intermediate tables, where all executors can reach it.

    It is below the session's ``spark.checkpoint.dir``. Only a session whose executors run in the
    driver's own process may leave that out.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "local")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = LOCAL_SCRATCH
    return f"{root.rstrip('/')}/rillway/{spark.conf.get('spark.app.id', 'session')}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one intermediate table."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the session's file systems, if it is there."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables. DataFrames that read them can no longer run."""
    drop_path(spark, scratch_root(spark))
