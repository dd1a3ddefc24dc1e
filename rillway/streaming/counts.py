"""Counts kept by a stream over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillway.session import scratch_path
from rillway.sources.fields import named


def stream_files(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int = 1000
) -> DataFrame:
    """A stream over the files of a folder (or one file), in batches of bounded size."""
    return (
        spark.readStream.format(fmt)
        .schema(schema)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )


def stream_counts(stream: DataFrame, key: str, target: str, checkpoint: str, out: str = "n") -> None:
    """Count rows per key over all files that are there, and keep the result as a table at ``target``.

    State is one row per key. Each batch writes the complete result to a folder of its own, so a
    batch that is run again after a failure changes nothing and the result before stays until the
    next is there; ``read_counts`` reads the last one. No files give an empty table.
    """
    counts = stream.groupBy(named(key)).agg(F.count(F.lit(1)).alias(out))

    def replace(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    if not _batches(stream.sparkSession, target):
        empty = stream.sparkSession.createDataFrame([], counts.schema)
        empty.write.mode("overwrite").parquet(f"{target}/batch=-1")

    query = (
        counts.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(replace)
        .start()
    )
    query.awaitTermination()


def _batches(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the batches whose results are whole."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(target)
    found = root.getFileSystem(conf).globStatus(jvm.org.apache.hadoop.fs.Path(f"{target}/batch=*/_SUCCESS"))
    return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in found or ())


def read_counts(spark: SparkSession, target: str) -> DataFrame:
    """The latest result that ``stream_counts`` has kept at ``target``."""
    return spark.read.parquet(f"{target}/batch={_batches(spark, target)[-1]}")


def count_files_as_stream(spark: SparkSession, path: str, schema: T.StructType, key: str, out: str = "n") -> DataFrame:
    target = scratch_path(spark, "stream-counts")
    stream_counts(stream_files(spark, path, schema), key, target, scratch_path(spark, "stream-state"), out)
    return read_counts(spark, target)
