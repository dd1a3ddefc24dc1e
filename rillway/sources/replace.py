"""Files of a folder replaced by new texts, so that a run that stops half-way loses nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.session import drop_path
from rillway.sources.documents import write_documents
from rillway.sources.fields import named

# New texts and the list of moves wait here, below the folder; readers pass over names with an underscore.
JOURNAL = "_replacing"


def _journal(folder: str) -> str:
    return f"{folder.rstrip('/')}/{JOURNAL}"


def _file_system(spark: SparkSession, path: str):
    """The path's file system; a local one without checksum files, which would outlive a later edit by hand."""
    context = spark.sparkContext
    system = context._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(context._jsc.hadoopConfiguration())
    return system.getRawFileSystem() if system.getUri().getScheme() == "file" else system


def _move(spark: SparkSession, source, target) -> None:
    """Put one file in the place of another, both Hadoop paths, in one step."""
    context = spark.sparkContext
    fs, conf = context._jvm.org.apache.hadoop.fs, context._jsc.hadoopConfiguration()
    system = _file_system(spark, target.toString())
    if system.getUri().getScheme() == "file":
        system.delete(fs.Path(target.getParent(), f".{target.getName()}.crc"), False)
        if not system.rename(source, target):
            raise OSError(f"{source} could not be moved to {target}")
        return
    options = context._gateway.new_array(fs.Options.Rename, 1)
    options[0] = fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(target.toUri(), conf).rename(source, target, options)


def replace_files(df: DataFrame, folder: str, name_col: str, text_col: str) -> None:
    """Give files of ``folder`` new texts; files that are not there yet are made. Names are unique.

    All texts are written aside first, then the list of moves, whose success mark is the decision: before it, the
    folder is as it was; after it, every file has its old or its whole new text, and ``finish_replacing`` moves
    the rest, after a stop by whoever comes next. ``df`` may be read from these very files.
    """
    spark, journal = df.sparkSession, _journal(folder)
    finish_replacing(spark, folder)
    staged = df.select(named(name_col).alias("name"), named(text_col).alias("text")).withColumn(
        # A name of letters and digits, which as a folder name is never taken for a number.
        "place", F.concat(F.lit("x"), F.md5(F.col("name").cast("binary")))
    )
    write_documents(staged, f"{journal}/texts", "place", "text")
    placed = spark.read.text(f"{journal}/texts").select("place", F.col("_metadata.file_path").alias("source")).distinct()
    staged.select("name", "place").join(placed, "place").write.parquet(f"{journal}/moves")
    finish_replacing(spark, folder)


def finish_replacing(spark: SparkSession, folder: str) -> bool:
    """Finish what a stopped ``replace_files`` had decided, or drop what it had not; whether it had decided.

    Only names pass through the driver, one after the other.
    """
    journal = _journal(folder)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = _file_system(spark, journal)
    decided = system.exists(fs.Path(f"{journal}/moves/_SUCCESS"))
    if decided:
        for move in spark.read.parquet(f"{journal}/moves").toLocalIterator():
            source = fs.Path(spark.sparkContext._jvm.java.net.URI(move.source))
            if system.exists(source):
                _move(spark, source, fs.Path(folder, move.name))
    drop_path(spark, journal)
    return decided

