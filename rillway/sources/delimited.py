"""Delimited files: typed scan by column name, and sinks."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession

from rillway.session import drop_path, scratch_path
from rillway.sources.fields import Field, named, parse_field, struct_of


def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    fields: Sequence[Field],
    *,
    sep: str = ",",
    quote: str = '"',
    header: bool = True,
    glob: str | None = None,
    exclude: str | None = None,
    recursive: bool = False,
    required: bool = True,
    multiline: bool = True,
    empty_text: bool = False,
    encoding: str = "UTF-8",
) -> DataFrame:
    """Typed rows of delimited files.

    With a header, fields are found by name, in each file by its own header, so a field list may
    leave out columns anywhere, and files may order theirs differently. Without one, they are bound
    by position. Values may hold line breaks in quotes; a file is then one task's work, so keep
    files to a moderate size, or state ``multiline=False`` for large files known to have none.
    Files that ``exclude`` names are left out of the listing: they are never opened, whatever their header.
    An empty field is NULL; with ``empty_text`` a quoted one is an empty text, as
    ``write_delimited`` writes it.
    """
    reader = (
        spark.read.option("sep", sep)
        .option("quote", quote)
        .option("escape", quote)
        .option("header", header)
        .option("multiLine", multiline)
        .option("encoding", encoding)
        .option("recursiveFileLookup", recursive)
    )
    if empty_text:
        reader = reader.option("nullValue", _NO_VALUE)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if not header:
        reader = reader.schema(", ".join(f"`{f.name}` STRING" for f in fields))
    paths = path if isinstance(path, str) else list(path)
    try:
        if header and exclude:
            # Fields are found by opening files, so names are listed without them first.
            names = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", glob or "*").text(paths)
            listed = names.inputFiles()
        else:
            raw = reader.csv(paths)
            listed = raw.inputFiles() if header or exclude else []
    except AnalysisException as error:
        if required or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], struct_of(fields))
    parts = []
    if header or exclude:
        files = [f for f in listed if not exclude or not fnmatch.fnmatchcase(_base_name(f), exclude)]
        if not files:
            return spark.createDataFrame([], struct_of(fields))
        # The reader takes the header of one file for all, so files of another are read apart.
        by_header = _files_by_header(spark, files, encoding) if header else {"": files}
        if len(by_header) > 1 or len(files) < len(listed):
            parts = [_plain(reader).csv(some) for some in by_header.values()]
    if not parts:
        parts = [reader.csv(paths) if header and exclude else raw]
    chosen = []
    for part in parts:
        missing = [f.name for f in fields if f.name not in part.columns]
        if missing:
            raise ValueError(f"columns {missing} are not in the header {part.columns}")
        chosen.append(part.select([parse_field(f, named(f.name)).alias(f.name) for f in fields]))
    return reduce(DataFrame.unionByName, chosen)


# Stands for a field without a value where empty texts are kept; never text itself.
_NO_VALUE = "\ufdd0"


def _base_name(file: str) -> str:
    return unquote(file.rsplit("/", 1)[-1])


def _plain(reader: DataFrameReader) -> DataFrameReader:
    """The same reader for a list of files, which need no choice by name."""
    return reader.option("pathGlobFilter", "*").option("recursiveFileLookup", False)


def _files_by_header(spark: SparkSession, files: Sequence[str], encoding: str) -> dict[str, list[str]]:
    """Files by their first line, which is all that is read of them here."""
    context = spark.sparkContext
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first_line(file: str) -> str:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        stream = path.getFileSystem(conf).open(path)
        try:
            codec = codecs.getCodec(path)
            plain = codec.createInputStream(stream) if codec else stream
            return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, encoding)).readLine() or ""
        finally:
            stream.close()

    groups: dict[str, list[str]] = {}
    with ThreadPoolExecutor(16) as pool:
        for file, line in zip(files, pool.map(first_line, files)):
            groups.setdefault(line, []).append(file)
    return {line: some for line, some in groups.items() if line} or groups


def write_delimited(
    df: DataFrame,
    path: str,
    *,
    sep: str = ",",
    quote: str = '"',
    header: bool = True,
    append: bool = False,
    extension: str = "csv",
    date_format: str = "yyyy-MM-dd",
    timestamp_format: str = "yyyy-MM-dd HH:mm:ss.SSSSSS",
    partition_by: Sequence[str] = (),
) -> None:
    """Write a folder of delimited part files, one per task; parent folders are made as needed.

    ``extension`` has three letters. Values with line breaks are quoted; NULL is an empty field and
    an empty text a quoted one, so ``read_delimited`` with ``empty_text`` gives back every value.
    """
    writer = (
        df.write.mode("append" if append else "overwrite")
        .option("sep", sep)
        .option("quote", quote)
        .option("escape", quote)
        .option("header", header)
        .option("extension", extension)
        .option("dateFormat", date_format)
        .option("timestampFormat", timestamp_format)
        .option("timestampNTZFormat", timestamp_format)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def write_single_file(df: DataFrame, path: str, **options) -> None:
    """Write a report as one part file, whatever its size.

    The rows are computed in parallel into scratch; one task then streams them into the file. For
    large results the part files of ``write_delimited`` are the better form.
    """
    aside = scratch_path(df.sparkSession, "report")
    df.write.parquet(aside)
    write_delimited(df.sparkSession.read.parquet(aside).coalesce(1), path, **options)
    drop_path(df.sparkSession, aside)


def output_name(
    base: str,
    *,
    extension: str = "",
    add_date: bool = False,
    add_time: bool = False,
    part: int | None = None,
    at: datetime | None = None,
) -> str:
    """Sink name with the optional date, time and part suffixes."""
    if (add_date or add_time) and at is None:
        raise ValueError("a date or time suffix needs a moment, given as at=")
    pieces = [base]
    if add_date:
        pieces.append(at.strftime("%Y%m%d"))
    if add_time:
        pieces.append(at.strftime("%H%M%S"))
    if part is not None:
        pieces.append(str(part))
    return "_".join(pieces) + (f".{extension}" if extension else "")


def overwrite_source(df: DataFrame, path: str, **options) -> None:
    """Replace the delimited files that ``df`` itself was read from.

    The result is written aside and read back before the old files are touched.
    """
    aside = scratch_path(df.sparkSession, "aside")
    df.write.parquet(aside)
    write_delimited(df.sparkSession.read.parquet(aside), path, **options)
    drop_path(df.sparkSession, aside)
