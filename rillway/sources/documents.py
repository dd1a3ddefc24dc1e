"""Whole documents, text lines, JSON lines, reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.sources.delimited import write_delimited
from rillway.sources.fields import file_name

_REPLACEMENT = "\ufffd"
_PLACEHOLDER = "\ufdd0"  # a code point that is never a character


def _any_case(extension: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension.lstrip("."))


def valid_text(content: Column) -> Column:
    """UTF-8 text of a binary column; bytes that cannot be decoded are dropped."""
    raw = content.cast("string")
    # U+FFFD that the text itself holds is set aside, so that only the inserted ones are dropped.
    shielded = F.replace(raw, F.lit(_REPLACEMENT), F.lit(_PLACEHOLDER))
    dropped = F.replace(F.make_valid_utf8(shielded), F.lit(_REPLACEMENT), F.lit(""))
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(dropped, F.lit(_PLACEHOLDER), F.lit(_REPLACEMENT)))


def read_documents(spark: SparkSession, folder: str, extensions: Sequence[str], recursive: bool = False) -> DataFrame:
    """One row per file with one of the extensions: ``name``, ``stem``, ``ext``, ``text``.

    Extensions match in any letter case. A document is held whole in one row.
    """
    pattern = "*.{" + ",".join(_any_case(e) for e in extensions) + "}"
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", recursive)
        .load(folder)
    )
    name = file_name()
    return files.select(
        name.alias("name"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext"),
        valid_text(F.col("content")).alias("text"),
    )


def write_documents(df: DataFrame, folder: str, name_col: str, text_col: str, mode: str = "overwrite") -> None:
    """One text file per row, in a sub-folder ``name_col=<value>``. A file ends with one line end."""
    text = F.regexp_replace(text_col, r"\n\z", "")
    df.select(name_col, text.alias("value")).write.mode(mode).partitionBy(name_col).text(folder)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Text lines, column ``value``."""
    return spark.read.text(path)


def write_text(df: DataFrame, path: str, *, sep: str = ",", append: bool = False) -> None:
    """Text lines: all columns joined by ``sep``; NULL becomes an empty piece."""
    pieces = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    df.select(F.concat_ws(sep, *pieces).alias("value")).write.mode("append" if append else "overwrite").text(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_report(df: DataFrame, folder: str, prefix: str, at: datetime, fmt: str = "csv") -> str:
    """Write a report under ``<prefix>_<yyyyMMdd_HHmmss>`` and return its path."""
    path = f"{folder.rstrip('/')}/{prefix}_{at.strftime('%Y%m%d_%H%M%S')}"
    if fmt == "csv":
        write_delimited(df, path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)
    return path
