"""Reports over folders of spec documents and programs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.functions.text import stem_key
from rillway.operators.ordering import latest_per_key
from rillway.operators.quality import overwrite_programs, quality_report, report_rows, save_texts, summarise_quality
from rillway.operators.spec_documents import complexity, element_sets, step_inventory
from rillway.session import scratch_path
from rillway.sources.documents import read_documents, write_report
from rillway.sources.replace import finish_replacing


def read_named(spark: SparkSession, folder: str, extensions: Sequence[str], text: str) -> DataFrame:
    """Documents of a folder as ``name`` (without extension) and text."""
    return read_documents(spark, folder, extensions).select(F.col("stem").alias("name"), F.col("text").alias(text))


def folder_steps(spark: SparkSession, folder: str, extensions: Sequence[str]) -> DataFrame:
    """Steps of all spec documents of a folder."""
    return step_inventory(read_named(spark, folder, extensions, "xml").withColumnRenamed("name", "file"))


def run_complexity_report(
    spark: SparkSession,
    spec_folder: str,
    out_folder: str,
    extensions: Sequence[str],
    at: datetime,
    mode: str = "as_reference",
) -> DataFrame:
    """One row per document: sizes of the sets, score and level; written as ``complexity_report_<time>``."""
    named_specs = read_named(spark, spec_folder, extensions, "xml").withColumn("file", stem_key(F.col("name")))
    specs = latest_per_key(named_specs, "file", ["name"])
    path = write_report(
        complexity(element_sets(specs, mode=mode)).drop("name", "xml", "parsed"), out_folder, "complexity_report", at, "parquet"
    )
    return spark.read.parquet(path)


def run_quality_report(
    spark: SparkSession,
    spec_folder: str,
    program_folder: str,
    out_folder: str,
    extensions: Sequence[str],
    at: datetime,
    program_extensions: Sequence[str] = ("py",),
    mode: str = "keep",
) -> tuple[DataFrame, DataFrame]:
    """Clean and score all programs; returns the report and its means.

    Final texts go below ``out_folder``/texts, the report to ``correction_report_<time>``, its rows of differences
    to ``correction_rows_<time>``. With ``mode`` ``overwrite`` corrected texts replace the programs themselves. The
    report is computed once, into scratch: all results are taken from it.
    """
    specs = read_named(spark, spec_folder, extensions, "xml")
    finish_replacing(spark, program_folder)
    programs = read_documents(spark, program_folder, program_extensions).select(
        F.col("stem").alias("name"), F.col("text").alias("code"), F.col("name").alias("program")
    )
    aside = scratch_path(spark, "quality")
    quality_report(specs, programs, mode=mode).write.parquet(aside)
    report = spark.read.parquet(aside)
    if mode == "overwrite":
        overwrite_programs(report, program_folder)
    made = report.filter("action <> 'corrected'") if mode == "overwrite" else report
    save_texts(made, f"{out_folder.rstrip('/')}/texts")
    write_report(report_rows(report), out_folder, "correction_rows", at, "parquet")
    listed = report.withColumn("rules", F.array_join("rules", "|")).drop("text_before", "text_after")
    write_report(listed, out_folder, "correction_report", at)
    return report, summarise_quality(report)
