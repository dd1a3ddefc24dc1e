"""Queries of the operators that look for repeated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm import oracles
from rillway.llm.near_duplicates import near_duplicates
from rillway.llm.registry import query
from rillway.llm.repeated_bytes import kept_bytes, repeat_spans
from rillway.llm.repeated_passages import kept_words, mark_repeats
from rillway.sources.tables import read_folder_table as table


@query(oracles.REPEATED_BYTES)
def op2_merged_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = repeat_spans(table(spark, sf_dir, "documents"))
    done = marked.select(F.col("id").alias("doc_id"), kept_bytes("text", "copy", "spans").alias("k"))
    return done.select("doc_id", "k.n_bytes", "k.n_removed", "k.n_spans", F.sha2("k.kept", 256).alias("kept_sha256"))


@query(oracles.REPEATED_PASSAGES)
def op8_cover_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_repeats(table(spark, sf_dir, "documents"))
    done = marked.select(F.col("id").alias("doc_id"), kept_words("text", "copy", "starts").alias("k"))
    return done.select("doc_id", "k.n_words", "k.n_removed", F.sha2(F.col("k.kept").cast("binary"), 256).alias("kept_sha256"))


@query(oracles.NEAR_DUPLICATES)
def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
