"""Queries of the operators that judge or filter documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillway.llm import oracles
from rillway.llm.contamination import contaminated
from rillway.llm.quality_votes import judged
from rillway.llm.registry import query
from rillway.sources.tables import read_folder_table as table


@query()
def op5_rule_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, j = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")
    return rows.select("doc_id", *[f"{j}.{x}" for x in names])


@query(oracles.CONTAMINATION)
def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
