"""Queries of the trained models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm import quality_classifier, toxicity
from rillway.llm.registry import query
from rillway.sources.tables import read_folder_table as table


def fold(parts: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


# So many labels, at about 20 bytes, may go to every task; more are joined by a shuffle of the texts.
BROADCAST_LABELS = 2_000_000


def labelled_rows(spark: SparkSession, sf_dir: str, label: str, used: Column) -> DataFrame:
    """(text, label) of the rows that may be learned from."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label")).filter(used & F.col("label").isNotNull())
    if labels.count() <= BROADCAST_LABELS:
        labels = F.broadcast(labels)
    return table(spark, sf_dir, "documents").select("doc_id", "text").filter(used).join(labels, "doc_id").select("text", "label")


@query()
def op1_nb_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(3) == 1
    model, square = quality_classifier.fit(labelled_rows(spark, sf_dir, "quality", ~held_out), "text", "label")
    scored = quality_classifier.score(table(spark, sf_dir, "documents").select("doc_id", "text"), model, square)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op6_attentive_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(4) == 2
    detector = toxicity.fit(labelled_rows(spark, sf_dir, "toxic", ~held_out), "text", "label")
    scored = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), detector)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
