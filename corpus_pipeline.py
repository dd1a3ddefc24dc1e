"""From raw documents to packed sequences: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm.contamination import drop_contaminated
from rillway.llm.near_duplicates import near_duplicates
from rillway.llm.packing_queries import pack_documents
from rillway.llm.quality_votes import judged
from rillway.llm.repeated_passages import remove_repeats
from rillway.operators.ordering import rank_rows
from rillway.session import scratch_path
from rillway.sources.fields import named
from rillway.sources.tables import read_folder_table


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` has not."""
    return "_".join([name, *docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the voting rules find good.

    Null and empty texts have no words and go. Each row is judged by its own text, so equal rows share a verdict
    and ids may be null or repeated. Other columns stay, whatever their names; an empty table stays empty.
    """
    rows, verdict = judged(docs)
    return rows.filter(F.col(verdict).getField("kept")).select([named(c) for c in docs.columns])


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the rows with the smallest id.

    Rows without an id stay, and so do null, empty and blank texts, which resemble nothing. Rows that
    repeat an id are judged each by its own text; equal rows share the smallest id and go or stay together. Other
    columns stay, whatever their names; an empty table stays empty.
    """
    number, key = fresh(docs, "number"), fresh(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64(named("text").cast("string")))
    texts = keyed.select("doc_id", named(key).alias("key")).filter("doc_id IS NOT NULL").distinct()
    if texts.groupBy("doc_id").count().filter("count > 1").isEmpty():
        copies = near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias(number)).distinct()
        return docs.join(copies, named("doc_id") == named(number), "left_anti")
    # Texts that share an id get numbers of their own, in the order of the ids.
    ranked = rank_rows(texts, ["doc_id", "key"], out=number).withColumnsRenamed({"doc_id": f"id_{number}", "key": f"key_{number}"})
    same = (named("doc_id") == named(f"id_{number}")) & (named(key) == named(f"key_{number}"))
    numbered = keyed.join(ranked, same, "left")
    copies = near_duplicates(numbered, id_col=number).filter("NOT kept").select(named(number)).distinct()
    return numbered.join(copies, number, "left_anti").select([named(c) for c in docs.columns])


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more that one with a smaller id has; n_chars follows.

    Null texts stay null, rows without an id stay as they are, texts of fewer words too. A passage that two
    rows of one id share is in no smaller id. Other columns stay, whatever their names; an empty table stays empty.
    """
    return remove_repeats(docs, length_col="n_chars")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Null and empty texts hold none, and rows without an id stay; of rows that repeat an id none stays if one
    holds an item. Other columns stay, whatever their names; an empty table of documents or items drops nothing.
    """
    return drop_contaminated(docs, read_folder_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its sequence and offset.

    A null or empty text is one piece of one token; rows are packed each for itself, whatever their ids; other
    columns are left out; an empty table gives no rows.
    """
    return pack_documents(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("near duplicates", keep_one_of_near_duplicates),
    ("repeated passages", cut_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_folder_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


# Voting rules with estimated accuracies and tokenization have no SQL form.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
