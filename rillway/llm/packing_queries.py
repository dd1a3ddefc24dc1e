"""Query of the packing operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rillway.llm.packing import pack
from rillway.llm.registry import query
from rillway.sources.tables import read_folder_table as table

TOKENIZER = "byte_bpe_50k.json"


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


@query()
def op9_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
