"""Rows from arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway.sources.fields import named


def rows_of(df: DataFrame, keep: str, array: Column, *, item: str = "item", position: str | None = None) -> DataFrame:
    """One row per array element, with the column ``keep``.

    For a plain explode the optimizer adds a filter on the size of the array, which computes a
    computed array twice. The outer form computes it once; its rows without an element are dropped.
    """
    spread = df.select(named(keep), F.posexplode_outer(array).alias("_pos", item)).filter("_pos IS NOT NULL")
    return spread.withColumnRenamed("_pos", position) if position else spread.drop("_pos")
