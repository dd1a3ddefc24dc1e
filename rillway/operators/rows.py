"""Projection, filtering and routing of rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillway.sources.fields import named


def inline_rows(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A small literal table."""
    return spark.createDataFrame(list(rows), schema)


def select_fields(df: DataFrame, fields: Sequence[str] | Mapping[str, str], keep_rest: bool = False) -> DataFrame:
    """The listed fields in that order, renamed where a mapping gives a new name.

    ``keep_rest`` puts the other fields after them.
    """
    renames = dict(fields) if isinstance(fields, Mapping) else {f: f for f in fields}
    chosen = [named(old).alias(new or old) for old, new in renames.items()]
    rest = [named(c) for c in df.columns if c not in renames] if keep_rest else []
    return df.select(chosen + rest)


def equals(col: str, value: Any) -> Column:
    return named(col) == F.lit(value)


def above(col: str, value: Any) -> Column:
    """Strictly greater."""
    return named(col) > F.lit(value)


def all_of(*conditions: Column) -> Column:
    return reduce(and_, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(or_, conditions)


def negate(condition: Column) -> Column:
    """Logical not; an unknown condition stays unknown."""
    return ~condition


def where(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows for which a condition, or SQL condition text, is true."""
    return df.filter(condition)


def passes(condition: Column) -> Column:
    """The condition as a two-valued column: unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def split_rows(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet a condition, and all other rows. Unknown goes to the second part."""
    return df.filter(condition), df.filter(~passes(condition))
