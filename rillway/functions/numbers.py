"""Number and date functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway.sources.fields import named


def round_to_long(c: Column) -> Column:
    """Nearest integer, halves away from zero."""
    return F.round(c).cast("long")


def ceil_to_long(c: Column) -> Column:
    return F.ceil(c).cast("long")


def calc_round(df: DataFrame, source: str, out: str, up: bool = False) -> DataFrame:
    """Add the rounded value as a new column; the source column stays."""
    return df.withColumn(out, (ceil_to_long if up else round_to_long)(named(source)))


def years_since(year: Column, as_of: int = 2025) -> Column:
    """Years from a year number to a fixed year."""
    return F.lit(as_of).cast("long") - year.cast("long")


def safe_divide(a: Column, b: Column) -> Column:
    """Quotient, NULL where the divisor is 0."""
    return F.try_divide(a, b)


def money(c: Column) -> Column:
    """Fixed-point amount, so that sums do not depend on the order of rows."""
    return c.cast("decimal(18,2)")


def stamp_text(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd_HHmmss")


def literal(text: str | None, type_name: str, is_null: bool = False, group: str = "") -> Column:
    """Typed constant from its text form."""
    if is_null or text is None:
        return F.lit(None).cast(type_name)
    return F.lit(text.replace(group, "") if group else text).cast(type_name)
