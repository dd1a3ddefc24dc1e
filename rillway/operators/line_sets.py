"""Set operations on rows and on the lines of two texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway.functions.binding import let
from rillway.operators.arrays import rows_of
from rillway.sources.fields import named


def union_rows(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, matched by column name."""
    return reduce(DataFrame.unionByName, frames)


def line_multiset_diff(df: DataFrame, key: str, before: Column, after: Column) -> DataFrame:
    """Lines that only one side has, per document, with the surplus number of copies.

    ``before`` and ``after`` are arrays of lines in the same row, so both sides come from one scan.
    Copies are summed as +1 and -1 before and after one shuffle. Equal documents give no rows.
    """

    def signed(lines: Column, sign: int) -> Column:
        return F.transform(lines, lambda x: F.struct(x.alias("line"), F.lit(sign).alias("sign")))

    pieces = let(
        F.struct(before.alias("before"), after.alias("after")),
        lambda p: F.when(
            ~p["before"].eqNullSafe(p["after"]), F.concat(signed(p["before"], -1), signed(p["after"], 1))
        ),
    )
    lines = rows_of(df, key, pieces, item="piece").select(named(key), "piece.*")
    net = lines.groupBy(named(key), "line").agg(F.sum("sign").alias("net")).filter("net <> 0")
    return net.select(
        named(key),
        F.when(F.col("net") > 0, "DIFF_INSERT").otherwise("DIFF_DELETE").alias("rule"),
        "line",
        F.abs("net").alias("copies"),
    )
