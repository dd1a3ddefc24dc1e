"""Grouping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway.functions.numbers import money
from rillway.sources.fields import named


def count_rows(out: str) -> Column:
    return F.count(F.lit(1)).alias(out)


def count_values(col: str, out: str) -> Column:
    """Number of non-null values."""
    return F.count(named(col)).alias(out)


def sum_of(col: str, out: str, amount: bool = False) -> Column:
    """Sum; an amount is summed in fixed point, so the result is the same in any row order."""
    return (F.sum(money(named(col))).cast("double") if amount else F.sum(named(col))).alias(out)


def avg_of(col: str, out: str, amount: bool = False) -> Column:
    if amount:
        return F.try_divide(F.sum(money(named(col))).cast("double"), F.count(named(col))).alias(out)
    return F.avg(named(col)).alias(out)


def agg_text(sql: str, out: str) -> Column:
    """An aggregate given as SQL text."""
    return F.expr(sql).alias(out)


def group_by(df: DataFrame, keys: str | Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Global grouping: each task reduces its rows first, then groups meet in a shuffle."""
    keys = [keys] if isinstance(keys, str) else keys
    return df.groupBy(*[named(k) for k in keys]).agg(*aggs)


def group_stats(
    df: DataFrame, key: str, value: str, *, count: str, average: str, total: str, amount: bool = True
) -> DataFrame:
    return group_by(
        df, key, [count_rows(count), avg_of(value, average, amount=amount), sum_of(value, total, amount=amount)]
    )


def attach_groups(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Each row with aggregates of its group.

    Groups are aggregated and joined back. A window would give the same, but with all rows of a
    group in one task.
    """
    groups = df.groupBy(*[named(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*aggs)
    same = reduce(and_, [named(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return df.join(groups, same).drop(*[f"_k{i}" for i in range(len(keys))])


def compare_means(df: DataFrame, before: str, after: str) -> DataFrame:
    """Number of rows, both means, and their difference.

    Scores are summed in fixed point, so the means are the same in any row order.
    """
    def mean(col: str) -> Column:
        return F.try_divide(F.sum(named(col).cast("decimal(20,10)")).cast("double"), F.count(named(col)))

    means = df.agg(count_rows("n_rows"), mean(before).alias("mean_before"), mean(after).alias("mean_after"))
    return means.withColumn("improvement", F.col("mean_after") - F.col("mean_before"))
