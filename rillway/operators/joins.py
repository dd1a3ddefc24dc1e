"""Equi joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway.functions.text import stem_key
from rillway.session import scratch_path
from rillway.sources.fields import named

Pairs = str | Sequence[str | tuple[str, str]]


def _pairs(on: Pairs) -> list[tuple[str, str]]:
    items = [on] if isinstance(on, str) else on
    return [(k, k) if isinstance(k, str) else tuple(k) for k in items]


def _right_names(left: DataFrame, right: DataFrame, suffix: str) -> dict[str, str]:
    """New names of the right columns; a taken name gets the suffix, again until it is free."""
    taken = {c.lower() for c in left.columns}
    names = {}
    for old in right.columns:
        new = old
        while new.lower() in taken:
            new += suffix
        taken.add(new.lower())
        names[old] = new
    return names


def equi_join(
    left: DataFrame,
    right: DataFrame,
    on: Pairs,
    how: str = "inner",
    *,
    suffix: str = "_r",
    case_sensitive: bool = True,
    both_large: bool = False,
) -> DataFrame:
    """Join on one or more equalities, given as names or (left, right) pairs.

    All columns of both sides stay; a right column whose name is taken gets ``suffix``. Spark picks
    the strategy by size, and AQE splits the partition of a hot key. ``both_large`` asks for a merge
    join, for sides that both grow with the data: the size check sees compressed files, and takes
    the product of sizes for a joined side, so it may choose to broadcast the wrong one.
    ``case_sensitive=False`` compares text keys in lower case.
    """
    names = _right_names(left, right, suffix)
    renamed = right.select([named(old).alias(new) for old, new in names.items()])
    if both_large:
        renamed = renamed.hint("merge")
    return left.join(renamed, _condition(left, _pairs(on), names, case_sensitive), how)


def _condition(left: DataFrame, pairs: list[tuple[str, str]], names: dict[str, str], case_sensitive: bool) -> Column:
    def side(name: str, text: bool) -> Column:
        return F.lower(named(name)) if text and not case_sensitive else named(name)

    types = dict(left.dtypes)
    parts = []
    for l_key, r_key in pairs:
        text = types[l_key] == "string"
        parts.append(side(l_key, text) == side(names[r_key], text))
    return reduce(and_, parts)


def hot_keys(df: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """Keys that hold more than ``share`` of the rows: fewer than 1 / share of them, whatever the data.

    The list is written once, as both sides of a join read it.
    """
    spark = df.sparkSession
    if not 0.0001 <= share <= 1:
        raise ValueError("share must be between 0.0001 and 1, as 1 / share keys may be broadcast")
    path = scratch_path(spark, "key-counts")
    df.groupBy(*[named(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n")).write.parquet(path)
    counts = spark.read.parquet(path)
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return counts.filter(F.col("_n") > F.lit(share * total)).drop("_n")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Pairs,
    how: str = "inner",
    *,
    suffix: str = "_r",
    share: float = 0.01,
    copies: int = 64,
) -> DataFrame:
    """``equi_join`` for a left side with known hot keys, where AQE's split does not apply.

    Rows of a hot key are spread over ``copies`` salts in turn, equal rows too, and the right rows of
    that key are repeated for each salt. All other keys have one salt. Rows without a key, which
    have no partner, are spread as well. The list of hot keys has fewer than 1 / share rows, so
    broadcasting it is safe.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins can repeat the right side")
    pairs = _pairs(on)
    left_keys = [l for l, _ in pairs]
    right_keys = [r for _, r in pairs]
    hot = hot_keys(left, left_keys, share)
    hot = hot.select([named(k).alias(f"_h{i}") for i, k in enumerate(left_keys)])

    def mark(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        same = reduce(and_, [named(k) == F.col(f"_h{i}") for i, k in enumerate(keys)])
        marked = df.join(F.broadcast(hot), same, "left")
        return marked.select(*[named(c) for c in df.columns], F.col("_h0").isNotNull().alias("_hot"))

    salt = F.pmod(F.monotonically_increasing_id(), F.lit(copies)).cast("int")
    spread = F.col("_hot") | reduce(or_, [named(k).isNull() for k in left_keys])
    salted = mark(left, left_keys).withColumn("_salt", F.when(spread, salt).otherwise(0)).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))
    repeated = mark(right, right_keys).withColumn("_salt", F.explode(salts)).drop("_hot")
    joined = equi_join(salted, repeated, [*pairs, "_salt"], how, suffix=suffix)
    return joined.drop("_salt", "_salt" + suffix)


def pair_documents(left: DataFrame, right: DataFrame, key: Pairs, flag: str = "had_existing", suffix: str = "_r") -> DataFrame:
    """All left rows with their partner, and a flag that says whether there is one."""
    marked = right.withColumn(flag, F.lit(True))
    joined = equi_join(left, marked, key, "left", suffix=suffix)
    return joined.withColumn(flag, F.coalesce(named(flag), F.lit(False)))


def pair_by_stem(left: DataFrame, right: DataFrame, name: str = "stem") -> DataFrame:
    """``pair_documents`` on the normalised file name."""
    l = left.withColumn(name, stem_key(named(name)))
    r = right.withColumn(name, stem_key(named(name)))
    return pair_documents(l, r, name)
