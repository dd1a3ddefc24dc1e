"""Sorting and distributed ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillway.session import scratch_path
from rillway.sources.fields import named

# monotonically_increasing_id keeps the row position within a partition in its lower 33 bits.
_POSITION_MASK = (1 << 33) - 1

SortKey = str | tuple[str, str] | Column


def sort_key(key: SortKey, case_sensitive: bool, text: bool) -> Column:
    if isinstance(key, Column):
        return key
    name, direction = (key, "asc") if isinstance(key, str) else key
    c = named(name)
    if text and not case_sensitive:
        c = F.lower(c)
    return c.desc() if direction == "desc" else c.asc()


def sort_keys(df: DataFrame, keys: Sequence[SortKey], case_sensitive: bool) -> list[Column]:
    types = dict(df.dtypes)
    names = [k if isinstance(k, str) else k[0] if isinstance(k, tuple) else None for k in keys]
    return [
        sort_key(key, case_sensitive, text=name is not None and types[name] == "string")
        for key, name in zip(keys, names)
    ]


def sort_rows(df: DataFrame, keys: Sequence[SortKey], case_sensitive: bool = True) -> DataFrame:
    """Total order. ``case_sensitive=False`` compares text keys in lower case."""
    return df.orderBy(*sort_keys(df, keys, case_sensitive))


def rank_rows(
    df: DataFrame,
    keys: Sequence[SortKey],
    *,
    within: Sequence[str] = (),
    case_sensitive: bool = True,
    out: str = "rn",
    count_out: str | None = None,
) -> DataFrame:
    """Number the rows in order, from 1, over all rows or within groups; end ``keys`` in a unique one.

    A window over the whole table, or over a hot group, would send all of its rows to one task.
    Here the rows are range-partitioned on groups and keys, so that a large group is spread over
    many partitions, and numbered by partition. ``count_out`` also adds the size of the group.
    """
    return _numbered(_in_ranges(df, keys, within, case_sensitive), within, out, count_out)


def _in_ranges(df: DataFrame, keys: Sequence[SortKey], within: Sequence[str], case_sensitive: bool) -> DataFrame:
    order = [named(c).asc() for c in within] + sort_keys(df, keys, case_sensitive)
    # Ranges may cut through rows with equal keys, by their hash and place, so no key is a hot range.
    ties = df.withColumn("_tie", F.struct(row_hash(df), _position()))
    cut = [*order, F.col("_tie").asc()]
    return ties.repartitionByRange(*cut).sortWithinPartitions(*cut).drop("_tie")


def running_totals(
    df: DataFrame,
    keys: Sequence[SortKey],
    totals: dict[str, Column],
    *,
    within: Sequence[str] = (),
    case_sensitive: bool = True,
) -> DataFrame:
    """Sums of each row and all before it, over all rows or within groups; end ``keys`` in a unique one.

    ``totals`` gives the summed value by output name; nulls add nothing. A window over the table, or over a hot
    group, would send all of its rows to one task. Here groups and keys are cut into ranges, as in ``rank_rows``;
    each range is summed up by itself, and what lies before it comes from one row per group and range.
    """
    numbers = {out: f"_v{i}" for i, out in enumerate(totals)}
    valued = df.withColumns({numbers[out]: F.coalesce(value, F.lit(0)) for out, value in totals.items()})
    path = scratch_path(df.sparkSession, "running")
    ranged = _in_ranges(valued, keys, within, case_sensitive)
    ranged.withColumn("_part", F.spark_partition_id()).withColumn("_pos", _position()).write.parquet(path)
    placed = df.sparkSession.read.parquet(path)
    group = [named(c) for c in within]
    so_far = Window.partitionBy(*group, "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({f"_s{v}": F.sum(v).over(so_far) for v in numbers.values()})
    pieces = placed.groupBy(*group, "_part").agg(*[F.sum(v).alias(v) for v in numbers.values()])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        *[c.alias(f"_g{i}") for i, c in enumerate(group)],
        F.col("_part").alias("_opart"),
        *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_o{v}") for v in numbers.values()],
    )
    match = summed["_part"] == offsets["_opart"]
    for i, c in enumerate(group):
        match = match & c.eqNullSafe(F.col(f"_g{i}"))
    # Without groups there is one row per partition, a number set by configuration and not by data.
    joined = summed.join(offsets if within else F.broadcast(offsets), match)
    return joined.select(
        *[named(c) for c in df.columns], *[(F.col(f"_s{v}") + F.col(f"_o{v}")).alias(out) for out, v in numbers.items()]
    )


def _numbered(df: DataFrame, within: Sequence[str], out: str, count_out: str | None = None) -> DataFrame:
    """Number rows as they lie, partition after partition; groups must lie together.

    The rows are written once with their partition and position: range bounds come from a sample
    and must not be drawn anew between the two reads. A row's number is its position, plus the size
    of the group in the partitions before, taken from one summary row per group and partition.
    """
    path = scratch_path(df.sparkSession, "numbered")
    df.withColumn("_part", F.spark_partition_id()).withColumn("_pos", _position()).write.parquet(path)
    placed = df.sparkSession.read.parquet(path)
    group = [named(c) for c in within]
    pieces = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = [F.sum("_n").over(Window.partitionBy(*group)).alias("_total")] if count_out else []
    offsets = pieces.select(
        *[named(c).alias(f"_g{i}") for i, c in enumerate(within)],
        F.col("_part").alias("_opart"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        *totals,
    )
    match = placed["_part"] == offsets["_opart"]
    for i, c in enumerate(within):
        match = match & named(c).eqNullSafe(F.col(f"_g{i}"))
    # Without groups there is one row per partition, a number set by configuration and not by data.
    joined = placed.join(offsets if within else F.broadcast(offsets), match)
    added = [(F.col("_pos") + F.col("_shift") + 1).alias(out)]
    if count_out:
        added.append(F.col("_total").alias(count_out))
    return joined.select(*[named(c) for c in df.columns], *added)


def _position() -> Column:
    return F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK))


def take_rows(df: DataFrame, limit: int = 0) -> DataFrame:
    """At most ``limit`` rows; 0 means all.

    Each task passes on that many of its rows, which are numbered over tasks; none pass through one
    task, whatever the limit.
    """
    if not limit:
        return df
    first = df.withColumn("_at", _position()).filter(F.col("_at") < limit).drop("_at")
    return _numbered(first, (), "_rn").filter(F.col("_rn") <= limit).drop("_rn")


def top_rows(df: DataFrame, keys: Sequence[SortKey], n: int, case_sensitive: bool = True) -> DataFrame:
    """The first ``n`` rows in order, for any ``n``; rows with equal keys go by a hash of the row.

    Each task sorts its rows and passes on the first n; those are ranked over all tasks.
    """
    tie = row_hash(df)
    order = [*sort_keys(df, keys, case_sensitive), tie.asc()]
    first = df.sortWithinPartitions(*order).withColumn("_at", _position()).filter(F.col("_at") < n).drop("_at")
    ranked = rank_rows(first, [*keys, tie.asc()], case_sensitive=case_sensitive, out="_rn")
    return ranked.filter(F.col("_rn") <= n).orderBy("_rn").drop("_rn")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns but maps, which have no order of their own."""
    return F.xxhash64(*[named(f.name) for f in df.schema if not isinstance(f.dataType, T.MapType)])


def latest_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key; of equal ones that with the greatest hash of the row.

    An aggregate over key, order and hash only, met again by its rows: long texts are in no sort of a group. Columns
    may be of any type.
    """
    keys = [key] if isinstance(key, str) else list(key)
    place = F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(order)], row_hash(df).alias("h"))
    placed = df.withColumn("_row", F.struct(F.struct(*[named(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("k"), place.alias("at")))
    last = placed.groupBy(F.col("_row.k").alias("k")).agg(F.max("_row.at").alias("at")).select(F.struct("k", "at").alias("_row"))
    # Rows that are equal in all but maps share their hash: one of them stays.
    once = Window.partitionBy("_row").orderBy(F.lit(0))
    kept = placed.join(last, "_row").withColumn("_copy", F.row_number().over(once)).filter("_copy = 1")
    return kept.select([named(c) for c in df.columns])
