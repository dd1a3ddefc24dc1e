"""Catalog tables, SQL text, JDBC sources and sinks, parquet tables of a folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from rillway.sources.fields import named


def read_folder_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_table(spark: SparkSession, name: str, cols: Sequence[str] | None = None) -> DataFrame:
    """A catalog table or view, with the listed columns only."""
    table = spark.table(name)
    return table.select([named(c) for c in cols]) if cols else table


def query_with_params(spark: SparkSession, sql: str, **params) -> DataFrame:
    """SQL text with ``:name`` parameters, bound as typed literals."""
    return spark.sql(sql, args=params)


def jdbc_query_options(
    url: str,
    query: str,
    *,
    limit: int = 0,
    fetch_size: int = 10_000,
    partition_column: str | None = None,
    lower: int | str | None = None,
    upper: int | str | None = None,
    partitions: int | None = None,
    properties: dict[str, str] | None = None,
) -> dict[str, str]:
    """Reader options for a SQL query that the database runs.

    A whole result is read in partitions of ``partition_column``, over as many connections. Only a
    limited one may come through a single connection; the limit is then part of the query, so the
    database makes no more rows. ``limit`` 0 means no limit.
    """
    options = {"url": url, "fetchsize": str(fetch_size), **(properties or {})}
    if partition_column is None:
        if not limit:
            raise ValueError("a result without limit needs a partition column")
        options["query"] = f"SELECT * FROM ({query}) src FETCH FIRST {int(limit)} ROWS ONLY"
        return options
    if limit:
        raise ValueError("a limited query cannot be read in partitions")
    if lower is None or upper is None or not partitions:
        raise ValueError("partitioned reading needs lower, upper and partitions")
    return {
        **options,
        "dbtable": f"({query}) src",
        "partitionColumn": partition_column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def read_query(spark: SparkSession, url: str, query: str, *, limit: int = 0, **options) -> DataFrame:
    """Rows of a SQL query over JDBC; see ``jdbc_query_options``."""
    return spark.read.format("jdbc").options(**jdbc_query_options(url, query, limit=limit, **options)).load()


def jdbc_table_options(
    url: str,
    table: str,
    *,
    batch_size: int = 1000,
    truncate: bool = False,
    properties: dict[str, str] | None = None,
) -> dict[str, str]:
    return {
        "url": url,
        "dbtable": table,
        "batchsize": str(batch_size),
        "truncate": str(truncate).lower(),
        **(properties or {}),
    }


def write_table(df: DataFrame, url: str, table: str, *, mode: str = "append", truncate: bool = False, **options) -> None:
    """Batched JDBC sink. Appends; with ``truncate`` it empties the table first and keeps its layout."""
    chosen = jdbc_table_options(url, table, truncate=truncate, **options)
    df.write.format("jdbc").mode("overwrite" if truncate else mode).options(**chosen).save()
