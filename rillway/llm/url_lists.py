"""URL filtering against dated lists: validity intervals and an as-of join, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillway.sources.fields import named


def host_of(url: Column) -> Column:
    """The host of a web address in lower case, without user, port and final dot; null without one."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.lower(F.rtrim(host, F.lit("."))), F.lit(""))


def path_of(url: Column) -> Column:
    """The path of a web address without query, fragment and final slash; empty for the root."""
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/+$", "")


def list_keys(url: Column) -> Column:
    """What an entry may name to cover a url: the host, its parent domains, and the host with each leading path.

    A domain of one label is none. Keys grow with the labels and path segments of one url.
    """
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    paths = F.when(
        F.size(parts) > 0,
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))),
    )
    none = F.array().cast("array<string>")
    return F.array_distinct(F.when(host.isNull(), none).otherwise(F.concat(F.coalesce(domains, F.array(host)), F.coalesce(paths, none))))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, key, valid_from, valid_to) from dated entries (list, key, day, listed).

    An entry lists a key from its day on, or takes it off. Entries of one day for one key count as
    one, and listing wins. valid_to is the day of the next removal, null if there is none; adjacent
    listed days are one interval. Entries are first reduced to a row per list, key and day, so the
    window over a key has as many rows as the calendar has days at most, whatever the entries.
    Entries with a null list, key or day are left out; a null ``listed`` counts as a removal.
    """
    daily = (
        entries.select("list", F.lower("key").alias("key"), F.col("day").cast("date").alias("day"), F.coalesce("listed", F.lit(False)).alias("listed"))
        .dropna(subset=["list", "key", "day"])
        .groupBy("list", "key", "day").agg(F.max("listed").alias("listed"))
    )
    by_key = Window.partitionBy("list", "key").orderBy("day")
    changes = daily.withColumn("before", F.lag("listed", 1, False).over(by_key)).filter("listed <> before")
    spans = changes.withColumn("valid_to", F.lead("day").over(by_key)).filter("listed")
    return spans.select("list", "key", F.col("day").alias("valid_from"), "valid_to")


def judge_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """(id, fetched, host, blocked, lists, keys) for every row of ``captures``.

    A capture is blocked if, when it was fetched, an entry was valid for its host, a parent domain,
    or its host with a leading path. ``lists`` and ``keys`` are the lists and keys that cover it,
    sorted, and empty if none does.

    Captures and intervals meet on the key and on the month, in an equi join with the as-of
    condition valid_from <= fetched day < valid_to; an interval has one row per month up to the last
    captured one. So a host of a third of all captures meets the few intervals of one month, and AQE splits
    such a host. The same urls and days are reduced to one before the join.

    A null or malformed url has no host and is not blocked; nor is a capture without a time. Rows
    that repeat an id are each judged. Empty captures give no rows; an empty list blocks nothing.
    Other columns are neither read nor returned.
    """
    rows = captures.select(named(id_col).alias("id"), named(url_col).cast("string").alias("url"), named(time_col).alias("at"))
    rows = rows.withColumn("day", F.to_date("at"))
    keys = (
        rows.select("url", "day").dropna().distinct()
        .select("url", "day", F.trunc("day", "month").alias("month"), F.explode(list_keys(F.col("url"))).alias("key"))
    )
    spans = validity_intervals(entries)
    # One value: the last day that any capture asks for.
    newest = F.lit(rows.agg(F.max("day")).first()[0]).cast("date")
    months = F.sequence(F.trunc("valid_from", "month"), F.trunc(F.least("valid_to", newest), "month"), F.expr("interval 1 month"))
    monthly = (
        spans.filter(F.col("valid_from") <= newest)
        .select("list", "key", "valid_from", "valid_to", F.explode(months).alias("month"))
    )
    active = keys.join(monthly, ["key", "month"]).filter("valid_from <= day AND (valid_to IS NULL OR day < valid_to)")
    found = active.groupBy("url", "day").agg(F.sort_array(F.collect_set("list")).alias("lists"), F.sort_array(F.collect_set("key")).alias("keys"))
    none = F.array().cast("array<string>")
    return rows.join(found, ["url", "day"], "left").select(
        F.col("id").alias(id_col),
        F.col("at").alias(time_col),
        host_of(F.col("url")).alias("host"),
        F.col("lists").isNotNull().alias("blocked"),
        F.coalesce("lists", none).alias("lists"),
        F.coalesce("keys", none).alias("keys"),
    )
