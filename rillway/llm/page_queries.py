"""Queries of the operators on web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm import oracles
from rillway.llm.registry import query
from rillway.llm.url_lists import host_of, judge_captures
from rillway.llm.warc import read_records, record_uri, write_archives
from rillway.session import scratch_path
from rillway.sources.tables import read_folder_table as table

YEAR_START = 1704067200  # 2024-01-01 UTC

URL_SQL = r"""
WITH p AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_minutes(page_id * 7919 % 527040) AS fetched,
    nullif(lower(rtrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '.')), '') AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path
  FROM pages),
e AS (
  SELECT 'hosts' AS list, host AS key, DATE '2024-01-01' + (page_id * 104729 % 366)::INT AS day, page_id % 5 = 0 AS listed FROM p WHERE host IS NOT NULL
  UNION ALL
  SELECT 'sections', host || '/' || split_part(path, '/', 2), DATE '2024-01-01' + (page_id * 15485863 % 366)::INT, page_id % 2 = 0
  FROM p WHERE host IS NOT NULL AND split_part(path, '/', 2) <> ''),
daily AS (SELECT list, lower(key) AS key, day, bool_or(listed) AS listed FROM e GROUP BY ALL),
changes AS (SELECT * FROM (SELECT *, lag(listed, 1, false) OVER (PARTITION BY list, key ORDER BY day) AS before FROM daily) WHERE listed <> before),
spans AS (SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY list, key ORDER BY day) AS until FROM changes) WHERE listed),
l AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p WHERE host IS NOT NULL),
k AS (
  SELECT page_id, fetched, unnest(list_distinct(list_concat(
    CASE WHEN len(labels) >= 2 THEN list_transform(range(1, len(labels)), lambda i: array_to_string(labels[i:], '.')) ELSE [host] END,
    list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[1:i], '/'))))) AS key
  FROM l),
f AS (
  SELECT page_id, list_sort(list(DISTINCT list)) AS lists, list_sort(list(DISTINCT s.key)) AS keys
  FROM k JOIN spans s ON k.key = s.key AND s.day <= k.fetched::DATE AND (s.until IS NULL OR k.fetched::DATE < s.until)
  GROUP BY page_id)
SELECT p.page_id, strftime(p.fetched, '%Y-%m-%d %H:%M:%S') AS fetched, p.host, f.lists IS NOT NULL AS blocked,
  coalesce(array_to_string(f.lists, ','), '') AS lists, coalesce(array_to_string(f.keys, ','), '') AS keys
FROM p LEFT JOIN f USING (page_id)
"""


@query(URL_SQL)
def op3_dated_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages fetched over one year, against two lists of which every page gives a dated entry each."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = lambda step: F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * step % 366).cast("int"))
    host = host_of(F.col("url"))
    section = F.get(F.split(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/"), F.lit(1))
    hosts = pages.select(F.lit("hosts").alias("list"), host.alias("key"), day(104729).alias("day"), (F.col("page_id") % 5 == 0).alias("listed"))
    sections = pages.filter(section != "").select(
        F.lit("sections").alias("list"), F.concat(host, F.lit("/"), section).alias("key"), day(15485863).alias("day"), (F.col("page_id") % 2 == 0).alias("listed")
    )
    captures = pages.withColumn("fetched", F.timestamp_seconds(F.lit(YEAR_START) + F.col("page_id") * 7919 % 527040 * 60))
    judged = judge_captures(captures, hosts.unionByName(sections))
    return judged.select(
        "page_id", F.date_format("fetched", "yyyy-MM-dd HH:mm:ss").alias("fetched"), "host", "blocked",
        F.array_join("lists", ",").alias("lists"), F.array_join("keys", ",").alias("keys"),
    )


@query(oracles.ARCHIVES)
def op7_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    rows = read_records(archives)
    prefix, end = record_uri(None)[:-1], record_uri(None)[-1]
    number = lambda c: F.rtrim(F.replace(F.col(c), F.lit(prefix), F.lit("")), F.lit(end)).try_cast("long")
    return rows.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "intact"
    )
