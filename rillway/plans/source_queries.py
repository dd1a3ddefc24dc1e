"""Queries that pass the driver's tables through each source and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.operators.aggregates import count_rows, group_by
from rillway.operators.joins import equi_join
from rillway.operators.line_sets import union_rows
from rillway.operators.rows import inline_rows, select_fields
from rillway.operators.token_text import next_turn, prompt_dataset
from rillway.plans.registry import query, table
from rillway.session import scratch_path
from rillway.sources.delimited import read_delimited, write_delimited
from rillway.sources.documents import append_jsonl, read_documents, read_text, write_text
from rillway.sources.fields import Field, parse_field
from rillway.sources.tables import query_with_params, read_table
from rillway.streaming.counts import count_files_as_stream

RECORD_END = "\x1e"


@query("SELECT s_suppkey, s_acctbal, s_name || ', \"' || s_suppkey || '\"' AS quoted FROM supplier")
def q_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Separator and quote inside a value; columns are read by name, so one may be left out."""
    quoted = F.concat("s_name", F.lit(', "'), F.col("s_suppkey").cast("string"), F.lit('"'))
    folder = scratch_path(spark, "csv")
    write_delimited(table(spark, d, "supplier").withColumn("quoted", quoted), folder)
    return read_delimited(
        spark, folder, [Field("s_suppkey", "long"), Field("s_acctbal", "double"), Field("quoted", trim="both")]
    )


@query("SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN NULL ELSE lang END AS note, chr(92) || text AS slashed FROM documents")
def q_csv_line_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts with line breaks, quotes and back-slashes, and empty texts beside NULLs."""
    note = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 2, F.col("lang"))
    texts = table(spark, d, "documents").select("doc_id", "text", note.alias("note"), F.concat(F.lit("\\"), "text").alias("slashed"))
    folder = scratch_path(spark, "breaks")
    write_delimited(texts, folder)
    fields = [Field("doc_id", "long"), *[Field(c, trim="none") for c in ("text", "note", "slashed")]]
    return read_delimited(spark, folder, fields, empty_text=True)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 1000000, upper(s_name), -s_acctbal FROM supplier")
def q_csv_mixed_headers(spark: SparkSession, d: str) -> DataFrame:
    """Files of one folder with their columns in different orders."""
    folder = scratch_path(spark, "mixed")
    suppliers = table(spark, d, "supplier")
    write_delimited(suppliers.select("s_suppkey", "s_name", "s_acctbal"), folder)
    other = suppliers.select((-F.col("s_acctbal")).alias("s_acctbal"), (F.col("s_suppkey") + 1000000).alias("s_suppkey"), F.upper("s_name").alias("s_name"))
    write_delimited(other, folder, append=True)
    return read_delimited(spark, folder, [Field("s_suppkey", "long"), Field("s_name", trim="both"), Field("s_acctbal", "double")])


@query("SELECT c_custkey, c_name AS both_sides, c_name || ' ' AS left_side, '  ' || c_name AS right_side FROM customer")
def q_field_trim(spark: SparkSession, d: str) -> DataFrame:
    padded = F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))
    folder = scratch_path(spark, "trim")
    sides = ["both_sides", "left_side", "right_side"]
    write_delimited(table(spark, d, "customer").select("c_custkey", *[padded.alias(s) for s in sides]), folder)
    fields = [
        Field("c_custkey", "long"),
        Field("both_sides", trim="both"),
        Field("left_side", trim="left"),
        Field("right_side", trim="right"),
    ]
    return read_delimited(spark, folder, fields)


@query(
    """
    SELECT c_custkey,
           CAST(c_custkey * 1000 + 234 AS BIGINT) AS grouped_long,
           CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_acctbal AS DOUBLE) END AS amount,
           CASE WHEN c_custkey % 5 = 0 THEN NULL
                ELSE strftime(DATE '2020-01-01' + CAST(c_custkey AS INTEGER), '%Y-%m-%d') END AS a_day,
           CASE c_custkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE NULL END AS flag
    FROM customer
    """
)
def q_parse_masks(spark: SparkSession, d: str) -> DataFrame:
    """Text made from each customer, parsed by mask; some of it does not fit and becomes NULL."""
    key = F.col("c_custkey")
    thousands = F.concat(key.cast("string"), F.lit(",234"))
    amount = F.when(key % 7 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    day = F.date_add(F.lit("2020-01-01").cast("date"), key.cast("int"))
    day_text = F.when(key % 5 == 0, "2020-13-45").otherwise(F.date_format(day, "yyyy-MM-dd"))
    flag = F.when(key % 3 == 0, "true").when(key % 3 == 1, "false").otherwise("Y")
    return table(spark, d, "customer").select(
        "c_custkey",
        parse_field(Field("grouped_long", "long", group=","), thousands).alias("grouped_long"),
        parse_field(Field("amount", "double", group=","), amount).alias("amount"),
        F.date_format(parse_field(Field("a_day", "date", fmt="yyyy-MM-dd"), day_text), "yyyy-MM-dd").alias("a_day"),
        parse_field(Field("flag", "boolean"), flag).cast("string").alias("flag"),
    )


@query("SELECT s_suppkey, s_name FROM supplier")
def q_glob_scan(spark: SparkSession, d: str) -> DataFrame:
    """One folder with files of three kinds: the mask takes two of them, the exclusion drops one again."""
    folder = scratch_path(spark, "glob")
    write_delimited(table(spark, d, "supplier").select("s_suppkey", "s_name"), folder)
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"))
    write_delimited(customer, folder, append=True, extension="txt")
    write_delimited(customer, folder, append=True, extension="tsv")
    fields = [Field("s_suppkey", "long"), Field("s_name")]
    return read_delimited(spark, folder, fields, glob="*.{csv,tsv}", exclude="*.tsv")


@query("SELECT s_suppkey, s_name FROM supplier")
def q_glob_exclude(spark: SparkSession, d: str) -> DataFrame:
    """Excluded files of one folder have another header, without the columns asked for."""
    folder = scratch_path(spark, "exclude")
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_name")
    write_delimited(supplier.filter("s_suppkey % 2 = 0"), folder)
    write_delimited(supplier.filter("s_suppkey % 2 = 1").select("s_name", F.lit(1).alias("extra"), "s_suppkey"), folder, append=True)
    write_delimited(table(spark, d, "nation").select("n_name"), folder, append=True, extension="bak")
    return read_delimited(spark, folder, [Field("s_suppkey", "long"), Field("s_name")], exclude="*.bak")


@query(
    """
    SELECT c_mktsegment || ',' || c_nationkey AS value, CAST(2 * count(*) AS BIGINT) AS n
    FROM customer GROUP BY 1
    """
)
def q_append_twice(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch_path(spark, "append")
    lines = table(spark, d, "customer").select("c_mktsegment", "c_nationkey")
    write_text(lines, folder)
    write_text(lines, folder, append=True)
    return group_by(read_text(spark, folder), "value", [count_rows("n")])


@query("SELECT o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority AS value FROM orders")
def q_text_lines(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch_path(spark, "text")
    write_text(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), folder, sep="|")
    return read_text(spark, folder)


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def q_table_scan_cols(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "supplier").createOrReplaceTempView("rillway_suppliers")
    return read_table(spark, "rillway_suppliers", ["s_suppkey", "s_name", "s_nationkey"])


def _write_packed(pages: DataFrame, folder: str) -> None:
    """Pages as text files of bounded size, each a document of many records."""
    record = F.concat(F.col("page_id").cast("string"), F.lit("\t"), F.col("html")).alias("value")
    (
        pages.select(record)
        .write.option("maxRecordsPerFile", 500)
        .option("lineSep", RECORD_END)
        .mode("append")
        .text(folder)
    )


def _unpack(documents: DataFrame) -> DataFrame:
    records = documents.select(F.explode(F.split("text", RECORD_END)).alias("record")).filter("record <> ''")
    return records.select(
        F.substring_index("record", "\t", 1).cast("long").alias("page_id"),
        F.substring("record", F.instr("record", "\t") + 1, F.char_length("record")).alias("html"),
    )


@query("SELECT page_id, CAST(length(html) AS BIGINT) AS n_chars, md5(html) AS digest FROM pages")
def q_doc_scan(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch_path(spark, "documents")
    _write_packed(table(spark, d, "pages"), folder)
    return _unpack(read_documents(spark, folder, ["txt"])).select(
        "page_id", F.char_length("html").cast("long").alias("n_chars"), F.md5("html").alias("digest")
    )


@query(
    """
    SELECT CAST(page_id AS VARCHAR) AS name, 'page' AS kind, CAST(length(html) AS BIGINT) AS n_chars FROM pages
    UNION ALL
    SELECT CAST(doc_id AS VARCHAR), 'document', CAST(length(text) AS BIGINT) FROM documents
    """
)
def q_doc_union(spark: SparkSession, d: str) -> DataFrame:
    """Files of two extensions in one folder, scanned apart and put together."""
    folder = scratch_path(spark, "two-kinds")
    _write_packed(table(spark, d, "pages"), folder)
    documents = select_fields(table(spark, d, "documents"), {"doc_id": "page_id", "text": "html"})
    documents.write.mode("append").option("maxRecordsPerFile", 500).json(folder)
    pages = _unpack(read_documents(spark, folder, ["txt"]))
    rows = read_documents(spark, folder, ["JSON"]).select(F.explode(F.split("text", "\n")).alias("record"))
    parsed = rows.filter("record <> ''").select(F.from_json("record", "page_id BIGINT, html STRING").alias("r")).select("r.*")
    length = F.char_length("html").cast("long").alias("n_chars")
    name = F.col("page_id").cast("string").alias("name")
    return union_rows(
        pages.select(name, F.lit("page").alias("kind"), length),
        parsed.select(name, F.lit("document").alias("kind"), length),
    )


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'F'")
def q_param_sql(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "orders").createOrReplaceTempView("rillway_orders")
    return query_with_params(
        spark,
        "SELECT o_orderkey, o_totalprice FROM rillway_orders"
        " WHERE o_totalprice > :min_price AND o_orderstatus = :status",
        min_price=400000,
        status="F",
    )


@query(
    """
    SELECT v.label, CAST(count(*) AS BIGINT) AS n
    FROM orders o JOIN (VALUES ('F', 'finished'), ('O', 'open'), ('P', 'partial')) v(status, label)
      ON o.o_orderstatus = v.status
    GROUP BY v.label
    """
)
def q_inline_rows(spark: SparkSession, d: str) -> DataFrame:
    """Literal rows as a lookup for a table."""
    labels = inline_rows(spark, [("F", "finished"), ("O", "open"), ("P", "partial")], "status STRING, label STRING")
    labelled = equi_join(table(spark, d, "orders"), labels, [("o_orderstatus", "status")])
    return group_by(labelled, "label", [count_rows("n")])


TURN_SQL = """
    SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS completion
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant'
"""
_STRIP = r"regexp_replace(lower({0}), '^\s+|\s+$', '', 'g')"


@query(
    f"""
    SELECT prompt, completion, CAST(count(*) AS BIGINT) AS n
    FROM (SELECT {_STRIP.format("prompt")} AS prompt, {_STRIP.format("completion")} AS completion FROM ({TURN_SQL}))
    WHERE prompt <> '' AND completion <> '' GROUP BY ALL
    """
)
def q_prompt_dataset(spark: SparkSession, d: str) -> DataFrame:
    """A user turn with the reply that follows it, appended as JSON lines and read back."""
    turns = next_turn(table(spark, d, "conversations"), "conv_id", "turn", "role", "user", "assistant", "text")
    folder = scratch_path(spark, "prompts")
    append_jsonl(prompt_dataset(turns, "prompt", "completion"), folder)
    rows = spark.read.schema("prompt STRING, completion STRING").json(folder)
    return group_by(rows, ["prompt", "completion"], [count_rows("n")])


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def q_stream_counts(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").select("event_type").schema
    return count_files_as_stream(spark, f"{d.rstrip('/')}/events.parquet", schema, "event_type")
