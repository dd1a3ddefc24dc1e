"""Queries of the string and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.functions.text import (
    StringOp, concat_as_text, count_lines, escape_markup, lines_of, piece, safe_name, stem_key, string_ops, unescape_markup,
)
from rillway.operators.cleaning import Rule, apply_rules
from rillway.operators.code_text import code_lines, extract_code
from rillway.operators.line_diff import line_diff
from rillway.operators.line_sets import line_multiset_diff
from rillway.operators.quality import json_summary
from rillway.operators.spec_documents import tag_names
from rillway.operators.token_text import corpus_blocks, pad_tokens, token_blocks, tokens_of
from rillway.plans.line_diff_sql import diff_sql, without_last_blank
from rillway.plans.registry import query, table
from rillway.sources.fields import named


@query(
    """
    SELECT p_partkey, lower(p_brand) AS p_brand, upper(p_name) AS upper_name, p_name,
           trim('  ' || p_type || ' ') AS p_type, substr(p_name, 2, 3) AS middle
    FROM part
    """
)
def q_string_ops(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(
        "p_partkey", "p_brand", "p_name", F.concat(F.lit("  "), "p_type", F.lit(" ")).alias("p_type")
    )
    changed = string_ops(
        part,
        {
            "p_brand": StringOp(case="lower"),
            "p_name": StringOp(case="upper", out="upper_name"),
            "p_type": StringOp(trim="both"),
        },
    )
    return changed.withColumn("middle", F.substring("p_name", 2, 3))


@query(
    """
    SELECT p_partkey, CASE WHEN length(p_name) < 10 THEN lpad(p_name, 10, '*') ELSE p_name END AS left_padded,
           CASE WHEN length(p_name) < 10 THEN rpad(p_name, 10, '.') ELSE p_name END AS right_padded
    FROM part
    """
)
def q_string_pad(spark: SparkSession, d: str) -> DataFrame:
    ops = {"p_name": StringOp(pad=("left", "*", 10), out="left_padded")}
    padded = string_ops(table(spark, d, "part").select("p_partkey", "p_name"), ops)
    return string_ops(padded, {"p_name": StringOp(pad=("right", ".", 10), out="right_padded")}).drop("p_name")


@query(
    """
    SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '),
           lambda w: upper(w[1]) || w[2:]), ' ') AS p_name
    FROM part
    """
)
def q_string_initcap(spark: SparkSession, d: str) -> DataFrame:
    return string_ops(table(spark, d, "part").select("p_partkey", "p_name"), {"p_name": StringOp(init_cap=True)})


@query(
    """
    SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits,
           regexp_replace(c_name, '[0-9]', '', 'g') AS letters, replace(t.p, ' ', '') AS no_space
    FROM customer, LATERAL (SELECT c_mktsegment || ' ' || c_name AS p) t
    """
)
def q_string_digits(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer").select(
        "c_custkey", "c_name", F.concat("c_mktsegment", F.lit(" "), "c_name").alias("no_space")
    )
    only = string_ops(customer, {"c_name": StringOp(digits="only", out="digits")})
    rest = string_ops(only, {"c_name": StringOp(digits="remove", out="letters"), "no_space": StringOp(remove="space")})
    return rest.drop("c_name")


_ESCAPED = "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@query(f"SELECT page_id, md5({_ESCAPED}) AS escaped, md5(html) AS back FROM pages")
def q_string_mask(spark: SparkSession, d: str) -> DataFrame:
    escaped = escape_markup(F.col("html"))
    return table(spark, d, "pages").select(
        "page_id", F.md5(escaped).alias("escaped"), F.md5(unescape_markup(escaped)).alias("back")
    )


@query("SELECT c_custkey, CAST(c_custkey AS VARCHAR) || CAST(c_nationkey AS VARCHAR) AS joined FROM customer")
def q_concat_cast(spark: SparkSession, d: str) -> DataFrame:
    joined = concat_as_text(F.col("c_custkey"), F.col("c_nationkey")).alias("joined")
    return table(spark, d, "customer").select("c_custkey", joined)


@query(
    """
    SELECT p_partkey, string_split(replace(p_name, ' ', ','), ',')[2] AS second,
           string_split(replace(p_name, ' ', ','), ',')[3] AS third,
           CAST(len(string_split(replace(p_name, ' ', ','), ',')) AS BIGINT) AS n_pieces
    FROM part
    """
)
def q_split_get(spark: SparkSession, d: str) -> DataFrame:
    listed = F.replace("p_name", F.lit(" "), F.lit(","))
    return table(spark, d, "part").select(
        "p_partkey",
        piece(listed, ",", 1).alias("second"),
        piece(listed, ",", 2).alias("third"),
        F.size(F.split(listed, ",")).cast("long").alias("n_pieces"),
    )


MARK_RULES = (
    Rule("drop hashes", "###", ""),
    Rule("one percent", "%+", "%", regex=True),
    Rule("drop stars", "***", ""),
)


@query(
    r"""
    WITH a AS (SELECT doc_id, text, replace(text, '###', '') AS t1 FROM documents),
         b AS (SELECT *, regexp_replace(t1, '%+', '%', 'g') AS t2 FROM a),
         c AS (SELECT *, replace(t2, '***', '') AS t3 FROM b)
    SELECT doc_id, md5(t3) AS corrected,
           CASE WHEN t3 = text THEN 'NO_CHANGE' ELSE concat_ws('|',
             CASE WHEN t1 <> text THEN 'drop hashes' END, CASE WHEN t2 <> t1 THEN 'one percent' END,
             CASE WHEN t3 <> t2 THEN 'drop stars' END) END AS rules
    FROM c
    """
)
def q_rule_clean(spark: SparkSession, d: str) -> DataFrame:
    cleaned = apply_rules(table(spark, d, "documents").select("doc_id", "text"), "text", MARK_RULES)
    return cleaned.select("doc_id", F.md5("corrected").alias("corrected"), F.array_join("rules", "|").alias("rules"))


@query("SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g') AS name FROM pages")
def q_safe_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", safe_name(F.col("url")).alias("name"))


@query("SELECT page_id, lower(regexp_replace(url, '[^a-zA-Z0-9]', '_', 'g')) AS stem FROM pages")
def q_stem_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", stem_key(F.concat("url", F.lit("_converted"))).alias("stem"))


@query(
    """
    SELECT doc_id, CAST(len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END
           AS BIGINT) AS n_lines
    FROM documents
    """
)
def q_line_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", count_lines(F.col("text")).cast("long").alias("n_lines"))


_TAGS = "regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)"


@query(
    f"""
    SELECT page_id, array_to_string(list_sort(list_distinct({_TAGS})), ' ') AS tags,
           CAST(len(list_distinct({_TAGS})) AS BIGINT) AS n_tags
    FROM pages
    """
)
def q_tag_sets(spark: SparkSession, d: str) -> DataFrame:
    tags = F.array_sort(F.array_distinct(tag_names(F.col("html"))))
    pages = table(spark, d, "pages").select("page_id", tags.alias("tags"))
    return pages.select("page_id", F.array_join("tags", " ").alias("tags"), F.size("tags").cast("long").alias("n_tags"))


@query(
    f"""
    WITH t AS (SELECT page_id, unnest({_TAGS}) AS tag, generate_subscripts({_TAGS}, 1) AS pos FROM pages),
         f AS (SELECT page_id, tag, min(pos) AS pos FROM t GROUP BY 1, 2)
    SELECT page_id, string_agg(tag, ' ' ORDER BY pos) AS in_order, string_agg(tag, ' ' ORDER BY tag) AS sorted
    FROM f GROUP BY page_id
    """
)
def q_array_distinct(spark: SparkSession, d: str) -> DataFrame:
    tags = F.array_distinct(tag_names(F.col("html")))
    return table(spark, d, "pages").select(
        "page_id", F.array_join(tags, " ").alias("in_order"), F.array_join(F.sort_array(tags), " ").alias("sorted")
    )


@query(
    f"""
    SELECT page_id, '{{' || chr(10) || '  "tags": [' || chr(10) ||
           array_to_string(list_transform(list_sort(list_distinct({_TAGS})), lambda x: '    "' || x || '"'), ',' || chr(10))
           || chr(10) || '  ],' || chr(10) || '  "none": []' || chr(10) || '}}' AS summary
    FROM pages
    """
)
def q_json_summary(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "pages").select(
        "page_id",
        F.array_sort(F.array_distinct(tag_names(F.col("html")))).alias("tags"),
        F.array().cast("array<string>").alias("none"),
    )
    return sets.select("page_id", json_summary(("tags", "none")).alias("summary"))


_PIECES = "string_split({0}, '>')"
_NET_SQL = f"""
    WITH l AS (
      SELECT page_id, unnest({_PIECES.format("html")}) AS line, -1 AS sign FROM pages
      UNION ALL
      SELECT page_id, unnest({_PIECES.format("replace(html, '###', '')")}), 1 FROM pages),
    n AS (SELECT page_id, line, sum(sign) AS net FROM l GROUP BY 1, 2)
    SELECT page_id, CASE WHEN net > 0 THEN 'DIFF_INSERT' ELSE 'DIFF_DELETE' END AS rule, line,
           CAST(abs(net) AS BIGINT) AS copies
    FROM n WHERE net <> 0
"""


def _page_versions(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", F.replace("html", F.lit(">"), F.lit("\x0b")).alias("before"))
    return pages.withColumn("after", F.replace("before", F.lit("###"), F.lit("")))


@query(_NET_SQL)
def q_line_except(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of a page that a clean-up rule removed or made, as a multiset."""
    pieces = {c: F.split(named(c), "\x0b") for c in ("before", "after")}
    return line_multiset_diff(_page_versions(spark, d), "page_id", pieces["before"], pieces["after"])


# Pages have line ends of their own besides those put in place of '>'. Every 11th line is put at the end.
_EDITED_SQL = f"""
    SELECT page_id AS k, b, {without_last_blank("p")} AS a FROM (
      SELECT page_id, b, list_concat(list_transform(list_filter(b, lambda x, n: n % 11 <> 6), lambda x: replace(x, '###', '')),
                                     list_filter(b, lambda x, n: n % 11 = 6)) AS p
      FROM (SELECT page_id, {without_last_blank("p")} AS b FROM (
        SELECT page_id, string_split_regex(html, '>|\\r\\n|\\n|\\r') AS p FROM pages)))
"""


@query(f"SELECT k AS page_id, * EXCLUDE (k) FROM ({diff_sql(_EDITED_SQL)})")
def q_line_diff(spark: SparkSession, d: str) -> DataFrame:
    """Hunks with deleted and inserted lines of pages that lost marks and of which lines moved."""
    lines = _page_versions(spark, d).select("page_id", "before", lines_of(F.col("before")).alias("lines"))
    stay = F.transform(F.filter("lines", lambda x, k: k % 11 != 5), lambda x: F.replace(x, F.lit("###"), F.lit("")))
    moved = F.filter("lines", lambda x, k: k % 11 == 5)
    edited = lines.select("page_id", "before", F.array_join(F.concat(stay, moved), "\n").alias("after"))
    rows = line_diff(edited, "page_id", "before", "after")
    line = F.when(F.col("rule") == "DIFF_DELETE", F.col("before")).otherwise(F.col("after"))
    return rows.select("page_id", "seq", "hunk", "pos", "rule", line.alias("line"))


@query(
    """
    SELECT conv_id, turn, trim('import os' || chr(10) || text || chr(10) || '  df = 1', ' ' || chr(10)) AS code
    FROM conversations
    """
)
def q_code_extract(spark: SparkSession, d: str) -> DataFrame:
    """A turn put in a fence, with prose and code lines around it."""
    wrapped = F.concat(
        F.lit("intro\nimport os\n  ```py\n"), F.col("text"), F.lit("\n```\nthe end\n  df = 1\nand more")
    )
    return table(spark, d, "conversations").select("conv_id", "turn", extract_code(wrapped).alias("code"))


_TOKENS = r"string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')"


@query(
    f"""
    WITH t AS (SELECT doc_id, {_TOKENS} AS tokens FROM documents),
         b AS (SELECT doc_id, tokens, unnest(range((len(tokens) - 1) // 128 + 1)) AS block FROM t),
         c AS (SELECT doc_id, block, tokens[block * 128 + 1 : block * 128 + 128] AS part FROM b)
    SELECT doc_id, CAST(block AS INTEGER) AS block, CAST(len(part) AS INTEGER) AS n_tokens,
           len(part) = 128 AS complete, array_to_string(part, ' ') AS text
    FROM c
    """
)
def q_token_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = token_blocks(table(spark, d, "documents"), "doc_id", "text")
    return blocks.select("doc_id", "block", "n_tokens", "complete", F.array_join("tokens", " ").alias("text"))


@query(
    f"""
    WITH t AS (SELECT doc_id, {_TOKENS} AS tokens FROM documents),
         u AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM t),
         n AS (SELECT token, row_number() OVER (ORDER BY doc_id, pos) - 1 AS place FROM u WHERE token <> '')
    SELECT place // 128 AS block, CAST(count(*) AS INTEGER) AS n_tokens, count(*) = 128 AS complete,
           string_agg(token, ' ' ORDER BY place) AS text
    FROM n GROUP BY 1
    """
)
def q_corpus_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of 128 tokens that go on from one document to the next."""
    blocks = corpus_blocks(table(spark, d, "documents"), "doc_id", "text")
    return blocks.select("block", "n_tokens", "complete", F.array_join("tokens", " ").alias("text"))


# Every 7th turn opens or closes a fence, every 5th looks like code.
@query(
    """
    WITH l AS (
      SELECT conv_id % 3 AS document, conv_id * 1000 + turn AS position,
             CASE WHEN (conv_id * 31 + turn) % 7 = 0 THEN '  ```py' WHEN (conv_id + turn) % 5 = 0 THEN 'import ' || role ELSE text END AS line
      FROM conversations),
    f AS (SELECT *, sum(CASE WHEN line LIKE '  ```%' THEN 1 ELSE 0 END) OVER (PARTITION BY document ORDER BY position) AS fences FROM l)
    SELECT document, position, line FROM f
    WHERE line NOT LIKE '  ```%' AND (fences % 2 = 1 OR regexp_matches(line, '^\\s*(from |import |df|spark|withColumn|filter|join|select|col\\()'))
    """
)
def q_code_lines(spark: SparkSession, d: str) -> DataFrame:
    """Code lines of three documents that come as rows, a third of the table each."""
    fence, code = (F.col("conv_id") * 31 + F.col("turn")) % 7 == 0, (F.col("conv_id") + F.col("turn")) % 5 == 0
    line = F.when(fence, "  ```py").when(code, F.concat(F.lit("import "), "role")).otherwise(F.col("text"))
    lines = table(spark, d, "conversations").select(
        (F.col("conv_id") % 3).alias("document"), (F.col("conv_id") * 1000 + F.col("turn")).alias("position"), line.alias("line")
    )
    return code_lines(lines, "document", "position", "line")


@query(
    f"""
    SELECT doc_id, array_to_string(list_resize({_TOKENS}, 128, '<pad>'), ' ') AS tokens FROM documents
    """
)
def q_token_pad(spark: SparkSession, d: str) -> DataFrame:
    padded = pad_tokens(tokens_of(F.col("text")), filler="<pad>")
    return table(spark, d, "documents").select("doc_id", F.array_join(padded, " ").alias("tokens"))
