"""Queries of the document jobs.

Spec documents and programs are made by Spark from the ``part`` table, one of each kind per part,
so that their number grows with the table and their content is known to the SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.functions.text import count_lines, escape_markup
from rillway.operators.cleaning import apply_rules
from rillway.operators.quality import quality_report, report_rows, summarise_quality
from rillway.operators.scoring import Feature, presence_score, route_by_score
from rillway.operators.spec_documents import complexity, element_sets, step_inventory, tag_names
from rillway.plans.line_diff_sql import diff_sql, without_last_blank
from rillway.plans.registry import query, table
from rillway.plans.text_queries import MARK_RULES
from rillway.session import scratch_path


def _tag(name: str, *content: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), *content, F.lit(f"</{name}>"))


def _kind() -> Column:
    return F.pmod(F.col("p_size"), F.lit(3))


def part_specs(spark: SparkSession, d: str) -> DataFrame:
    """A small transformation per part: a reader, and a join, filter or string step by size."""
    first = _tag("step", _tag("name", F.lit("read "), escape_markup(F.col("p_brand"))), _tag("type", F.lit("TextFileInput")))
    step_type = F.when(_kind() == 0, "MergeJoin").when(_kind() == 1, "FilterRows").otherwise("StringTrim")
    condition = _tag("compare", _tag("condition", F.lit("size &gt; "), F.col("p_size").cast("string")))
    second = _tag(
        "group",
        _tag(
            "step",
            _tag("name", escape_markup(F.col("p_type"))),
            F.when(F.col("p_partkey") % 7 == 0, F.lit("")).otherwise(_tag("type", step_type)),
            F.when(_kind() == 1, condition).otherwise(F.lit("")),
        ),
    )
    head = _tag("info", _tag("name", escape_markup(F.col("p_name"))))
    body = F.concat(F.lit("\n"), head, F.lit("\n"), first, F.lit("\n"), second, F.lit("\n"))
    # A few megabytes of parts become many more of documents: one task reads them, all tasks make and parse documents.
    parts = table(spark, d, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return parts.select(
        "p_partkey",
        F.concat(F.lit("Part-"), F.col("p_partkey").cast("string")).alias("name"),
        # Every eleventh document is cut off and does not parse.
        F.when(F.col("p_partkey") % 11 == 10, F.concat(F.lit("<transformation>"), body))
        .otherwise(_tag("transformation", body))
        .alias("xml"),
    )


_SPEC_SQL = """
    SELECT p_partkey, p_name, p_brand, p_type, p_size, p_partkey % 11 <> 10 AS parsed,
           CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_size % 3 = 0 THEN 'MergeJoin'
                WHEN p_size % 3 = 1 THEN 'FilterRows' ELSE 'StringTrim' END AS step_type
    FROM part
"""


@query(
    f"""
    SELECT p_partkey, 'read ' || p_brand AS name, 'TextFileInput' AS type FROM ({_SPEC_SQL}) WHERE parsed
    UNION ALL
    SELECT p_partkey, p_type, coalesce(step_type, 'UnknownType') FROM ({_SPEC_SQL}) WHERE parsed
    """
)
def q_xml_inventory(spark: SparkSession, d: str) -> DataFrame:
    return step_inventory(part_specs(spark, d), key="p_partkey")


_SETS_SQL = f"""
    SELECT p_partkey, parsed,
           CASE WHEN parsed THEN list_sort([p_name, 'read ' || p_brand, p_type]) ELSE []::VARCHAR[] END AS columns,
           CASE WHEN parsed AND p_size % 3 = 1 THEN ['size > ' || p_size] ELSE []::VARCHAR[] END AS filters,
           CASE WHEN parsed AND step_type = 'MergeJoin' THEN ['MergeJoin'] ELSE []::VARCHAR[] END AS joins,
           []::VARCHAR[] AS calculations,
           CASE WHEN parsed AND step_type = 'StringTrim' THEN ['StringTrim'] ELSE []::VARCHAR[] END AS string_ops
    FROM ({_SPEC_SQL})
"""
_JOINED = ", ".join(
    f"array_to_string({s}, '|') AS {s}" for s in ("columns", "filters", "joins", "calculations", "string_ops")
)


@query(f"SELECT p_partkey, parsed, {_JOINED} FROM ({_SETS_SQL})")
def q_element_sets(spark: SparkSession, d: str) -> DataFrame:
    sets = element_sets(part_specs(spark, d))
    names = ("columns", "filters", "joins", "calculations", "string_ops")
    return sets.select("p_partkey", "parsed", *[F.array_join(s, "|").alias(s) for s in names])


@query(
    f"""
    WITH s AS (
      SELECT *, CAST(len(columns) + 2 * len(filters) + 3 * len(joins) + 2 * len(string_ops) AS INTEGER) AS total_score
      FROM ({_SETS_SQL}))
    SELECT p_partkey, CAST(len(columns) AS INTEGER) AS columns_count, CAST(len(filters) AS INTEGER) AS filters_count,
           CAST(len(joins) AS INTEGER) AS joins_count, 0 AS calculations_count,
           CAST(len(string_ops) AS INTEGER) AS string_ops_count, CASE WHEN parsed THEN 5 ELSE 4 END AS xml_lines,
           CASE WHEN parsed THEN 2 ELSE 0 END AS hops_count, total_score,
           CASE WHEN total_score < 10 THEN 'Low' WHEN total_score < 25 THEN 'Medium' ELSE 'High' END AS complexity_level
    FROM s
    """
)
def q_spec_complexity(spark: SparkSession, d: str) -> DataFrame:
    return complexity(element_sets(part_specs(spark, d))).drop("name", "xml", "parsed")


_TAGS = "regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)"
_HREFS = "regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)"


@query(
    f"""
    WITH s AS (
      SELECT page_id, len(list_distinct({_TAGS})) AS c, len(list_distinct({_HREFS})) AS f,
             len(list_filter({_TAGS}, lambda t: t IN ('table', 'ul'))) AS j,
             len(list_filter({_TAGS}, lambda t: t = 'script')) AS k,
             len(list_filter({_TAGS}, lambda t: t = 'style')) AS o, len({_TAGS}) AS h,
             len(string_split(html, chr(10))) - CASE WHEN html LIKE '%' || chr(10) THEN 1 ELSE 0 END AS x
      FROM pages),
    t AS (SELECT *, c + 2 * f + 3 * j + 3 * k + 2 * o AS score FROM s)
    SELECT page_id, CAST(c AS INTEGER) AS columns_count, CAST(f AS INTEGER) AS filters_count,
           CAST(j AS INTEGER) AS joins_count, CAST(k AS INTEGER) AS calculations_count,
           CAST(o AS INTEGER) AS string_ops_count, CAST(x AS INTEGER) AS xml_lines, CAST(h AS INTEGER) AS hops_count,
           CAST(score AS INTEGER) AS total_score,
           CASE WHEN score < 10 THEN 'Low' WHEN score < 25 THEN 'Medium' ELSE 'High' END AS complexity_level
    FROM t
    """
)
def q_complexity(spark: SparkSession, d: str) -> DataFrame:
    """The same score on web pages, with tags and links as the sets; no Python in this plan."""
    # A column of its own, so that the five sets are taken from one pass over the page.
    pages = table(spark, d, "pages").withColumn("tags", tag_names(F.col("html")))
    tags = F.col("tags")
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))

    def those(*names: str) -> Column:
        return F.filter(tags, lambda t: t.isin(*names))

    sets = pages.select(
        "page_id",
        F.array_distinct(tags).alias("columns"),
        F.array_distinct(hrefs).alias("filters"),
        those("table", "ul").alias("joins"),
        those("script").alias("calculations"),
        those("style").alias("string_ops"),
        F.size(tags).alias("hops"),
        count_lines(F.col("html")).alias("lines"),
    )
    return complexity(sets)


PAGE_FEATURES = (
    Feature("links", ("<a href",)),
    Feature("marks", ("###", "***", "$$$")),
    Feature("breaks", ("<br>", "<hr>"), required="<p>"),
)


def page_scores(spark: SparkSession, d: str) -> DataFrame:
    """Presence of page features before and after a clean-up."""
    cleaned = apply_rules(table(spark, d, "pages").select("page_id", "url", "html"), "html", MARK_RULES)
    expected = {
        "links": F.lit(True),
        "marks": F.contains("url", F.lit("/fr/")),
        "breaks": F.contains("url", F.lit("https")),
    }
    before, after = presence_score(F.col("html"), F.col("corrected"), expected, PAGE_FEATURES)
    return cleaned.select("page_id", "url", before.alias("score_before"), after.alias("score_after"))


_SCORE_SQL = r"""
    WITH v AS (
      SELECT page_id, url, html AS b,
             replace(regexp_replace(replace(html, '###', ''), '%+', '%', 'g'), '***', '') AS a FROM pages),
    e AS (SELECT *, contains(url, '/fr/') AS m, contains(url, 'https') AS r,
                 contains(a, 'write') OR contains(b, 'write') AS w FROM v),
    h AS (SELECT page_id, url, 1 + m::INT + r::INT + w::INT AS total,
      contains(b, '<a href')::INT + (m AND (contains(b, '###') OR contains(b, '***') OR contains(b, '$$$')))::INT
        + (r AND (contains(b, '<br>') OR contains(b, '<hr>')) AND contains(b, '<p>'))::INT
        + (w AND contains(b, '.write'))::INT AS hb,
      contains(a, '<a href')::INT + (m AND (contains(a, '###') OR contains(a, '***') OR contains(a, '$$$')))::INT
        + (r AND (contains(a, '<br>') OR contains(a, '<hr>')) AND contains(a, '<p>'))::INT
        + (w AND contains(a, '.write'))::INT AS ha
      FROM e)
    SELECT page_id, url, CAST(hb AS DOUBLE) / CAST(total AS DOUBLE) * 100.0::DOUBLE AS score_before,
           CAST(ha AS DOUBLE) / CAST(total AS DOUBLE) * 100.0::DOUBLE AS score_after
    FROM h
"""


@query(f"SELECT page_id, score_before, score_after FROM ({_SCORE_SQL})")
def q_quality_score(spark: SparkSession, d: str) -> DataFrame:
    return page_scores(spark, d).drop("url")


@query(
    f"""
    SELECT page_id, score_after < 60 AS regenerate,
           CASE WHEN contains(url, 'https') THEN 'corrected' ELSE 'generated' END AS action
    FROM ({_SCORE_SQL})
    """
)
def q_score_route(spark: SparkSession, d: str) -> DataFrame:
    scores = page_scores(spark, d).withColumn("had_existing", F.contains("url", F.lit("https")))
    return route_by_score(scores, "score_after", "had_existing", below=60.0).select("page_id", "regenerate", "action")


def part_programs(spark: SparkSession, d: str) -> DataFrame:
    """A program for three of four parts; some have faults that the rules know."""
    key = F.col("p_partkey")

    def line(condition: Column, text: str) -> Column:
        return F.when(condition, F.lit(text)).otherwise(F.lit(""))

    code = F.concat(
        F.lit('df = spark.read.text("in")\n'),
        line((_kind() == 0) & (key % 2 == 0), "df = df.join(other)\n"),
        line(_kind() == 1, "df = df.filter(a === 1)\n"),
        line(key % 3 == 0, 'df = df.select("a")\n'),
        line(key % 5 == 0, 'df.write.mode("overwrite") \\\n  .csv("out")\n'),
    )
    programs = table(spark, d, "part").filter(key % 4 != 0)
    return programs.select(
        F.concat(F.lit("Part-"), key.cast("string"), F.lit("_converted")).alias("name"), code.alias("code")
    )


_LISTS = ", ".join(
    f"""CASE WHEN len({s}) = 0 THEN '[]' ELSE '[' || chr(10) || array_to_string(list_transform({s},
        lambda x: '    "' || x || '"'), ',' || chr(10)) || chr(10) || '  ]' END AS j_{s}"""
    for s in ("columns", "filters", "joins", "calculations", "string_ops")
)
_REPORT_CTES = f"""
    WITH s AS (SELECT s.*, p.p_size, {_LISTS} FROM ({_SETS_SQL}) s JOIN part p USING (p_partkey)),
    c AS (
      SELECT *, p_partkey % 4 <> 0 AS had, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE
        'df = spark.read.text("in")' || chr(10)
        || CASE WHEN p_size % 3 = 0 AND p_partkey % 2 = 0 THEN 'df = df.join(other)' || chr(10) ELSE '' END
        || CASE WHEN p_size % 3 = 1 THEN 'df = df.filter(a === 1)' || chr(10) ELSE '' END
        || CASE WHEN p_partkey % 3 = 0 THEN 'df = df.select("a")' || chr(10) ELSE '' END
        || CASE WHEN p_partkey % 5 = 0
             THEN 'df.write.mode("overwrite") ' || chr(92) || chr(10) || '  .csv("out")' || chr(10) ELSE '' END
        END AS code,
        '# Could not generate automatically.' || chr(10) || '# Expected elements: {{' || chr(10)
        || '  "columns": ' || j_columns || ',' || chr(10) || '  "filters": ' || j_filters || ',' || chr(10)
        || '  "joins": ' || j_joins || ',' || chr(10) || '  "calculations": ' || j_calculations || ',' || chr(10)
        || '  "string_ops": ' || j_string_ops || chr(10) || '}}' || chr(10) AS fallback
      FROM s),
    o AS (SELECT *, CASE WHEN had
            THEN replace(replace(code, '===', '=='), '"overwrite") ' || chr(92), '"overwrite")' || chr(92))
            ELSE fallback END AS code_out FROM c),
    h AS (SELECT *,
        (len(columns) > 0)::INT + (len(filters) > 0)::INT + (len(joins) > 0)::INT + (len(string_ops) > 0)::INT
          + (contains(code, 'write') OR contains(code_out, 'write'))::INT AS total,
        (len(columns) > 0 AND contains(code, '.select('))::INT + (len(filters) > 0 AND contains(code, '.filter('))::INT
          + (len(joins) > 0 AND contains(code, '.join('))::INT + contains(code, '.write')::INT AS hits,
        (len(columns) > 0 AND contains(code_out, '.select('))::INT
          + (len(filters) > 0 AND contains(code_out, '.filter('))::INT
          + (len(joins) > 0 AND contains(code_out, '.join('))::INT + contains(code_out, '.write')::INT AS hits_out
      FROM o),
    r AS (SELECT *,
        CASE WHEN total = 0 THEN 50.0::DOUBLE ELSE hits::DOUBLE / total::DOUBLE * 100.0::DOUBLE END AS accuracy_before,
        CASE WHEN total = 0 THEN 50.0::DOUBLE ELSE hits_out::DOUBLE / total::DOUBLE * 100.0::DOUBLE END AS accuracy_after
      FROM h)
"""
_REPORT_SQL = f"""{_REPORT_CTES}
    SELECT 'part_' || p_partkey AS file, accuracy_before, accuracy_after,
           CASE WHEN had THEN 'corrected' ELSE 'generated' END AS action, accuracy_after < 20 AS regenerate,
           CASE WHEN had AND code_out <> code THEN concat_ws('|',
             CASE WHEN p_size % 3 = 1 THEN 'Replace ===' END, CASE WHEN p_partkey % 5 = 0 THEN 'Fix mode continuation' END)
             ELSE 'NO_CHANGE' END AS rules,
           CASE WHEN accuracy_after < 20 THEN fallback ELSE code_out END AS text_after,
           'part_' || p_partkey || CASE WHEN had THEN '_corrected' ELSE '_generated' END AS target
    FROM r
"""


def part_report(spark: SparkSession, d: str) -> DataFrame:
    return quality_report(part_specs(spark, d).drop("p_partkey"), part_programs(spark, d))


@query(_REPORT_SQL)
def w_document_report(spark: SparkSession, d: str) -> DataFrame:
    """Sets, pairing, rules, scores, gate and final text of every spec document."""
    report = part_report(spark, d).withColumn("rules", F.array_join("rules", "|"))
    return report.drop("mode", "engine", "text_before")


@query(
    f"""
    WITH m AS (
      SELECT count(*) AS n, CAST(sum(CAST(accuracy_before AS DECIMAL(20,10))) AS DOUBLE) / count(*) AS b,
             CAST(sum(CAST(accuracy_after AS DECIMAL(20,10))) AS DOUBLE) / count(*) AS a FROM ({_REPORT_SQL}))
    SELECT CAST(n AS BIGINT) AS documents, b AS mean_before, a AS mean_after, a - b AS improvement FROM m
    """
)
def q_quality_summary(spark: SparkSession, d: str) -> DataFrame:
    return summarise_quality(part_report(spark, d))


_TEXTS_SQL = f"""{_REPORT_CTES}
    SELECT 'part_' || p_partkey AS k, {without_last_blank("string_split(code, chr(10))")} AS b,
           {without_last_blank("string_split(CASE WHEN accuracy_after < 20 THEN fallback ELSE code_out END, chr(10))")} AS a
    FROM r WHERE had
"""


@query(
    f"""
    SELECT file, accuracy_before, accuracy_after, action, seq, rule, CASE WHEN rule = 'DIFF_DELETE' THEN line WHEN rule IS NOT NULL THEN '' END AS before,
           CASE WHEN rule = 'DIFF_DELETE' THEN '' ELSE line END AS after
    FROM ({_REPORT_SQL}) LEFT JOIN ({diff_sql(_TEXTS_SQL)}) ON file = k
    """
)
def w_document_diffs(spark: SparkSession, d: str) -> DataFrame:
    """What the rules changed in every program, line by line, with the scores of its document."""
    # Written once, as the report is read for the documents and for their differences.
    path = scratch_path(spark, "report")
    part_report(spark, d).write.parquet(path)
    return report_rows(spark.read.parquet(path)).drop("mode", "engine", "note")
