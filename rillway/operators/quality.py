"""Report over spec documents and the programs that belong to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway.functions.text import stem_key
from rillway.operators.aggregates import compare_means
from rillway.operators.cleaning import PROGRAM_RULES, Rule, apply_rules
from rillway.operators.joins import pair_documents
from rillway.operators.line_diff import line_diff
from rillway.operators.ordering import latest_per_key
from rillway.operators.scoring import expected_features, presence_score, route_by_score
from rillway.operators.spec_documents import SETS, element_sets
from rillway.session import scratch_path
from rillway.sources.documents import write_documents
from rillway.sources.replace import replace_files


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.char_length(listed) - 2)


def json_summary(sets: Sequence[str] = SETS) -> Column:
    """The sets as a JSON object, indented by two blanks."""
    members = []
    for name in sets:
        items = F.array_join(F.transform(F.col(name), lambda x: F.concat(F.lit("    "), _quoted(x))), ",\n")
        array = F.when(F.size(name) == 0, "[]").otherwise(F.concat(F.lit("[\n"), items, F.lit("\n  ]")))
        members.append(F.concat(F.lit(f'  "{name}": '), array))
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *members), F.lit("\n}"))


def fallback_text(sets: Sequence[str] = SETS) -> Column:
    """What stands in for a program that cannot be made by rules: the expected elements as a comment."""
    return F.concat(
        F.lit("# Could not generate automatically.\n# Expected elements: "), json_summary(sets), F.lit("\n")
    )


def pair_programs(specs: DataFrame, programs: DataFrame) -> DataFrame:
    """Specs (``name``, ``xml``) with their programs (``name``, ``code``) by normalised name.

    Where several names give one key, the last name in order counts. A column ``program``, the file name of a
    program, is passed on.
    """
    left = latest_per_key(specs.withColumn("file", stem_key(F.col("name"))), "file", ["name"])
    right = latest_per_key(programs.withColumn("file", stem_key(F.col("name"))), "file", ["name"])
    kept = [c for c in ("code", "program") if c in right.columns]
    return pair_documents(left, right.select("file", *kept), "file").drop("file_r")


def quality_report(
    specs: DataFrame, programs: DataFrame, *, mode: str = "keep", rules: Sequence[Rule] = PROGRAM_RULES
) -> DataFrame:
    """One row per spec document: scores before and after cleaning, action, final text.

    ``mode`` decides the target: ``keep`` is next to the original, ``overwrite`` in its place (``overwrite_programs``).
    """
    if mode not in ("keep", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    sets = element_sets(pair_programs(specs, programs)).withColumn("code", F.coalesce("code", F.lit("")))
    cleaned = apply_rules(sets, "code", rules, out="cleaned", fired="rules").withColumn(
        "code_out", F.when(F.col("had_existing"), F.col("cleaned")).otherwise(fallback_text())
    )
    before, after = presence_score(F.col("code"), F.col("code_out"), expected_features())
    scored = cleaned.withColumns({"accuracy_before": before, "accuracy_after": after})
    routed = route_by_score(scored, "accuracy_after", "had_existing")
    return routed.select(
        "file",
        F.lit(mode).alias("mode"),
        F.lit("rules").alias("engine"),
        "accuracy_before",
        "accuracy_after",
        "action",
        "regenerate",
        "rules",
        F.col("code").alias("text_before"),
        F.when(F.col("regenerate"), fallback_text()).otherwise(F.col("code_out")).alias("text_after"),
        target_name(mode).alias("target"),
        *(["program"] if "program" in routed.columns else []),
    )


def report_rows(report: DataFrame) -> DataFrame:
    """The report as a row per difference: hunks, deleted and inserted lines of each corrected text.

    A document without differences, or without an earlier program, has one row without a rule.
    """
    corrected = report.filter("action = 'corrected'")
    diff = line_diff(corrected, "file", "text_before", "text_after").withColumnRenamed("file", "_file")
    facts = report.select("file", "mode", "engine", "accuracy_before", "accuracy_after", "action")
    rows = facts.join(diff, (F.col("file") == F.col("_file")) & (F.col("action") == "corrected"), "left")
    return rows.select(*facts.columns, "seq", "rule", "before", "after", "note")


def target_name(mode: str) -> Column:
    """File name of the result; an overwritten original keeps its own."""
    kept = F.col("file") if mode == "overwrite" else F.concat("file", F.lit("_corrected"))
    return F.when(F.col("action") == "corrected", kept).otherwise(F.concat("file", F.lit("_generated")))


def overwrite_programs(report: DataFrame, folder: str) -> None:
    """Put the corrected texts in the place of the programs of ``folder`` that they were made from."""
    corrected = report.filter("action = 'corrected' AND program IS NOT NULL")
    replace_files(corrected, folder, "program", "text_after")


def save_texts(report: DataFrame, folder: str) -> None:
    """Write the final texts, one file per document under ``target=<name>``.

    The texts may come from files in this very folder, so they are written aside first.
    """
    spark = report.sparkSession
    aside = scratch_path(spark, "texts")
    report.select("target", "text_after").write.parquet(aside)
    write_documents(spark.read.parquet(aside), folder, "target", "text_after")


def summarise_quality(report: DataFrame) -> DataFrame:
    return compare_means(report, "accuracy_before", "accuracy_after").withColumnRenamed("n_rows", "documents")
