"""Ordered text rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway.functions.text import SPACE
from rillway.sources.fields import named

NO_CHANGE = "NO_CHANGE"


@dataclass(frozen=True)
class Rule:
    """Replace ``find`` by ``put``: as literal text, or as a regular expression if ``regex``."""

    name: str
    find: str
    put: str
    regex: bool = False
    note: str = ""

    def apply(self, text: Column) -> Column:
        if self.regex:
            return F.regexp_replace(text, self.find, self.put)
        return F.replace(text, F.lit(self.find), F.lit(self.put))


# Rules for generated programs, in order. (?d) ends a line at \n only.
PROGRAM_RULES = (
    Rule("Replace ===", "===", "==", note="PySpark uses '==' not '==='."),
    Rule(
        "Fix malformed join",
        rf"(?d)\.with{SPACE}*==.*",
        "# FIXED: replaced malformed join → specify join condition manually",
        regex=True,
        note="Replaced broken join with placeholder",
    ),
    Rule(
        "Clean line continuation",
        rf"(?d)\\{SPACE}*#.*",
        r"\\",
        regex=True,
        note="Removed invalid comment after backslash",
    ),
    Rule("Fix mode continuation", '.mode("overwrite") \\', '.mode("overwrite")\\', note="Fixed line continuation"),
)


def apply_rules(
    df: DataFrame,
    text: str,
    rules: Sequence[Rule] = PROGRAM_RULES,
    *,
    out: str = "corrected",
    fired: str = "rules",
) -> DataFrame:
    """Add the text after all rules, and the names of those that changed it, or ``NO_CHANGE``."""
    stages = [named(text)]
    steps = {}
    for i, rule in enumerate(rules):
        steps[f"_r{i}"] = rule.apply(stages[-1])
        stages.append(F.col(f"_r{i}"))
    # One projection per rule: each result is computed once and read by the next rule and by the flags.
    for name, step in steps.items():
        df = df.withColumn(name, step)
    flags = [
        F.when(~after.eqNullSafe(before), F.lit(rule.name))
        for rule, before, after in zip(rules, stages, stages[1:])
    ]
    names = F.filter(F.array(*flags), lambda x: x.isNotNull())
    listed = F.when(stages[-1].eqNullSafe(stages[0]), F.array_append(names, F.lit(NO_CHANGE))).otherwise(names)
    return df.withColumns({out: stages[-1], fired: listed}).drop(*steps)


def rule_notes(df: DataFrame, key: str, fired: str = "rules", rules: Sequence[Rule] = PROGRAM_RULES) -> DataFrame:
    """One row per fired rule, with its note."""
    notes = {r.name: r.note for r in rules} | {NO_CHANGE: "No rule-based changes applied"}
    lookup = F.create_map(*[F.lit(x) for pair in notes.items() for x in pair])
    rows = df.select(named(key), F.explode(named(fired)).alias("rule"))
    return rows.withColumn("note", lookup[F.col("rule")])
