"""Presence scores and what follows from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway.functions.text import contains_any

# Score without any expected feature, and the score below which text is made anew.
NEUTRAL_SCORE = 50.0
REGENERATE_BELOW = 20.0


@dataclass(frozen=True)
class Feature:
    """A feature is found if the text has ``required`` (when given) and any of ``tokens``."""

    name: str
    tokens: tuple[str, ...]
    required: str | None = None

    def found(self, text: Column) -> Column:
        hit = contains_any(text, self.tokens)
        return hit if self.required is None else hit & F.contains(text, F.lit(self.required))


# Tokens by which each feature of a program is recognised.
FEATURES = (
    Feature("joins", (".join(",)),
    Feature("filters", (".filter(",)),
    Feature("columns", (".select(", ".withColumn", ".withColumnRenamed")),
    Feature("string_ops", ("upper(", "lower(", "substr("), required=".withColumn"),
    Feature("calculations", ("+", "-", "*", "/"), required=".withColumn"),
)
OUTPUT = Feature("output", (".write",))
OUTPUT_HINT = "write"


def share_of(hits: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(NEUTRAL_SCORE)).otherwise(
        F.try_divide(hits.cast("double"), total.cast("double")) * F.lit(100.0)
    )


def presence_score(
    before: Column, after: Column, expected: dict[str, Column], features: tuple[Feature, ...] = FEATURES
) -> tuple[Column, Column]:
    """Percentage of the expected features that each text has.

    ``expected`` gives a boolean per feature. Output is expected as soon as either text mentions it.
    """
    wanted = [(f, expected[f.name]) for f in features if f.name in expected]
    mentions = contains_any(before, [OUTPUT_HINT]) | contains_any(after, [OUTPUT_HINT])
    wanted.append((OUTPUT, expected[OUTPUT.name] | mentions if OUTPUT.name in expected else mentions))
    total = sum((w.cast("int") for _, w in wanted), F.lit(0))

    def score(text: Column) -> Column:
        hits = sum(((w & f.found(text)).cast("int") for f, w in wanted), F.lit(0))
        return share_of(hits, total)

    return score(before), score(after)


def expected_features() -> dict[str, Column]:
    """A feature is expected where the element set of that name is not empty."""
    return {f.name: F.size(F.col(f.name)) > 0 for f in FEATURES}


def route_by_score(df: DataFrame, score: str, had_existing: str, below: float = REGENERATE_BELOW) -> DataFrame:
    """Add ``regenerate`` (score under the limit) and ``action`` (corrected or generated)."""
    return df.withColumns(
        {
            "regenerate": F.col(score) < F.lit(below),
            "action": F.when(F.col(had_existing), "corrected").otherwise("generated"),
        }
    )
