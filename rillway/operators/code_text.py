"""Code inside text: fenced blocks and lines that look like code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway.functions.text import INLINE_SPACE, SPACE, strip, unify_line_ends
from rillway.operators.ordering import running_totals
from rillway.sources.fields import named

# A fence line with its line end: white space, three backticks, anything.
FENCE_LINE = rf"(?m)^{INLINE_SPACE}*```[^\n]*(\n|\z)"

# Beginnings of a line that is kept outside of fences.
CODE_STARTS = ("from ", "import ", "df", "spark", "withColumn", "filter", "join", "select", r"col\(")


def extract_code(text: Column, starts: tuple[str, ...] = CODE_STARTS) -> Column:
    """Lines inside fences, and outside only those that begin like code; fence lines are dropped.

    Splitting at the fence lines gives pieces that are outside and inside by turns, so the state
    of "inside" needs no pass over the lines of a document and no shuffle.
    """
    code_line = rf"^{SPACE}*({'|'.join(starts)})"
    pieces = F.split(unify_line_ends(text), FENCE_LINE)

    def keep(piece: Column, index: Column) -> Column:
        lines = F.filter(F.split(piece, "\n"), lambda line: line.rlike(code_line))
        outside = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
        return F.when(index % 2 == 1, piece).otherwise(outside)

    return strip(F.array_join(F.transform(pieces, keep), ""))


def code_lines(lines: DataFrame, document: str, position: str, line: str, starts: tuple[str, ...] = CODE_STARTS) -> DataFrame:
    """The rows of ``lines`` that are code, for documents that come as rows (document, position, line).

    A line is inside a fence if an odd number of fence lines of its document lies before it. Those are
    counted by running totals over ranges of positions, so a document of any length spreads over tasks. As in
    ``extract_code``, fence lines are dropped, and outside only lines that begin like code stay; ``position``
    is unique within a document.
    """
    fence = F.coalesce(named(line).rlike(rf"^{INLINE_SPACE}*```"), F.lit(False))
    counted = running_totals(
        lines.withColumn("_fence", fence), [position], {"_fences": F.col("_fence").cast("long")}, within=[document]
    )
    inside = F.col("_fences") % 2 == 1
    code = inside | named(line).rlike(rf"^{SPACE}*({'|'.join(starts)})")
    return counted.filter(~F.col("_fence") & code).select([named(c) for c in lines.columns])
