"""Facts about job-spec documents (XML): steps, element sets, complexity."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillway.functions.binding import let
from rillway.functions.text import count_lines, strip
from rillway.operators.arrays import rows_of
from rillway.session import scratch_path
from rillway.sources.fields import named

SETS = ("columns", "filters", "joins", "calculations", "string_ops")

# Words in a step type that mark a join or a string operation.
JOIN_WORD = "Join"
STRING_WORDS = ("Trim", "ReplaceString", "LowerCase", "UpperCase", "Substring")

# Weights of the five sets, and the scores from which a level starts.
WEIGHTS = {"columns": 1, "filters": 2, "joins": 3, "calculations": 3, "string_ops": 2}
MEDIUM_FROM, HIGH_FROM = 10, 25

_TEXTS = T.ArrayType(T.StringType())
_FACTS = (
    T.StructType()
    .add("parsed", T.BooleanType())
    .add("hops", T.IntegerType())
    .add("steps", T.ArrayType(T.StructType().add("name", T.StringType()).add("type", T.StringType())))
    .add("names", _TEXTS)
    .add("conditions", _TEXTS)
    .add("join_types", _TEXTS)
    .add("calculations", _TEXTS)
    .add("calculator_fields", _TEXTS)
)


def _whole(node: ET.Element) -> str:
    return "".join(node.itertext()).strip()


def _child(node: ET.Element, tag: str, missing: str | None = None) -> str | None:
    found = node.find(tag)
    return missing if found is None else found.text


def _facts(xml: str | None) -> dict:
    """What one document holds, in document order; one walk over its elements."""
    facts = {
        "parsed": False, "hops": 0, "steps": [], "names": [], "conditions": [],
        "join_types": [], "calculations": [], "calculator_fields": [],
    }
    try:
        root = ET.fromstring(xml or "")
    except (ET.ParseError, ValueError):
        return facts
    facts["parsed"] = True
    elements = root.iter()
    next(elements)
    for node in elements:
        match node.tag:
            case "step":
                facts["steps"].append(
                    {"name": _child(node, "name", "UnknownStep"), "type": _child(node, "type", "UnknownType")}
                )
            case "hop":
                facts["hops"] += 1
            case "name" if (node.text or "").strip():
                facts["names"].append(node.text.strip())
            case "condition" | "compare" if _whole(node):
                facts["conditions"].append(_whole(node))
            case "MergeJoinMeta" if _child(node, "join_type"):
                facts["join_types"].append(_child(node, "join_type").strip())
            case "calculation" if _whole(node):
                facts["calculations"].append(_whole(node))
            case "CalculatorMetaFunction":
                field, kind = _child(node, "field_name"), _child(node, "calc_type")
                if field and kind:
                    facts["calculations"].append(f"{field}:{kind}")
            case "field":
                label, kind = _child(node, "name"), _child(node, "calculation_type")
                if label and label.isspace():
                    # A blank field name counts as one name, the empty one.
                    facts["names"].append("")
                if kind:
                    facts["calculator_fields"].append(f"{label}:{kind}")
    return facts


@F.pandas_udf(_FACTS)
def spec_facts(xml: pd.Series) -> pd.DataFrame:
    # Nested conditions have no fixed depth, and xpath() fails on text that is not well-formed.
    return pd.DataFrame([_facts(x) for x in xml])


def with_facts(docs: DataFrame, xml: str = "xml") -> DataFrame:
    return docs.withColumn("_facts", spec_facts(named(xml)))


# Stands for the text of an empty element; never text itself.
_NO_TEXT = "\ufdd0"
# The root put around a document; one that holds its end does not parse.
_ROOT = "whole-document"


def _readable(xml: Column) -> Column:
    """The document inside a root of our own, with a mark in empty names and types; null if it does not parse.

    ``xpath`` fails on text that is not well-formed, so that is found out first. As ``from_xml`` stops after the
    root element, it is given one that ends where the document does.
    """
    body = F.regexp_replace(xml, r"^\x{FEFF}?(<\?xml\s[^>]*\?>)?", "")
    marked = F.regexp_replace(body, r"<(name|type)(\s[^<>]*)?(/>|></\1\s*>)", f"<$1>{_NO_TEXT}</$1>")
    whole = F.concat(F.lit(f"<{_ROOT}>"), marked, F.lit(f"</{_ROOT}>"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = F.from_xml(whole, "_bad STRING, _none STRING", options)
    one_root = F.xpath_boolean(whole, F.lit("count(/*/*) = 1 and not(/*/text()[normalize-space()])"))
    closed = F.contains(body, F.lit(f"</{_ROOT}"))
    return F.when(parsed.isNotNull() & parsed["_bad"].isNull() & ~closed, F.when(one_root, whole))


def _child_texts(xml: Column, steps: str, tag: str, missing: str) -> Column:
    """The text of a child of each step. In document order, ``xpath`` gives a null for a step, then its child's text."""
    path = f"{steps} | {steps}/{tag}[1]/text()[not(preceding-sibling::*)]"

    def texts(found: Column) -> Column:
        def of_steps(starts: Column) -> Column:
            def one(start: Column, number: Column) -> Column:
                end = F.coalesce(F.get(starts, number + 1), F.size(found))
                text = F.array_join(F.slice(found, start + 2, end - start - 1), "")
                return F.when(end == start + 1, F.lit(missing)).when(text != _NO_TEXT, text)

            return F.transform(starts, one)

        return let(F.filter(F.transform(found, lambda _, k: k), lambda k: F.get(found, k).isNull()), of_steps)

    return let(F.xpath(xml, F.lit(path)), texts)


def step_inventory(docs: DataFrame, key: str = "file", xml: str = "xml") -> DataFrame:
    """One row per step at any depth; a document that does not parse gives none.

    Steps of one depth of nesting are read at a time, as a path can tell them from steps inside them.
    Documents with a document type definition, and those whose names have an undeclared entity, do not parse.
    """
    spark = docs.sparkSession
    nested = F.xpath_boolean("_xml", F.lit("boolean(//step//step)"))
    path = scratch_path(spark, "readable")
    # Written, as parsing costs more than anything after it; the outer form parses a document once (see ``rows_of``).
    parsed = rows_of(docs, key, F.array(_readable(named(xml))), item="_xml").filter("_xml IS NOT NULL")
    parsed.withColumn("_nested", nested).write.parquet(path)
    readable = spark.read.parquet(path)
    depths = 1
    inner = readable.filter("_nested")
    while not inner.filter(F.xpath_boolean("_xml", F.lit("boolean(" + "//step" * (depths + 1) + ")"))).isEmpty():
        depths += 1

    def steps_at(depth: int) -> Column:
        steps = f"/{_ROOT}/*//step[count(ancestor::step) = {depth}]"
        return F.arrays_zip(
            _child_texts(F.col("_xml"), steps, "name", "UnknownStep").alias("name"),
            _child_texts(F.col("_xml"), steps, "type", "UnknownType").alias("type"),
        )

    found = steps_at(0)
    if depths > 1:
        found = F.when(F.col("_nested"), F.concat(*[steps_at(depth) for depth in range(depths)])).otherwise(found)
    return rows_of(readable, key, found, item="step").select(named(key), "step.*")


def _sorted_set(items: Column) -> Column:
    return F.array_sort(F.array_distinct(items))


def element_sets(docs: DataFrame, xml: str = "xml", mode: str = "as_reference") -> DataFrame:
    """Add the five element sets (sorted arrays), ``hops`` and ``lines``.

    ``as_reference`` counts a join type once per document, takes ``<calculation>`` elements as the
    only calculations, and gives the number of steps as hops. ``fixed`` counts each join step, also
    takes calculator fields and string-operation steps, and counts real hops.
    """
    facts = F.col("_facts")
    kinds = F.transform(facts["steps"], lambda s: strip(s["type"]))
    is_join = lambda t: F.contains(t, F.lit(JOIN_WORD))
    words = STRING_WORDS if mode == "as_reference" else (*STRING_WORDS, "StringOperations")
    is_string = lambda t: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w))
    if mode == "as_reference":
        joins = F.concat(facts["join_types"], F.filter(kinds, is_join))
        names = facts["names"]
        calculations = facts["calculations"]
        hops = F.size(facts["steps"])
    elif mode == "fixed":
        join_steps = F.filter(facts["steps"], lambda s: is_join(s["type"]))
        joins = F.transform(join_steps, lambda s: F.concat_ws(":", s["name"], s["type"]))
        names = F.array_remove(facts["names"], "")
        calculations = F.concat(facts["calculations"], facts["calculator_fields"])
        hops = facts["hops"]
    else:
        raise ValueError(f"unknown mode {mode!r}")
    sets = {
        "columns": names,
        "filters": facts["conditions"],
        "joins": joins,
        "calculations": calculations,
        "string_ops": F.filter(kinds, is_string),
    }
    return (
        with_facts(docs, xml)
        .withColumns({name: _sorted_set(items) for name, items in sets.items()})
        .withColumns({"hops": hops, "lines": count_lines(named(xml)), "parsed": facts["parsed"]})
        .drop("_facts")
    )


def weighted_score(counts: dict[str, Column], weights: dict[str, int] = WEIGHTS) -> Column:
    score = F.lit(0)
    for name, weight in weights.items():
        score = score + counts[name] * F.lit(weight)
    return score


def complexity_level(score: Column, medium_from: int = MEDIUM_FROM, high_from: int = HIGH_FROM) -> Column:
    return F.when(score < medium_from, "Low").when(score < high_from, "Medium").otherwise("High")


def complexity(sets: DataFrame) -> DataFrame:
    """Replace the sets of ``element_sets`` by their sizes, a weighted score and a level."""
    sized = sets.withColumns({f"{s}_count": F.size(s) for s in SETS})
    scored = sized.withColumn("total_score", weighted_score({s: F.col(f"{s}_count") for s in SETS}))
    return (
        scored.withColumn("complexity_level", complexity_level(F.col("total_score")))
        .withColumnsRenamed({"lines": "xml_lines", "hops": "hops_count"})
        .drop(*SETS)
    )


def tag_names(html: Column) -> Column:
    """Opening tag names of a text that need not be well-formed, in order."""
    return F.regexp_extract_all(html, F.lit("<([a-z][a-z0-9]*)"), F.lit(1))
