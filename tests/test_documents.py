import json
import random
from datetime import datetime
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from rillway.operators.cleaning import NO_CHANGE
from rillway.operators.quality import (
    fallback_text, pair_programs, quality_report, save_texts, summarise_quality,
)
from rillway.operators.scoring import expected_features, presence_score, route_by_score
from rillway.operators.spec_documents import SETS, complexity, element_sets, step_inventory
from rillway.plans.document_queries import part_specs, q_xml_inventory
from rillway.plans.reports import folder_steps, run_complexity_report, run_quality_report

JOIN_SPEC = """<?xml version="1.0"?>
<transformation>
  <info><name>orders to cities</name><parameters><parameter><name>IN</name></parameter></parameters></info>
  <order>
    <hop><from>read orders</from><to>join</to></hop>
    <hop><from>read cities</from><to>join</to></hop>
    <hop><from>join</from><to>join again</to></hop>
  </order>
  <step><name>read orders</name><type>TextFileInput</type>
    <fields><field><name> city </name></field><field><name>amount</name></field></fields></step>
  <step><name>join</name><type>MergeJoin</type></step>
  <step><name>join again</name><type>MergeJoin</type></step>
  <step><name>keep</name><type>FilterRows</type>
    <compare><condition><negated>N</negated><conditions><condition><left>amount</left></condition></conditions></condition></compare></step>
  <step><name>round</name><type>Calculator</type><calculation><field_name>r</field_name></calculation>
    <fields><field><name>age</name><calculation_type>YEARS</calculation_type></field></fields></step>
  <step><name>tidy</name><type>StringOperations</type></step>
  <step><name>cut</name><type>StringTrim</type></step>
</transformation>
"""
JOB = "<job><entries><entry name='a'><condition>STATUS = 'ACTIVE'</condition></entry></entries></job>"
BROKEN = "<transformation><step><name>x</name></step>"
ODD_STEPS = "<t><group><step/></group><step><name/><type>X</type></step><name>n</name><name>n</name><name> </name>"
ODD_STEPS += "<field><name> </name></field><MergeJoinMeta><join_type>LEFT</join_type></MergeJoinMeta>"
ODD_STEPS += "<CalculatorMetaFunction><field_name>f</field_name><calc_type>ADD</calc_type></CalculatorMetaFunction></t>"


@pytest.fixture
def docs(spark):
    rows = [("spec", JOIN_SPEC), ("job", JOB), ("broken", BROKEN), ("odd", ODD_STEPS), ("none", None), ("empty", "")]
    return spark.createDataFrame(rows, "file STRING, xml STRING")


def by_file(df):
    return {r.file: r for r in df.collect()}


def test_step_inventory(docs, rows):
    steps = step_inventory(docs)
    assert steps.columns == ["file", "name", "type"]
    assert rows(steps.filter("file = 'spec'").select("name")) == [
        ("cut",), ("join again",), ("join",), ("keep",), ("read orders",), ("round",), ("tidy",)
    ]
    assert rows(steps.filter("file <> 'spec'")) == [("odd", "UnknownStep", "UnknownType"), ("odd", None, "X")]


ODD_XML = [
    "<step><name>root</name></step>", "<a><step><type>o</type><step><name>i</name></step><name>outer</name></step></a>",
    "<a><step><step><step><name/></step></step><name>2</name></step></a>", "<a/>\n<!-- after -->", "<a/><b/>", "<a/>text", " <a><step/></a> ",
    "\ufeff<a><step/></a>", "<?xml version='1.0' encoding='UTF-8'?>\n<a><step><name> s <!--c-->p </name><type><![CDATA[<q>]]></type></step></a>",
    "<a><step><name>x<b>in</b>tail</name><name>second</name><type></type></step></a>", "<a><step><name>&lt;&#65;&amp;</name></step></a>",
    "<a><step><name a='1' /><type b='x'>t</type></step></a>", "<a x='1' x='2'/>", "<a>&bad;</a>", "<a><step><names>n</names></step></a>", "no", "", None,
    "<a><step><name>\n</name><type> </type></step><steps><name>n</name></steps></a>", "</whole-document><whole-document>", "<a></whole-document><whole-document></a>", "</whole-document><a/><whole-document>",
]


def steps_by_hand(xml):
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return []
    child = lambda step, tag, missing: missing if step.find(tag) is None else step.find(tag).text
    return [(child(s, "name", "UnknownStep"), child(s, "type", "UnknownType")) for s in root.findall(".//step")]


def test_step_inventory_equals_a_walk_over_the_tree(spark):
    rng = random.Random(2)

    def element(depth):
        tag = rng.choice(["step", "group", "name", "type", "info"])
        inner = "".join(element(depth + 1) for _ in range(rng.randint(0, 3))) if depth < 5 and tag not in ("name", "type") else rng.choice(["", "t", " "])
        return f"<{tag}/>" if not inner and rng.random() < 0.5 else f"<{tag}>{inner}</{tag}>"

    texts = ODD_XML + [f"<r>{''.join(element(0) for _ in range(4))}</r>"[: None if i % 5 else -1] for i in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "k INT, xml STRING")
    found = step_inventory(df, key="k")
    got = {}
    for r in found.collect():
        got.setdefault(r.k, []).append((r.name, r.type))
    for k, text in enumerate(texts):
        assert sorted(got.get(k, []), key=repr) == sorted(steps_by_hand(text), key=repr), text
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert step_inventory(df.limit(0), key="k").collect() == []


def test_element_sets_as_reference(docs):
    got = by_file(element_sets(docs))
    spec = got["spec"]
    assert spec.columns == sorted(
        ["orders to cities", "IN", "read orders", "city", "amount", "join", "join again", "keep", "round", "age", "tidy", "cut"]
    )
    assert spec.filters == ["Namount", "amount"]
    assert spec.joins == ["MergeJoin"]
    assert spec.calculations == ["r"]
    assert spec.string_ops == ["StringTrim"]
    assert (spec.hops, spec.lines, spec.parsed) == (7, len(JOIN_SPEC.splitlines()), True)
    assert (got["job"].filters, got["job"].columns, got["job"].lines) == (["STATUS = 'ACTIVE'"], [], 1)
    assert got["odd"].columns == ["", "n"]
    assert (got["odd"].joins, got["odd"].calculations) == (["LEFT"], ["f:ADD"])
    assert by_file(element_sets(docs, mode="fixed"))["odd"].columns == ["n"]
    for name in ("broken", "none", "empty"):
        assert not got[name].parsed and all(got[name][s] == [] for s in SETS)


def test_element_sets_fixed(docs):
    spec = by_file(element_sets(docs, mode="fixed"))["spec"]
    assert spec.joins == ["join again:MergeJoin", "join:MergeJoin"]
    assert spec.calculations == ["age:YEARS", "r"]
    assert spec.string_ops == ["StringOperations", "StringTrim"]
    assert spec.hops == 3
    with pytest.raises(ValueError):
        element_sets(docs, mode="other")


def test_complexity_golden(docs):
    got = by_file(complexity(element_sets(docs)))
    # 12 columns, 2 filters, 1 join, 1 calculation, 1 string operation
    assert (got["spec"].total_score, got["spec"].complexity_level) == (12 + 4 + 3 + 3 + 2, "Medium")
    assert (got["job"].total_score, got["job"].complexity_level) == (2, "Low")
    assert (got["broken"].total_score, got["broken"].hops_count, got["broken"].xml_lines) == (0, 0, 1)


def counts_frame(spark, tally):
    """A document with sets of the given sizes."""
    sets = {s: F.transform(F.slice(F.sequence(F.lit(1), F.lit(99)), 1, n), lambda i: i.cast("string")) for s, n in zip(SETS, tally)}
    return spark.range(1).select(*[c.alias(s) for s, c in sets.items()], F.lit(1).alias("hops"), F.lit(1).alias("lines"))


# Set sizes of published jobs with their score and level.
@pytest.mark.parametrize(
    "tally, score, level",
    [
        ((40, 0, 1, 0, 0), 43, "High"), ((20, 0, 0, 0, 0), 20, "Medium"), ((37, 1, 1, 0, 0), 42, "High"),
        ((43, 1, 1, 0, 0), 48, "High"), ((38, 3, 1, 0, 0), 47, "High"), ((22, 1, 0, 0, 0), 24, "Medium"),
        ((22, 3, 0, 0, 0), 28, "High"), ((65, 1, 0, 1, 0), 70, "High"), ((0, 1, 0, 0, 0), 2, "Low"),
        ((9, 0, 0, 0, 0), 9, "Low"), ((10, 0, 0, 0, 0), 10, "Medium"), ((23, 0, 0, 0, 1), 25, "High"),
    ],
)
def test_score_and_level(spark, tally, score, level):
    row = complexity(counts_frame(spark, tally)).first()
    assert (row.total_score, row.complexity_level) == (score, level)


def scores(spark, before, after, **present):
    df = spark.createDataFrame([(before, after)], "b STRING, a STRING")
    for s in SETS:
        df = df.withColumn(s, F.array(F.lit("x")) if present.get(s) else F.array().cast("array<string>"))
    return tuple(round(x, 1) for x in df.select(*presence_score(F.col("b"), F.col("a"), expected_features())).first())


def test_presence_scores(spark):
    assert scores(spark, "", "") == (50.0, 50.0)
    assert scores(spark, "nothing", "df.join(x)", joins=True) == (0.0, 100.0)
    # "write" without the dot is expected of both, but earned by neither
    assert scores(spark, "def write_it()", "", joins=True) == (0.0, 0.0)
    assert scores(spark, "df.write.csv", "x", columns=True) == (50.0, 0.0)
    assert scores(spark, "df.withColumn(upper(x))", "upper(x)", string_ops=True) == (100.0, 0.0)
    assert scores(spark, "df.withColumn(a*b)", "a*b", calculations=True) == (100.0, 0.0)
    text = "df.join(a).filter(b).select(c).write"
    assert scores(spark, text, text, joins=True, filters=True, columns=True, calculations=True) == (80.0, 80.0)


def test_routing(spark, rows):
    df = spark.createDataFrame([(19.9, True), (20.0, False)], "s DOUBLE, had BOOLEAN")
    assert rows(route_by_score(df, "s", "had")) == [(19.9, True, True, "corrected"), (20.0, False, False, "generated")]


def test_fallback_text_is_json(spark):
    values = ['a "q" \\ b', "line\nend", "\xe9"]
    df = spark.range(1).select(
        F.array(*[F.lit(v) for v in values]).alias("columns"),
        *[F.array().cast("array<string>").alias(s) for s in SETS[1:]],
    )
    text = df.select(fallback_text()).first()[0]
    head = "# Could not generate automatically.\n# Expected elements: "
    want = {"columns": values, **{s: [] for s in SETS[1:]}}
    assert text == head + json.dumps(want, indent=2, ensure_ascii=False) + "\n"


@pytest.fixture
def specs(spark):
    return spark.createDataFrame(
        [("A-1", JOIN_SPEC), ("B", JOB), ("C", JOB), ("a_1", JOB), ("D", BROKEN)], "name STRING, xml STRING"
    )


@pytest.fixture
def programs(spark):
    rows = [
        ("A_1_converted", "x = 1"),
        ("B_converted", "df.filter(a === 1)\n"),
        ("b_corrected", "nothing"),
        ("D", "print('write')"),
        ("unused", "x"),
    ]
    return spark.createDataFrame(rows, "name STRING, code STRING")


def test_pairing_takes_the_last_name(specs, programs):
    got = {r.file: (r.name, r.code, r.had_existing) for r in pair_programs(specs, programs).collect()}
    assert got == {
        "a_1": ("a_1", "x = 1", True), "b": ("B", "nothing", True), "c": ("C", None, False),
        "d": ("D", "print('write')", True),
    }


def test_report(spark, specs, programs, tmp_path):
    report = quality_report(specs.filter("name <> 'a_1'"), programs.filter("name <> 'b_corrected'"))
    got = {r.file: r for r in report.collect()}
    assert {f: (r.action, r.regenerate, round(r.accuracy_before, 1), round(r.accuracy_after, 1)) for f, r in got.items()} == {
        "a_1": ("corrected", True, 0.0, 0.0),
        "b": ("corrected", False, 100.0, 100.0),
        "c": ("generated", True, 0.0, 0.0),
        "d": ("corrected", True, 0.0, 0.0),
    }
    assert got["b"].text_after == "df.filter(a == 1)\n" and got["b"].rules == ["Replace ==="]
    assert got["a_1"].text_after.startswith("# Could not generate") and '"MergeJoin"' in got["a_1"].text_after
    assert [got[f].target for f in "bc"] == ["b_corrected", "c_generated"]
    over = {r.file: r.target for r in quality_report(specs, programs, mode="overwrite").collect()}
    assert (over["b"], over["c"]) == ("b", "c_generated")
    assert tuple(summarise_quality(report).first()) == (4, 25.0, 25.0, 0.0)
    save_texts(report, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("target=*")) == [
        "target=a_1_corrected", "target=b_corrected", "target=c_generated", "target=d_corrected"
    ]
    with pytest.raises(ValueError):
        quality_report(specs, programs, mode="other")


def test_reports_over_folders(spark, tmp_path, rows):
    specs, programs, out = tmp_path / "specs", tmp_path / "programs", tmp_path / "out"
    specs.mkdir(), programs.mkdir()
    (specs / "Big Job 1.xml").write_text(JOIN_SPEC)
    (specs / "small.JOB").write_text(JOB)
    (specs / "notes.txt").write_text("no")
    (programs / "big_job_1_converted.py").write_text("df.join(a === b).select(c)\n")
    at = datetime(2024, 5, 6, 7, 8, 9)
    kinds = ["xml", "job"]
    assert folder_steps(spark, str(specs), kinds).groupBy("file").count().collect() == [("Big Job 1", 7)]
    sizes = run_complexity_report(spark, str(specs), str(out), kinds, at)
    assert rows(sizes.select("file", "total_score", "complexity_level")) == [("big_job_1", 24, "Medium"), ("small", 2, "Low")]
    report, means = run_quality_report(spark, str(specs), str(programs), str(out), kinds, at)
    got = {r.file: (r.action, r.rules, r.accuracy_before, r.accuracy_after) for r in report.collect()}
    assert got == {
        "big_job_1": ("corrected", ["Replace ==="], 40.0, 40.0), "small": ("generated", [NO_CHANGE], 0.0, 0.0)
    }
    assert means.first()[:] == (2, 20.0, 20.0, 0.0)
    written = {p.name: next(p.glob("part-*")).read_text() for p in (out / "texts").glob("target=*")}
    assert written["target=big_job_1_corrected"] == "df.join(a == b).select(c)\n"
    assert written["target=small_generated"].startswith("# Could not generate")
    assert spark.read.option("header", True).csv(str(out / "correction_report_20240506_070809")).count() == 2


def test_overwriting_programs(spark, tmp_path):
    specs, programs, out = tmp_path / "specs", tmp_path / "programs", tmp_path / "out"
    for folder in (specs, programs):
        folder.mkdir()
    (specs / "Big job-1.flow").write_text(JOIN_SPEC)
    (specs / "small.flow").write_text("<t/>")
    (programs / "Big job-1_converted.py").write_text("df.join(a === b)\nx = 1\n")
    (programs / "other.py").write_text("left alone")
    run_quality_report(spark, str(specs), str(programs), str(out), ["flow"], datetime(2024, 5, 6), mode="overwrite")
    assert {p.name: p.read_text() for p in programs.iterdir()} == {
        "Big job-1_converted.py": "df.join(a == b)\nx = 1\n", "other.py": "left alone"
    }
    assert [p.name for p in (out / "texts").glob("target=*")] == ["target=small_generated"]
    rows = spark.read.parquet(str(out / "correction_rows_20240506_000000")).orderBy("file", "seq").collect()
    assert [(r.file, r.action, r.rule, r.before, r.after) for r in rows] == [
        ("big_job_1", "corrected", "HUNK", "", "@@ -1,2 +1,2 @@"), ("big_job_1", "corrected", "DIFF_DELETE", "df.join(a === b)", ""),
        ("big_job_1", "corrected", "DIFF_INSERT", "", "df.join(a == b)"), ("small", "generated", None, None, None),
    ]


def test_documents_of_one_file_of_parts_are_parsed_by_several_tasks(spark, tmp_path):
    columns = ["id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "CAST(id % 50 AS INT) AS p_size"]
    spark.range(200).selectExpr(*columns).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    in_task = part_specs(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(in_task) > 1 and sum(r["count"] for r in in_task) == 200
    assert q_xml_inventory(spark, str(tmp_path)).count() == 2 * sum(k % 11 != 10 for k in range(200))
