import os
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from rillway.operators.token_text import prompt_dataset
from rillway.session import drop_scratch, scratch_path, scratch_root, shuffle_settings
from rillway.sources import replace
from rillway.sources.delimited import (
    output_name, overwrite_source, read_delimited, write_delimited, write_single_file,
)
from rillway.sources.documents import (
    append_jsonl, read_documents, read_text, valid_text, write_documents, write_report, write_text,
)
from rillway.sources.fields import Field, parse_field, strings
from rillway.sources.replace import finish_replacing, replace_files
from rillway.sources.tables import (
    jdbc_query_options, jdbc_table_options, query_with_params, read_query, read_table, write_table,
)


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_fields_are_found_by_name_not_position(spark, tmp_path, rows):
    path = put(tmp_path / "leads.csv", "Index,Phone,Deal Stage,Notes\n1,555,Won,x\n2,556,Lost,y\n")
    df = read_delimited(spark, path, [Field("Deal Stage", trim="both"), Field("Index", "long")])
    assert df.columns == ["Deal Stage", "Index"]
    assert rows(df) == [("Lost", 2), ("Won", 1)]


def test_typed_fields_masks_and_bad_values(spark, tmp_path):
    path = put(
        tmp_path / "a.csv",
        'n,price,day,flag,name\n"1,234",9.50,2024-02-29,true,"  a, b "\nx,"1,000.25",2024-02-30,Y,"say ""hi"""\n,,,,\n',
    )
    fields = [
        Field("n", "long", group=","), Field("price", "double", group=","), Field("day", "date", fmt="yyyy-MM-dd"),
        Field("flag", "boolean"), Field("name", trim="both"),
    ]
    got = [tuple(r) for r in read_delimited(spark, path, fields).collect()]
    assert got == [
        (1234, 9.5, date(2024, 2, 29), True, "a, b"),
        (None, 1000.25, None, None, 'say "hi"'),
        (None, None, None, None, None),
    ]


def test_number_without_group_sign_does_not_take_one(spark):
    df = spark.createDataFrame([("1,234", "3,5", "12.50")], "a STRING, b STRING, c STRING")
    row = df.select(
        parse_field(Field("a", "long"), F.col("a")),
        parse_field(Field("b", "double", decimal=","), F.col("b")),
        parse_field(Field("c", "decimal", precision=10, scale=2), F.col("c")),
    ).first()
    assert tuple(row) == (None, 3.5, Decimal("12.50"))


def test_trim_sides_and_timestamps(spark):
    df = spark.createDataFrame([(" a ", "2024-01-02 03:04")], "s STRING, t STRING")
    row = df.select(
        *[parse_field(Field("s", trim=t), F.col("s")) for t in ("none", "left", "right", "both")],
        parse_field(Field("t", "timestamp", fmt="yyyy-MM-dd HH:mm"), F.col("t")).cast("string"),
    ).first()
    assert tuple(row) == (" a ", "a ", " a", "a", "2024-01-02 03:04:00")


def test_missing_column_and_missing_path(spark, tmp_path):
    path = put(tmp_path / "a.csv", "x\n1\n")
    with pytest.raises(ValueError, match="not in the header"):
        read_delimited(spark, path, strings("y"))
    with pytest.raises(AnalysisException):
        read_delimited(spark, str(tmp_path / "none.csv"), strings("x"))
    empty = read_delimited(spark, str(tmp_path / "none.csv"), [Field("x", "long")], required=False)
    assert empty.dtypes == [("x", "bigint")] and empty.count() == 0


def test_headerless_separator_mask_exclusion_and_subfolders(spark, tmp_path, rows):
    put(tmp_path / "in/a.csv", "1|x\n")
    put(tmp_path / "in/b _old.csv", "2|y\n")
    put(tmp_path / "in/c.txt", "3|z\n")
    put(tmp_path / "in/deep/d.csv", "4|w\n")
    fields = [Field("k", "long"), Field("v")]
    options = dict(sep="|", header=False, glob="*.csv", exclude="b _old.csv")
    assert rows(read_delimited(spark, str(tmp_path / "in"), fields, **options)) == [(1, "x")]
    deep = read_delimited(spark, str(tmp_path / "in"), fields, recursive=True, **options)
    assert rows(deep) == [(1, "x"), (4, "w")]


def test_line_break_inside_quotes(spark, tmp_path, rows):
    path = put(tmp_path / "a.csv", 'k,v\n1,"a\nb"\n')
    assert rows(read_delimited(spark, path, [Field("k", "long"), Field("v")], multiline=True)) == [(1, "a\nb")]


def test_write_append_overwrite_and_read_back(spark, tmp_path, rows):
    path = str(tmp_path / "new" / "out")
    df = spark.createDataFrame([(1, 'q"uo,te', date(2024, 5, 6)), (2, " padded ", None)], "k LONG, v STRING, d DATE")
    fields = [Field("k", "long"), Field("v"), Field("d", "date")]
    write_delimited(df, path)
    assert rows(read_delimited(spark, path, fields)) == rows(df)
    write_delimited(df, path, append=True)
    assert read_delimited(spark, path, fields).count() == 4
    write_delimited(df, path)
    assert read_delimited(spark, path, fields).count() == 2


def test_partitioned_and_single_file_output(spark, tmp_path):
    df = spark.range(10).withColumn("part", F.col("id") % 2)
    write_delimited(df, str(tmp_path / "p"), partition_by=["part"])
    assert sorted(p.name for p in (tmp_path / "p").glob("part=*")) == ["part=0", "part=1"]
    write_single_file(df.repartition(4), str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("part-*.csv"))) == 1


def test_every_value_comes_back(spark, tmp_path, rows):
    values = ["a\nb", "c\rd", "e\r\nf", "", None, '"', '","', "\\", "\\n", " x ", "\t", '""', "\n", "é\u2028z", "'", "#", "null"]
    df = spark.createDataFrame(list(enumerate(values)), "k LONG, v STRING").withColumn("w", F.col("v"))
    path = str(tmp_path / "all")
    write_delimited(df.repartition(3), path)
    fields = [Field("k", "long"), Field("v", trim="none"), Field("w", trim="none")]
    assert rows(read_delimited(spark, path, fields, empty_text=True)) == rows(df)
    as_null = rows(df.replace("", None))
    assert rows(read_delimited(spark, path, fields)) == as_null


def test_each_file_has_its_own_header(spark, tmp_path, rows):
    put(tmp_path / "in" / "a.csv", "id,name\n1,x\n")
    put(tmp_path / "in" / "b.csv", "name,extra,id\ny,?,2\n")
    put(tmp_path / "in" / "c.csv", "id,name\n3,z\n")
    put(tmp_path / "in" / "d.csv", "")
    df = read_delimited(spark, str(tmp_path / "in"), [Field("id", "long"), Field("name")])
    assert rows(df) == [(1, "x"), (2, "y"), (3, "z")]
    only = read_delimited(spark, str(tmp_path / "in"), [Field("id", "long")], exclude="b.csv")
    assert rows(only) == [(1,), (3,)]


def test_excluded_files_are_not_opened(spark, tmp_path, rows):
    put(tmp_path / "in" / "a.csv", "id,name\n1,x\n")
    put(tmp_path / "in" / "ab.csv", "id\n2\n")
    put(tmp_path / "in" / "b 1.csv", "other\nq\n")
    os.chmod(tmp_path / "in" / "b 1.csv", 0)
    fields = [Field("id", "long")]
    assert rows(read_delimited(spark, str(tmp_path / "in"), fields, exclude="b*.csv")) == [(1,), (2,)]
    assert rows(read_delimited(spark, str(tmp_path / "in"), fields, exclude="*")) == []
    plain = read_delimited(spark, str(tmp_path / "in"), [Field("id")], exclude="*b*", header=False)
    assert rows(plain) == [("1",), ("id",)]


def test_excluded_files_are_not_opened_for_their_fields(spark, tmp_path, rows):
    """Whoever runs this: a file that is no archive fails when it is opened, also for the superuser."""
    put(tmp_path / "in" / "b.csv.gz", "no archive")
    assert rows(read_delimited(spark, str(tmp_path / "in"), [Field("id")], exclude="b*")) == []
    put(tmp_path / "in" / "c.csv", "id\n3\n")
    assert rows(read_delimited(spark, str(tmp_path / "in"), [Field("id")], exclude="b*")) == [("3",)]
    assert rows(read_delimited(spark, str(tmp_path / "in"), [Field("id")], exclude="z*", glob="c*")) == [("3",)]
    assert rows(read_delimited(spark, str(tmp_path / "none"), [Field("id")], exclude="z*", required=False)) == []


def folder_texts(folder):
    return {p.name: p.read_text() for p in folder.iterdir() if not p.name.startswith(".")}


@pytest.fixture
def programs(tmp_path):
    texts = {f"p {i}.py": f"old {i}\n" for i in range(5)} | {"007": "old\n"}
    for name, text in texts.items():
        put(tmp_path / "programs" / name, text)
    return tmp_path / "programs"


def test_files_are_replaced_by_what_was_read_from_them(spark, programs):
    read = read_documents(spark, str(programs), ["py"]).withColumn("text", F.concat("text", F.lit("new\n")))
    more = spark.createDataFrame([("007", "bond\n"), ("made now é.py", "x")], "name STRING, text STRING")
    replace_files(read.select("name", "text").unionByName(more), str(programs), "name", "text")
    want = {f"p {i}.py": f"old {i}\nnew\n" for i in range(5)} | {"007": "bond\n", "made now é.py": "x\n"}
    assert folder_texts(programs) == want
    # A later edit by hand can be read: no checksum of the written text is left.
    (programs / "p 0.py").write_text("by hand")
    assert read_documents(spark, str(programs), ["py"]).filter("name = 'p 0.py'").first().text == "by hand"


def test_a_stop_between_moves_loses_nothing(spark, programs, monkeypatch):
    new = spark.createDataFrame([(f"p {i}.py", f"new {i}\n") for i in range(5)], "name STRING, text STRING")
    moved, move = [], replace._move

    def stops(spark, source, target):
        if len(moved) == 2:
            raise OSError("stopped")
        moved.append(target.getName())
        move(spark, source, target)

    monkeypatch.setattr(replace, "_move", stops)
    with pytest.raises(OSError, match="stopped"):
        replace_files(new, str(programs), "name", "text")
    texts = folder_texts_of_files(programs)
    assert [texts[f"p {i}.py"].startswith("new") for i in range(5)].count(True) == 2 and set(texts.values()) <= {
        f"{age} {i}\n" for i in range(5) for age in ("old", "new")
    } | {"old\n"}
    # What waits there is no document.
    assert read_documents(spark, str(programs), ["py", "txt"], recursive=True).count() == 5
    monkeypatch.setattr(replace, "_move", move)
    assert finish_replacing(spark, str(programs)) and not finish_replacing(spark, str(programs))
    assert folder_texts(programs) == {f"p {i}.py": f"new {i}\n" for i in range(5)} | {"007": "old\n"}


def folder_texts_of_files(folder):
    return {p.name: p.read_text() for p in folder.iterdir() if p.is_file() and not p.name.startswith(".")}


def test_a_stop_before_the_decision_changes_nothing(spark, programs, monkeypatch):
    before = folder_texts(programs)
    bad = spark.createDataFrame([("p 0.py", "new\n")], "name STRING, text STRING")
    written = replace.write_documents

    def stops(*args):
        written(*args)
        raise OSError("stopped")

    monkeypatch.setattr(replace, "write_documents", stops)
    with pytest.raises(OSError, match="stopped"):
        replace_files(bad, str(programs), "name", "text")
    assert folder_texts_of_files(programs) == before
    assert not finish_replacing(spark, str(programs)) and folder_texts(programs) == before


def test_overwriting_the_source(spark, tmp_path, rows):
    path = str(tmp_path / "data")
    write_delimited(spark.range(5), path)
    fields = [Field("id", "long")]
    overwrite_source(read_delimited(spark, path, fields).filter("id > 2"), path)
    assert rows(read_delimited(spark, path, fields)) == [(3,), (4,)]


def test_output_names():
    at = datetime(2024, 1, 2, 3, 4, 5)
    assert output_name("out") == "out"
    assert output_name("out", extension="csv", add_date=True, add_time=True, part=3, at=at) == "out_20240102_030405_3.csv"
    with pytest.raises(ValueError):
        output_name("out", add_date=True)


def test_documents_by_extension_in_any_case(spark, tmp_path, rows):
    put(tmp_path / "d/A b+c%20.job", "one\ntwo\n")
    put(tmp_path / "d/c.FLOW", "three")
    put(tmp_path / "d/e.py", "no")
    got = rows(read_documents(spark, str(tmp_path / "d"), [".job", "flow"]))
    assert got == [("A b+c%20.job", "A b+c%20", "job", "one\ntwo\n"), ("c.FLOW", "c", "flow", "three")]


@pytest.mark.parametrize(
    "raw",
    [b"plain", b"a\xffb", "ok \ufffd kept".encode(), "x\ufffd".encode() + b"\xc3(", b"\xe2\x82", b"", "\ufdd0\xe9".encode()],
)
def test_undecodable_bytes_are_dropped(spark, raw):
    df = spark.createDataFrame([(bytearray(raw),)], "content BINARY")
    assert df.select(valid_text(F.col("content"))).first()[0] == raw.decode("utf-8", errors="ignore")


def test_one_file_per_document(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", "x\ny\n"), ("b", "z")], "name STRING, text STRING")
    write_documents(df, str(tmp_path / "docs"), "name", "text")
    back = read_documents(spark, str(tmp_path / "docs"), ["txt"], recursive=True)
    assert sorted(r.text for r in back.collect()) == ["x\ny\n", "z\n"]


def test_text_json_and_report_sinks(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, None), (2, "b")], "k INT, v STRING")
    write_text(df, str(tmp_path / "t"), sep="|")
    write_text(df, str(tmp_path / "t"), sep="|", append=True)
    assert rows(read_text(spark, str(tmp_path / "t"))) == [("1|",), ("1|",), ("2|b",), ("2|b",)]
    pairs = spark.createDataFrame([(" Hi ", "YES"), (" ", "no"), (None, "no")], "p STRING, c STRING")
    append_jsonl(prompt_dataset(pairs, "p", "c"), str(tmp_path / "j"))
    append_jsonl(prompt_dataset(pairs, "p", "c"), str(tmp_path / "j"))
    assert rows(spark.read.json(str(tmp_path / "j")).select("prompt", "completion")) == [("hi", "yes")] * 2
    path = write_report(df, str(tmp_path), "correction_report", datetime(2024, 1, 2, 3, 4, 5))
    assert path.endswith("/correction_report_20240102_030405")
    assert spark.read.option("header", True).csv(path).count() == 2
    assert spark.read.parquet(write_report(df, str(tmp_path), "r", datetime(2024, 1, 1), fmt="parquet")).count() == 2


def test_catalog_table_and_parameters(spark, rows):
    spark.range(5).selectExpr("id", "id * 2 AS `two times`").createOrReplaceTempView("numbers_view")
    assert read_table(spark, "numbers_view", ["two times"]).columns == ["two times"]
    assert read_table(spark, "numbers_view").columns == ["id", "two times"]
    assert rows(query_with_params(spark, "SELECT id FROM numbers_view WHERE id > :low", low=3)) == [(4,)]


def test_jdbc_options():
    url = "jdbc:x:y"
    assert jdbc_query_options(url, "SELECT 1", limit=5)["query"] == "SELECT * FROM (SELECT 1) src FETCH FIRST 5 ROWS ONLY"
    with pytest.raises(ValueError, match="partition column"):
        jdbc_query_options(url, "SELECT 1")
    parted = jdbc_query_options(url, "SELECT id FROM t", partition_column="id", lower=0, upper=9, partitions=3)
    assert parted["dbtable"] == "(SELECT id FROM t) src" and parted["numPartitions"] == "3" and "query" not in parted
    with pytest.raises(ValueError):
        jdbc_query_options(url, "SELECT id FROM t", partition_column="id")
    with pytest.raises(ValueError):
        jdbc_query_options(url, "SELECT id FROM t", limit=5, partition_column="id", lower=0, upper=9, partitions=3)
    assert jdbc_table_options(url, "t") == {"url": url, "dbtable": "t", "batchsize": "1000", "truncate": "false"}


class Recorder:
    """Stands in for a reader or writer and records what it is told; no database is opened."""

    def __init__(self):
        self.calls = []

    def __getattr__(self, name):
        def call(*args, **kwargs):
            self.calls.append((name, args, kwargs))
            return self

        return call


def test_jdbc_reader_and_writer_calls():
    class Session:
        read = Recorder()

    read_query(Session, "jdbc:x", "SELECT 1", limit=7)
    assert [c[0] for c in Session.read.calls] == ["format", "options", "load"]

    class Frame:
        write = Recorder()

    write_table(Frame, "jdbc:x", "t")
    write_table(Frame, "jdbc:x", "t", truncate=True)
    modes = [args for name, args, _ in Frame.write.calls if name == "mode"]
    assert modes == [("append",), ("overwrite",)]


def test_scratch_is_in_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second
    if root:
        assert first.startswith(root)


def test_scratch_is_dropped_on_request(spark):
    other = spark.newSession()
    path = scratch_path(other, "y")
    other.range(3).write.parquet(path)
    assert path.startswith(scratch_root(spark)) and other.read.parquet(path).count() == 3
    drop_scratch(other)
    with pytest.raises(AnalysisException):
        other.read.parquet(path)


def test_shuffle_settings():
    key = "spark.sql.shuffle.partitions"
    assert shuffle_settings(0, cores=4)[key] == "4"
    assert shuffle_settings(10 * 2**40)[key] == "40960"


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        @staticmethod
        def get(key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Session, "x")
