import random

import pytest
from pyspark.sql import functions as F

from rillway.functions.numbers import calc_round, literal, money, round_to_long, safe_divide, stamp_text, years_since
from rillway.operators.aggregates import (
    agg_text, attach_groups, avg_of, compare_means, count_rows, count_values, group_by, group_stats, sum_of,
)
from rillway.operators.joins import equi_join, hot_keys, pair_by_stem, pair_documents, salted_join
from rillway.operators.line_sets import line_multiset_diff, union_rows
from rillway.operators.ordering import latest_per_key, rank_rows, running_totals, sort_rows, take_rows, top_rows
from rillway.operators.rows import (
    above, all_of, any_of, equals, inline_rows, negate, passes, select_fields, split_rows, where,
)


@pytest.fixture
def people(spark):
    return spark.createDataFrame(
        [(1, "abc", 5, True), (2, "ABC", 6, True), (3, None, 7, False), (4, "b.d", None, None)],
        "id INT, `full name` STRING, n INT, ok BOOLEAN",
    )


def test_select_rename_keep_rest(people):
    assert select_fields(people, ["n", "id"]).columns == ["n", "id"]
    assert select_fields(people, {"full name": "name"}).columns == ["name"]
    assert select_fields(people, {"full name": "name"}, keep_rest=True).columns == ["name", "id", "n", "ok"]


def test_filters_are_strict_and_null_is_not_true(people):
    ids = lambda c: sorted(r.id for r in where(people, c).collect())
    assert ids(above("n", 5)) == [2, 3]
    assert ids(equals("full name", "abc")) == [1]
    assert ids(equals("ok", True)) == [1, 2]
    assert ids(all_of(above("n", 5), equals("ok", True))) == [2]
    assert ids(all_of(above("n", 4), any_of(equals("id", 1), equals("id", 3)))) == [1, 3]
    assert ids(negate(equals("full name", "abc"))) == [2, 4]
    assert ids("n = 7 AND NOT ok") == [3]


def test_split_keeps_every_row(people):
    yes, no = split_rows(people, above("n", 5))
    assert sorted(r.id for r in yes.collect()) == [2, 3]
    assert sorted(r.id for r in no.collect()) == [1, 4]
    flags = {r.id: r.f for r in people.select("id", passes(above("n", 5)).alias("f")).collect()}
    assert flags == {1: False, 2: True, 3: True, 4: False}


def test_limit_zero_means_all(people):
    assert take_rows(people, 0).count() == 4
    assert take_rows(people, 3).count() == 3


def test_large_limits_stay_distributed(spark):
    df = spark.range(0, 300_000, 1, 6)
    taken = take_rows(df, 150_001)
    assert taken.count() == 150_001 and taken.distinct().count() == 150_001
    assert "SinglePartition" not in taken._jdf.queryExecution().optimizedPlan().toString()
    top = top_rows(df, [("id", "desc")], 120_000)
    assert top.agg(F.min("id"), F.max("id"), F.count("id")).first()[:] == (180_000, 299_999, 120_000)
    assert top.columns == ["id"] and top.first().id == 299_999


def test_inline_rows_and_literals(spark):
    assert inline_rows(spark, [("a", 1)], "k STRING, v INT").first().v == 1
    row = spark.range(1).select(
        literal("5,000", "bigint", group=","), literal("x", "int", is_null=True), literal("1.50", "decimal(5,2)")
    ).first()
    assert [str(x) for x in row] == ["5000", "None", "1.50"]


def test_numbers(spark):
    df = spark.createDataFrame([(2.5, 0.0), (-2.5, 2.0), (None, 1.0)], "a DOUBLE, b DOUBLE")
    got = [tuple(r) for r in df.select(round_to_long(F.col("a")), safe_divide(F.col("a"), F.col("b"))).collect()]
    assert got == [(3, None), (-3, -1.25), (None, None)]
    assert calc_round(df, "a", "r").columns == ["a", "b", "r"]
    assert [r.r for r in calc_round(df, "a", "r", up=True).collect()] == [3, -2, None]
    assert spark.range(1).select(years_since(F.lit(1990))).first()[0] == 35
    assert spark.range(1).select(stamp_text(F.lit("2024-01-02 03:04:05").cast("timestamp"))).first()[0] == "20240102_030405"
    assert str(spark.range(1).select(money(F.lit(1234.5))).first()[0]) == "1234.50"


def test_join_keeps_both_sides_and_renames(spark):
    left = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "id INT, name STRING")
    right = spark.createDataFrame([(1, "A"), (1, "B"), (None, "N")], "Index INT, Name STRING")
    joined = equi_join(left, right, [("id", "Index")])
    assert joined.columns == ["id", "name", "Index", "Name_r"]
    assert joined.count() == 4
    assert equi_join(left, left, "id").columns == ["id", "name", "id_r", "name_r"]


def test_chained_joins_keep_names_apart(spark):
    one = spark.createDataFrame([(1, "a")], "k INT, v STRING")
    twice = equi_join(one, one, "k")
    thrice = equi_join(twice, one.withColumn("v_r", F.lit(0)), [("k_r", "k")])
    assert thrice.columns == ["k", "v", "k_r", "v_r", "k_r_r", "v_r_r", "v_r_r_r"]
    assert thrice.first()[:] == (1, "a", 1, "a", 1, "a", 0)


def test_join_letter_case(spark):
    left = spark.createDataFrame([("Acme",)], "Company STRING")
    right = spark.createDataFrame([("ACME",)], "Name STRING")
    assert equi_join(left, right, [("Company", "Name")]).count() == 0
    assert equi_join(left, right, [("Company", "Name")], case_sensitive=False).count() == 1


def test_pairing_flags_unmatched_rows(spark, rows):
    left = spark.createDataFrame([("Report-1", "x"), ("b", "y")], "stem STRING, xml STRING")
    right = spark.createDataFrame([("REPORT_1_converted", "code")], "stem STRING, code STRING")
    paired = pair_by_stem(left, right).select("stem", "code", "had_existing")
    assert rows(paired) == [("b", None, False), ("report_1", "code", True)]
    assert pair_documents(left, right, "stem").filter("had_existing").count() == 0


def test_salts_spread_equal_rows_and_rows_without_a_key(spark):
    left = spark.range(0, 10_000, 1, 2).select(F.when(F.col("id") % 2 == 0, 1).alias("k"), F.lit("same").alias("v"))
    right = spark.createDataFrame([(1, "r")], "k INT, w STRING")
    joined = salted_join(left, right, "k", "left", share=0.1, copies=16)
    assert joined.count() == 10_000 and joined.filter("w = 'r'").count() == 5_000
    with pytest.raises(ValueError, match="share"):
        salted_join(left, right, "k", share=0)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, rows, how):
    rng = random.Random(7)
    # One key holds a third of the rows, some of them alike; some keys have no or several partners.
    keys = [0] * 400 + [rng.randrange(1, 60) for _ in range(780)] + [None] * 20
    left = spark.createDataFrame([(k, i % 50) for i, k in enumerate(keys)], "k INT, v INT")
    right = spark.createDataFrame([(k, k * 10) for k in range(40)] + [(0, -1), (5, -2)], "k INT, w INT")
    plain = equi_join(left, right, "k", how)
    salted = salted_join(left, right, "k", how, share=0.1, copies=7)
    assert salted.columns == plain.columns
    assert rows(salted) == rows(plain)
    assert rows(hot_keys(left, ["k"], 0.1)) == [(0,)]


def test_grouping_and_nulls(spark, rows):
    df = spark.createDataFrame([("a", 1.10), ("a", None), (None, 2.20), ("b", 3.30)], "k STRING, v DOUBLE")
    got = group_by(
        df, "k",
        [count_rows("n"), count_values("v", "nn"), sum_of("v", "s", amount=True), avg_of("v", "a", amount=True),
         agg_text("max(v)", "m")],
    )
    assert rows(got) == [("a", 2, 1, 1.1, 1.1, 1.1), ("b", 1, 1, 3.3, 3.3, 3.3), (None, 1, 1, 2.2, 2.2, 2.2)]
    stats = group_stats(df, "k", "v", count="c", average="a", total="t")
    assert stats.columns == ["k", "c", "a", "t"]
    assert group_by(df, ["k", "v"], [count_rows("n")]).count() == 4
    attached = attach_groups(df, ["k"], [count_rows("n")])
    assert rows(attached) == [("a", 1.1, 2), ("a", None, 2), ("b", 3.3, 1), (None, 2.2, 1)]


def test_means(spark):
    df = spark.createDataFrame([(0.0, 50.0), (50.0, 100.0)], "b DOUBLE, a DOUBLE")
    assert tuple(compare_means(df, "b", "a").first()) == (2, 25.0, 75.0, 50.0)
    assert tuple(compare_means(df.limit(0), "b", "a").first()) == (0, None, None, None)


def test_sorting(people):
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(sort_rows(people, [("full name", "desc"), "id"])) == [4, 1, 2, 3]
    assert ids(sort_rows(people, ["full name", ("id", "desc")], case_sensitive=False)) == [3, 2, 1, 4]
    assert ids(top_rows(people, [("n", "desc")], 2)) == [3, 2]


def test_equal_keys_spread_over_ranges_and_ties_are_settled(spark):
    df = spark.range(0, 200_000, 1, 4).withColumn("k", F.lit(7))
    top = [[r.id for r in top_rows(df.repartition(p), ["k"], n).collect()] for p in (3, 5) for n in (10, 150_000)]
    assert top[0] == top[2] and top[1] == top[3] and top[1][:10] == top[0]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = rank_rows(df, ["k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranked.select("rn").distinct().count() == 200_000
    assert len(ranked.inputFiles()) > 4


@pytest.mark.parametrize("within", [(), ("g",)])
def test_ranks_equal_brute_force_with_a_hot_group(spark, within):
    rng = random.Random(3)
    data = [("hot" if i % 3 == 0 else rng.choice(["a", "b", None]), rng.randrange(20), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g STRING, v INT, id INT").repartition(7)
    got = rank_rows(df, [("v", "desc"), "id"], within=within, count_out="total")
    assert got.columns == ["g", "v", "id", "rn", "total"]
    ordered = sorted(data, key=lambda r: (-r[1], r[2]))
    counts, want = {}, set()
    for g, v, i in ordered:
        key = g if within else None
        counts[key] = counts.get(key, 0) + 1
        want.add((g, v, i, counts[key]))
    totals = {k: n for k, n in counts.items()}
    assert {tuple(r) for r in got.collect()} == {(g, v, i, rn, totals[g if within else None]) for g, v, i, rn in want}
    assert got.count() == len(data)


def test_ranks_of_text_and_of_nothing(spark):
    df = spark.createDataFrame([("b",), ("A",), ("c",)], "s STRING")
    assert {r.s: r.rn for r in rank_rows(df, ["s"], case_sensitive=False).collect()} == {"A": 1, "b": 2, "c": 3}
    assert rank_rows(df.limit(0), ["s"]).count() == 0


def test_last_row_per_key(spark, rows):
    df = spark.createDataFrame([("k", "a", 1), ("k", "b", 2), ("j", "a", 3), (None, "z", 4)], "k STRING, o STRING, v INT")
    latest = latest_per_key(df, "k", ["o"])
    assert latest.columns == ["k", "o", "v"]
    assert rows(latest) == [("j", "a", 3), ("k", "b", 2), (None, "z", 4)]


def test_union_and_line_differences(spark, rows):
    a = spark.createDataFrame([(1, "x")], "k INT, v STRING")
    b = spark.createDataFrame([("y", 2)], "v STRING, k INT")
    assert rows(union_rows(a, b)) == [(1, "x"), (2, "y")]
    texts = spark.createDataFrame([(1, "a\na\nb", "a\nb\nc"), (2, "s", "s"), (3, "", "z")], "k INT, b STRING, a STRING")
    diff = line_multiset_diff(texts, "k", F.split("b", "\n"), F.split("a", "\n"))
    assert rows(diff) == [
        (1, "DIFF_DELETE", "a", 1), (1, "DIFF_INSERT", "c", 1), (3, "DIFF_DELETE", "", 1), (3, "DIFF_INSERT", "z", 1),
    ]


def test_running_totals_equal_sums_in_order(spark):
    rng = random.Random(7)
    table = [(i, rng.choice("aab") if i % 9 else None, rng.choice([None, 1, 2, 3]), i % 50) for i in range(3000)]
    df = spark.createDataFrame(table, "id INT, g STRING, v INT, k INT").repartition(7)
    totals = {"s": F.col("v"), "n": F.lit(1)}
    for within in ((), ("g",)):
        got = {r.id: (r.s, r.n) for r in running_totals(df, ["k", ("id", "desc")], totals, within=within).collect()}
        sums = {}
        for i, g, v, k in sorted(table, key=lambda r: (r[3], -r[0])):
            s, n = sums.get(g if within else 0, (0, 0))
            sums[g if within else 0] = (s + (v or 0), n + 1)
            assert got[i] == sums[g if within else 0]
    assert running_totals(df.limit(0), ["id"], totals).collect() == []


def test_latest_per_key_takes_any_columns(spark):
    rows = [(None, 1, {"a": 1}, "x"), (None, 2, {"a": 2}, "y"), (1, None, {"b": 1}, "z"), (1, None, {"b": 1}, "z"), (2, 5, None, "t"), (2, 5, None, "s")]
    df = spark.createDataFrame(rows, "k INT, o INT, m MAP<STRING, INT>, t STRING")
    got = sorted((tuple(r) for r in latest_per_key(df, "k", ["o"]).collect()), key=repr)
    assert got[0] == (1, None, {"b": 1}, "z") and got[1][:3] == (2, 5, None) and got[2:] == [(None, 2, {"a": 2}, "y")]
    assert latest_per_key(df, ["k", "t"], ["o"]).columns == df.columns
