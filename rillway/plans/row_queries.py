"""Queries of the row operators: projection, filters, joins, groups, order, numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.functions.numbers import calc_round, literal, money, safe_divide, stamp_text, years_since
from rillway.operators.aggregates import agg_text, attach_groups, avg_of, count_rows, group_by, group_stats, sum_of
from rillway.operators.joins import equi_join, pair_documents, salted_join
from rillway.operators.ordering import latest_per_key, rank_rows, running_totals, take_rows, top_rows
from rillway.operators.rows import (
    above, all_of, any_of, equals, negate, passes, select_fields, split_rows, where,
)
from rillway.plans.registry import query, table
from rillway.plans.workload_queries import SITE_COLUMNS, SITES_SQL, order_site_rows


@query("SELECT c_name, c_custkey, c_mktsegment FROM customer")
def q_select_fields(spark: SparkSession, d: str) -> DataFrame:
    return select_fields(table(spark, d, "customer"), ["c_name", "c_custkey", "c_mktsegment"])


@query("SELECT c_name AS name, c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_select_rename(spark: SparkSession, d: str) -> DataFrame:
    return select_fields(table(spark, d, "customer"), {"c_name": "name"}, keep_rest=True)


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def q_drop_column(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").drop("c_acctbal")


@query("SELECT CAST(c_custkey AS VARCHAR) AS key_text, c_name FROM customer")
def q_select_expr(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr("CAST(c_custkey AS STRING) AS key_text", "c_name")


_ORDER = "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE "
_ORDER_COLS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _orders(spark: SparkSession, d: str, condition) -> DataFrame:
    return select_fields(where(table(spark, d, "orders"), condition), _ORDER_COLS)


@query(_ORDER + "o_orderstatus = 'F'")
def q_filter_eq(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d, equals("o_orderstatus", "F"))


@query(_ORDER + "o_totalprice > 250000")
def q_filter_gt(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d, above("o_totalprice", 250000))


@query(
    "SELECT o_orderkey, o_totalprice, o_orderstatus = 'F' AS finished FROM orders"
    " WHERE o_totalprice > 250000 AND (o_orderstatus = 'F') = true"
)
def q_filter_and(spark: SparkSession, d: str) -> DataFrame:
    flagged = table(spark, d, "orders").withColumn("finished", F.col("o_orderstatus") == "F")
    kept = where(flagged, all_of(above("o_totalprice", 250000), equals("finished", True)))
    return select_fields(kept, ["o_orderkey", "o_totalprice", "finished"])


@query(_ORDER + "(o_orderstatus = 'F' AND (o_orderpriority = '1-URGENT' OR o_totalprice > 400000))")
def q_filter_nested(spark: SparkSession, d: str) -> DataFrame:
    urgent_or_large = any_of(equals("o_orderpriority", "1-URGENT"), above("o_totalprice", 400000))
    return _orders(spark, d, all_of(equals("o_orderstatus", "F"), urgent_or_large))


@query("SELECT o_orderkey FROM orders WHERE NOT (nullif(o_orderstatus, 'P') = 'F')")
def q_filter_not(spark: SparkSession, d: str) -> DataFrame:
    """A negated condition drops rows for which it is unknown."""
    status = table(spark, d, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    return select_fields(where(status, negate(equals("status", "F"))), ["o_orderkey"])


@query(_ORDER + "o_orderstatus = 'P'")
def q_filter_sql(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d, "o_orderstatus = 'P'")


@query(
    """
    SELECT CASE WHEN nullif(c_nationkey, 3) > 10 THEN 'true' ELSE 'false' END AS route, CAST(count(*) AS BIGINT) AS n
    FROM customer GROUP BY 1
    """
)
def q_route_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows with an unknown condition go to the false side."""
    customer = table(spark, d, "customer").withColumn("key", F.nullif("c_nationkey", F.lit(3)))
    yes, no = split_rows(customer, above("key", 10))
    routed = yes.withColumn("route", F.lit("true")).unionByName(no.withColumn("route", F.lit("false")))
    return group_by(routed, "route", [count_rows("n")])


@query("SELECT p_partkey, p_brand = 'Brand#2' AS is_brand, length(p_name) > 9 AS is_long FROM part")
def q_flag_column(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey",
        passes(equals("p_brand", "Brand#2")).alias("is_brand"),
        passes(F.char_length("p_name") > 9).alias("is_long"),
    )


@query("SELECT c_custkey, c_name, p_partkey, p_name FROM customer JOIN part ON c_custkey = p_partkey")
def q_join_inner(spark: SparkSession, d: str) -> DataFrame:
    customer = select_fields(table(spark, d, "customer"), ["c_custkey", "c_name"])
    part = select_fields(table(spark, d, "part"), ["p_partkey", "p_name"])
    return equi_join(customer, part, [("c_custkey", "p_partkey")])


@query(
    """
    SELECT o.o_orderkey AS k, o.o_totalprice, l.k AS k_r, l.n
    FROM orders o JOIN (SELECT l_orderkey AS k, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1) l
      ON o.o_orderkey = l.k
    """
)
def q_join_same_key(spark: SparkSession, d: str) -> DataFrame:
    orders = select_fields(table(spark, d, "orders"), {"o_orderkey": "k", "o_totalprice": "o_totalprice"})
    lines = group_by(select_fields(table(spark, d, "lineitem"), {"l_orderkey": "k"}), "k", [count_rows("n")])
    return equi_join(orders, lines, "k")


@query(
    """
    SELECT s.o, s.s, s.quantity, r.o AS o_r, r.s AS s_r, r.returned
    FROM (SELECT l_orderkey AS o, l_suppkey AS s, CAST(sum(l_quantity) AS DOUBLE) AS quantity
          FROM lineitem GROUP BY 1, 2) s
    JOIN (SELECT l_orderkey AS o, l_suppkey AS s, CAST(count(*) AS BIGINT) AS returned
          FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) r ON s.o = r.o AND s.s = r.s
    """
)
def q_join_composite(spark: SparkSession, d: str) -> DataFrame:
    lines = select_fields(
        table(spark, d, "lineitem"),
        {"l_orderkey": "o", "l_suppkey": "s", "l_quantity": "l_quantity", "l_returnflag": "l_returnflag"},
    )
    sums = group_by(lines, ["o", "s"], [sum_of("l_quantity", "quantity")])
    returned = group_by(where(lines, equals("l_returnflag", "R")), ["o", "s"], [count_rows("returned")])
    return equi_join(sums, returned, ["o", "s"])


@query(
    """
    SELECT c.c_custkey, n.n_name, r.r_name FROM customer c
    JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
    """
)
def q_join_chain(spark: SparkSession, d: str) -> DataFrame:
    placed = equi_join(table(spark, d, "customer"), table(spark, d, "nation"), [("c_nationkey", "n_nationkey")])
    chained = equi_join(placed, table(spark, d, "region"), [("n_regionkey", "r_regionkey")])
    return select_fields(chained, ["c_custkey", "n_name", "r_name"])


@query(
    """
    SELECT cur.c_custkey, cur.c_acctbal, best.top_balance, cur.c_acctbal = best.top_balance AS is_top
    FROM customer cur JOIN (SELECT c_nationkey, max(c_acctbal) AS top_balance FROM customer GROUP BY 1) best
      ON cur.c_nationkey = best.c_nationkey
    """
)
def q_join_self_alias(spark: SparkSession, d: str) -> DataFrame:
    """A table joined with its own groups, the two told apart by alias."""
    customer = table(spark, d, "customer")
    best = group_by(customer, "c_nationkey", [F.max("c_acctbal").alias("top_balance")]).alias("best")
    current = customer.alias("cur")
    joined = current.join(best, F.col("cur.c_nationkey") == F.col("best.c_nationkey"))
    return joined.select(
        "cur.c_custkey", "cur.c_acctbal", "best.top_balance",
        (F.col("cur.c_acctbal") == F.col("best.top_balance")).alias("is_top"),
    )


@query(
    """
    SELECT o.o_orderstatus, CAST(count(*) AS BIGINT) AS n,
           CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1
    """
)
def q_join_salted(spark: SparkSession, d: str) -> DataFrame:
    """Orders with more than a thousandth of the lines, if there are any, are split by salt."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_suppkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    joined = salted_join(lines, orders, [("l_orderkey", "o_orderkey")], share=0.001, copies=8)
    return group_by(joined, "o_orderstatus", [count_rows("n"), sum_of("l_extendedprice", "price", amount=True)])


@query(SITES_SQL)
def q_wide_join(spark: SparkSession, d: str) -> DataFrame:
    return order_site_rows(spark, d).toDF(*SITE_COLUMNS)


@query(
    """
    SELECT o.o_custkey, CAST(sum(l.l_quantity) AS DOUBLE) AS quantity, CAST(count(*) AS BIGINT) AS n_lines
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1
    """
)
def q_lines_by_customer(spark: SparkSession, d: str) -> DataFrame:
    lines = select_fields(table(spark, d, "lineitem"), ["l_orderkey", "l_quantity"])
    orders = select_fields(table(spark, d, "orders"), ["o_orderkey", "o_custkey"])
    joined = equi_join(lines, orders, [("l_orderkey", "o_orderkey")])
    return group_by(joined, "o_custkey", [agg_text("SUM(l_quantity)", "quantity"), count_rows("n_lines")])


@query(
    """
    SELECT d.doc_id, d.lang, l.quality, l.toxic, l.doc_id IS NOT NULL AS had_existing
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """
)
def q_pair_documents(spark: SparkSession, d: str) -> DataFrame:
    documents = select_fields(table(spark, d, "documents"), ["doc_id", "lang"])
    return pair_documents(documents, table(spark, d, "labels"), "doc_id").drop("doc_id_r")


@query("SELECT p_type, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_type")
def q_group_count(spark: SparkSession, d: str) -> DataFrame:
    return group_by(table(spark, d, "part"), "p_type", [count_rows("n")])


@query(
    """
    SELECT p_brand, n, row_number() OVER (ORDER BY n DESC, p_brand) AS rn
    FROM (SELECT p_brand, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_brand)
    """
)
def q_group_sorted(spark: SparkSession, d: str) -> DataFrame:
    return rank_rows(group_by(table(spark, d, "part"), "p_brand", [count_rows("n")]), [("n", "desc"), "p_brand"])


@query(
    """
    SELECT c_nationkey, c_mktsegment, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM customer GROUP BY 1, 2
    """
)
def q_group_two_keys(spark: SparkSession, d: str) -> DataFrame:
    return group_by(
        table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], [sum_of("c_acctbal", "total", amount=True)]
    )


@query(
    """
    SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n,
           CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS average,
           CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM customer GROUP BY 1
    """
)
def q_group_stats(spark: SparkSession, d: str) -> DataFrame:
    return group_stats(
        table(spark, d, "customer"), "c_mktsegment", "c_acctbal", count="n", average="average", total="total"
    )


@query(
    """
    SELECT c_custkey, c_mktsegment, CAST(count(*) OVER (PARTITION BY c_mktsegment) AS BIGINT) AS n_in_group,
           row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS rn
    FROM customer
    """
)
def q_window_group(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    ranked = rank_rows(customer, ["c_acctbal", "c_custkey"], within=["c_mktsegment"], count_out="n_in_group")
    return ranked.select("c_custkey", "c_mktsegment", "n_in_group", "rn")


@query(
    """
    SELECT o_orderkey, o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER p AS DOUBLE) AS running_sum,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER p AS DOUBLE) / count(*) OVER p AS running_average
    FROM orders WINDOW p AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)
    """
)
def q_window_running(spark: SparkSession, d: str) -> DataFrame:
    """Sum and average of the orders of a priority so far: few groups, so each is a hot one."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    totals = {"total": money(F.col("o_totalprice")), "n": F.lit(1)}
    running = running_totals(orders, ["o_orderdate", "o_orderkey"], totals, within=["o_orderpriority"])
    total = F.col("total").cast("double")
    return running.select("o_orderkey", "o_orderpriority", total.alias("running_sum"), (total / F.col("n")).alias("running_average"))


@query(
    """
    SELECT o_orderkey, o_orderpriority, CAST(count(*) OVER p AS BIGINT) AS n_in_group,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER p AS DOUBLE) / count(*) OVER p AS group_average
    FROM orders WINDOW p AS (PARTITION BY o_orderpriority)
    """
)
def q_window_stats(spark: SparkSession, d: str) -> DataFrame:
    orders = select_fields(table(spark, d, "orders"), ["o_orderkey", "o_orderpriority", "o_totalprice"])
    stats = [count_rows("n_in_group"), avg_of("o_totalprice", "group_average", amount=True)]
    return attach_groups(orders, ["o_orderpriority"], stats).drop("o_totalprice")


@query(
    """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
    QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name DESC) = 1
    """
)
def q_dedupe_by_key(spark: SparkSession, d: str) -> DataFrame:
    return latest_per_key(table(spark, d, "customer"), "c_mktsegment", ["c_name"])


@query(
    "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn FROM orders"
)
def q_sort_numeric(spark: SparkSession, d: str) -> DataFrame:
    orders = select_fields(table(spark, d, "orders"), ["o_orderkey", "o_totalprice"])
    return rank_rows(orders, ["o_totalprice", "o_orderkey"])


_MIXED = "CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END"


@query(
    f"SELECT p_partkey, name, row_number() OVER (ORDER BY lower(name), p_partkey) AS rn"
    f" FROM (SELECT p_partkey, {_MIXED} AS name FROM part)"
)
def q_sort_ci(spark: SparkSession, d: str) -> DataFrame:
    """Half of the names are in capitals, which must not move them."""
    part = table(spark, d, "part").selectExpr("p_partkey", f"{_MIXED} AS name")
    return rank_rows(part, ["name", "p_partkey"], case_sensitive=False)


@query(
    """
    SELECT c_custkey, row_number() OVER (ORDER BY lower(c_mktsegment), lower(c_name) DESC) AS rn FROM customer
    """
)
def q_sort_multi(spark: SparkSession, d: str) -> DataFrame:
    customer = select_fields(table(spark, d, "customer"), ["c_custkey", "c_mktsegment", "c_name"])
    ranked = rank_rows(customer, ["c_mktsegment", ("c_name", "desc")], case_sensitive=False)
    return select_fields(ranked, ["c_custkey", "rn"])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders")
def q_sort_date(spark: SparkSession, d: str) -> DataFrame:
    orders = select_fields(table(spark, d, "orders"), ["o_orderkey", "o_orderdate"])
    return select_fields(rank_rows(orders, ["o_orderdate", "o_orderkey"]), ["o_orderkey", "rn"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def q_limit(spark: SparkSession, d: str) -> DataFrame:
    """The ten dearest orders; a limit of 0 keeps all rows."""
    orders = take_rows(select_fields(table(spark, d, "orders"), ["o_orderkey", "o_totalprice"]), 0)
    return top_rows(orders, [("o_totalprice", "desc"), "o_orderkey"], 10)


@query(
    """
    SELECT o_orderkey, o_totalprice, CAST(round(o_totalprice) AS BIGINT) AS rounded FROM orders
    WHERE CAST(round(o_totalprice) AS BIGINT) > 250000
    """
)
def q_round_filter(spark: SparkSession, d: str) -> DataFrame:
    orders = select_fields(table(spark, d, "orders"), ["o_orderkey", "o_totalprice"])
    return where(calc_round(orders, "o_totalprice", "rounded"), F.col("rounded") > literal("250000", "bigint"))


@query("SELECT o_orderkey, CAST(2025 - year(o_orderdate) AS BIGINT) AS years FROM orders")
def q_years_since(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", years_since(F.year("o_orderdate")).alias("years"))


@query(
    """
    SELECT l_orderkey, l_partkey, l_extendedprice * (1 - l_discount) AS net, l_quantity + l_tax AS plus,
           l_extendedprice / nullif(l_tax, 0) AS ratio
    FROM lineitem
    """
)
def q_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        (price * (1 - F.col("l_discount"))).alias("net"),
        (F.col("l_quantity") + F.col("l_tax")).alias("plus"),
        safe_divide(price, F.col("l_tax")).alias("ratio"),
    )


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def q_date_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", stamp_text(F.col("ts")).alias("stamp"))


@query(
    """
    SELECT b.p_brand, CAST(b.largest AS BIGINT) AS largest, CAST(b.smallest AS BIGINT) AS smallest, b.mean_price,
           t.p_type, b.types
    FROM (SELECT p_brand, max(p_size) AS largest, min(p_size) AS smallest,
                 CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_price,
                 string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types
          FROM part GROUP BY p_brand) b
    JOIN (SELECT DISTINCT p_brand, p_type FROM part) t ON b.p_brand = t.p_brand
    """
)
def q_named_builtins(spark: SparkSession, d: str) -> DataFrame:
    """max, min, avg, collect_set and explode; the set is of types, each once per task and brand."""
    part = table(spark, d, "part")
    price = F.sum(money(F.col("p_retailprice"))).cast("double")
    grouped = group_by(
        part,
        "p_brand",
        [
            F.max("p_size").cast("long").alias("largest"),
            F.min("p_size").cast("long").alias("smallest"),
            F.try_divide(price, F.count(F.lit(1))).alias("mean_price"),
            F.array_sort(F.collect_set("p_type")).alias("kinds"),
        ],
    )
    return grouped.select(
        "p_brand", "largest", "smallest", "mean_price",
        F.explode("kinds").alias("p_type"), F.array_join("kinds", "|").alias("types"),
    )
