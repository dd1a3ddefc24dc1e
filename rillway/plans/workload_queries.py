"""The batch jobs of ``jobs.py`` on the driver's tables.

Each query renames the tables' columns to those of the job, runs the job's own transformation, and
names the result for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.operators.aggregates import count_rows, group_by
from rillway.operators.joins import equi_join
from rillway.operators.ordering import rank_rows
from rillway.operators.rows import select_fields
from rillway.plans import jobs
from rillway.plans.registry import query, table
from rillway.session import scratch_path
from rillway.sources.delimited import read_delimited, write_delimited
from rillway.sources.fields import Field

_STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _through_files(df: DataFrame, fields: list[Field]) -> DataFrame:
    """Copy rows by way of a delimited folder, and read them back by their declared layout."""
    folder = scratch_path(df.sparkSession, "copy")
    write_delimited(jobs.copy_rows(df), folder, timestamp_format=_STAMP)
    return read_delimited(df.sparkSession, folder, fields)


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def w_copy_customers(spark: SparkSession, d: str) -> DataFrame:
    fields = [
        Field("c_custkey", "long"), Field("c_name", trim="both"), Field("c_nationkey", "long"),
        Field("c_acctbal", "double"), Field("c_mktsegment", trim="both"),
    ]
    return _through_files(table(spark, d, "customer"), fields)


@query(
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate,"
    " o_orderpriority FROM orders"
)
def w_copy_leads(spark: SparkSession, d: str) -> DataFrame:
    fields = [
        Field("o_orderkey", "long"), Field("o_custkey", "long"), Field("o_orderstatus", trim="both"),
        Field("o_totalprice", "double"), Field("o_orderdate", "timestamp", fmt=_STAMP),
        Field("o_orderpriority", trim="both"),
    ]
    copied = _through_files(table(spark, d, "orders"), fields)
    return copied.withColumn("o_orderdate", F.date_format("o_orderdate", _STAMP))


@query(
    "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part"
)
def w_copy_products(spark: SparkSession, d: str) -> DataFrame:
    fields = [
        Field("p_partkey", "long"), Field("p_name", trim="both"), Field("p_brand", trim="both"),
        Field("p_type", trim="both"), Field("p_size", "long"), Field("p_retailprice", "double"),
    ]
    return _through_files(table(spark, d, "part"), fields)


@query(
    """
    SELECT c.c_custkey, c.c_name, CAST(o.n AS BIGINT) AS total_orders
    FROM customer c JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o
      ON o.o_custkey = c.c_custkey
    WHERE o.n > 5 AND c.c_mktsegment = 'BUILDING'
    """
)
def w_filter_customers(spark: SparkSession, d: str) -> DataFrame:
    orders = group_by(table(spark, d, "orders"), "o_custkey", [count_rows("total_orders")])
    customers = equi_join(table(spark, d, "customer"), orders, [("c_custkey", "o_custkey")])
    subscribed = customers.withColumn("is_subscribed", F.col("c_mktsegment") == "BUILDING")
    return select_fields(jobs.filter_customers(subscribed), ["c_custkey", "c_name", "total_orders"])


@query(
    """
    SELECT c_custkey, c_name, c_mktsegment,
           row_number() OVER (ORDER BY lower(c_mktsegment), lower(c_name), c_custkey) AS rn
    FROM customer
    """
)
def w_sort_people(spark: SparkSession, d: str) -> DataFrame:
    people = select_fields(
        table(spark, d, "customer"), {"c_custkey": "Job Title", "c_name": "First Name", "c_mktsegment": "Last Name"}
    )
    ranked = rank_rows(jobs.pick_people(people), [*jobs.PEOPLE_ORDER, "Job Title"], case_sensitive=False)
    return select_fields(
        ranked, {"Job Title": "c_custkey", "First Name": "c_name", "Last Name": "c_mktsegment", "rn": "rn"}
    )


@query(
    """
    SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS founded,
           CAST(2025 - year(o_orderdate) AS BIGINT) AS years_in_business
    FROM orders
    """
)
def w_org_age(spark: SparkSession, d: str) -> DataFrame:
    founded = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("Founded"))
    return jobs.organization_age(founded).toDF("o_orderkey", "founded", "years_in_business")


@query("SELECT c.*, p.* FROM customer c JOIN part p ON c.c_custkey = p.p_partkey")
def w_merge_customers_products(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").withColumnRenamed("c_custkey", "id")
    products = table(spark, d, "part").withColumnRenamed("p_partkey", "Index")
    merged = jobs.merge_customers_products(customers, products)
    return merged.withColumnsRenamed({"id": "c_custkey", "Index": "p_partkey"})


@query(
    """
    SELECT p_type, CAST(n AS BIGINT) AS n, row_number() OVER (ORDER BY n DESC, p_type) AS rn
    FROM (SELECT p_type, count(*) AS n FROM part GROUP BY p_type)
    """
)
def w_count_by_title(spark: SparkSession, d: str) -> DataFrame:
    counts = jobs.title_counts(select_fields(table(spark, d, "part"), {"p_type": "Job Title"}))
    return rank_rows(counts, [("Count", "desc"), "Job Title"]).toDF("p_type", "n", "rn")


@query(
    """
    SELECT o.o_orderkey, o.o_orderpriority, o.o_custkey, c.c_mktsegment, o.o_orderstatus
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
    WHERE o.o_orderstatus = 'F'
    """
)
def w_enrich_filter_leads(spark: SparkSession, d: str) -> DataFrame:
    leads = select_fields(
        table(spark, d, "orders"),
        {
            "o_orderkey": "First Name", "o_orderpriority": "Last Name",
            "o_custkey": "Company", "o_orderstatus": "Deal Stage",
        },
    )
    organizations = select_fields(table(spark, d, "customer"), {"c_custkey": "Name", "c_mktsegment": "Industry"})
    return jobs.closed_won_leads(leads, organizations, stage="F").toDF(
        "o_orderkey", "o_orderpriority", "o_custkey", "c_mktsegment", "o_orderstatus"
    )


def sold_items(spark: SparkSession, d: str) -> DataFrame:
    """Line items with the country of the customer who ordered them.

    Orders meet customers first: the narrow result then joins the large line table once per key.
    """
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("Country"))
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    buyers = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "Country")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    sold = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "Country")
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_partkey").alias("Index"), F.col("l_extendedprice").alias("Price")
    )
    placed = equi_join(lines, sold, [("l_orderkey", "o_orderkey")], both_large=True)
    return placed.select("Index", "Price", "Country")


@query(
    """
    SELECT n.n_name, p.p_type,
           CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue,
           CAST(count(*) AS BIGINT) AS customer_count
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey
    JOIN part p ON l.l_partkey = p.p_partkey
    WHERE l.l_extendedprice > 50000
    GROUP BY n.n_name, p.p_type
    """
)
def w_sales_by_country_category(spark: SparkSession, d: str) -> DataFrame:
    products = select_fields(table(spark, d, "part"), {"p_partkey": "Index", "p_type": "Category"})
    report = jobs.sales_report(sold_items(spark, d), products, min_price=50000)
    return report.toDF("n_name", "p_type", "total_revenue", "customer_count")


@query(
    """
    SELECT l.l_suppkey, c.c_nationkey, s.s_name, s.s_acctbal, n.n_nationkey, n.n_regionkey, n.n_name,
           o.o_orderstatus
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN supplier s ON l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey
    JOIN nation n ON s.s_nationkey = n.n_nationkey
    WHERE l.l_returnflag = 'R' AND o.o_orderstatus = 'F'
    """
)
def w_high_value_leads(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    placed = equi_join(orders, customer, [("o_custkey", "c_custkey")])
    leads = equi_join(lines, placed, [("l_orderkey", "o_orderkey")], both_large=True).select(
        F.col("l_suppkey").alias("First Name"),
        F.col("c_nationkey").alias("Last Name"),
        F.col("c_nationkey").alias("Company"),
        F.col("o_orderstatus").alias("Deal Stage"),
        F.col("l_returnflag").alias("Source"),
    )
    people = select_fields(
        table(spark, d, "supplier"),
        {"s_suppkey": "First Name", "s_nationkey": "Last Name", "s_name": "Email", "s_acctbal": "Phone"},
    )
    organizations = select_fields(
        table(spark, d, "nation"), {"n_nationkey": "Name", "n_regionkey": "Industry", "n_name": "Country"}
    )
    return jobs.high_value_leads(leads, people, organizations, stage="F", source="R").toDF(
        "l_suppkey", "c_nationkey", "s_name", "s_acctbal", "n_nationkey", "n_regionkey", "n_name", "o_orderstatus"
    )


@query(
    """
    SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS company_count,
           CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(c_acctbal) AS average_balance,
           CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total_balance
    FROM customer WHERE c_acctbal > 5000 GROUP BY c_mktsegment
    """
)
def w_industry_report(spark: SparkSession, d: str) -> DataFrame:
    organizations = select_fields(
        table(spark, d, "customer"), {"c_mktsegment": "Industry", "c_acctbal": "Number of employees"}
    )
    return jobs.industry_report(organizations).toDF("c_mktsegment", "company_count", "average_balance", "total_balance")


SITE_COLUMNS = (
    "order_number", "ordered_date", "sold_to_customer", "account_name", "org_id",
    "billing_address1", "billing_city", "billing_country", "billing_site_status",
    "shipping_address1", "shipping_city", "shipping_country", "shipping_site_status",
)

SITES_SQL = """
    SELECT o.o_orderkey AS order_number, strftime(o.o_orderdate, '%Y-%m-%d') AS ordered_date,
           c.c_name AS sold_to_customer, s.s_name AS account_name, o.o_totalprice AS org_id,
           nb.n_name AS billing_address1, rb.r_name AS billing_city, c.c_mktsegment AS billing_country,
           l.l_linestatus AS billing_site_status,
           ns.n_name AS shipping_address1, rs.r_name AS shipping_city, s.s_name AS shipping_country,
           l.l_returnflag AS shipping_site_status
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation nb ON c.c_nationkey = nb.n_nationkey
    JOIN region rb ON nb.n_regionkey = rb.r_regionkey
    JOIN supplier s ON l.l_suppkey = s.s_suppkey
    JOIN nation ns ON s.s_nationkey = ns.n_nationkey
    JOIN region rs ON ns.n_regionkey = rs.r_regionkey
"""


def _places(spark: SparkSession, d: str, prefix: str) -> DataFrame:
    """Nation and region in one role."""
    places = equi_join(table(spark, d, "nation"), table(spark, d, "region"), [("n_regionkey", "r_regionkey")])
    return select_fields(
        places, {"n_nationkey": f"{prefix}_key", "n_name": f"{prefix}_address1", "r_name": f"{prefix}_city"}
    )


def order_site_rows(spark: SparkSession, d: str) -> DataFrame:
    """Line items with two roles of nation and region, of the customer and of the supplier."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linestatus", "l_returnflag")
    customer = equi_join(
        table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"),
        _places(spark, d, "billing"),
        [("c_nationkey", "billing_key")],
    )
    supplier = equi_join(
        table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"),
        _places(spark, d, "shipping"),
        [("s_nationkey", "shipping_key")],
    )
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    placed = equi_join(orders, customer, [("o_custkey", "c_custkey")])
    sold = equi_join(lines, placed, [("l_orderkey", "o_orderkey")], both_large=True)
    joined = equi_join(sold, supplier, [("l_suppkey", "s_suppkey")])
    return joined.select(
        F.col("o_orderkey").alias("order_number"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered_date"),
        F.col("c_name").alias("sold_to_customer"),
        F.col("s_name").alias("account_name"),
        F.col("o_totalprice").alias("org_id"),
        "billing_address1",
        "billing_city",
        F.col("c_mktsegment").alias("billing_country"),
        F.col("l_linestatus").alias("billing_site_status"),
        "shipping_address1",
        "shipping_city",
        F.col("s_name").alias("shipping_country"),
        F.col("l_returnflag").alias("shipping_site_status"),
    )


@query(
    f"""
    SELECT * REPLACE (lower(billing_site_status) AS billing_site_status),
           CAST(round(org_id) AS BIGINT) AS roundupvalue
    FROM ({SITES_SQL}) WHERE CAST(round(org_id) AS BIGINT) > 250000
    """
)
def w_order_sites(spark: SparkSession, d: str) -> DataFrame:
    rows = order_site_rows(spark, d)
    upper = rows.toDF(*[c.upper() for c in rows.columns])
    return jobs.order_sites(upper, min_value=250000).toDF(*SITE_COLUMNS, "roundupvalue")


@query(
    """
    SELECT s_suppkey, s_name, s_acctbal, row_number() OVER (ORDER BY s_suppkey) AS rn
    FROM supplier WHERE s_acctbal > 0
    """
)
def w_active_suppliers(spark: SparkSession, d: str) -> DataFrame:
    suppliers = select_fields(
        table(spark, d, "supplier"), {"s_suppkey": "SUPPLIER_ID", "s_name": "NAME", "s_acctbal": "STATUS"}
    )
    active = jobs.active_suppliers(suppliers, "STATUS > 0")
    return rank_rows(active, ["SUPPLIER_ID"]).toDF("s_suppkey", "s_name", "s_acctbal", "rn")


@query(
    """
    SELECT o.o_custkey, CAST(sum(l.l_quantity) AS DOUBLE) AS quantity
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey
    """
)
def w_quantity_by_customer(spark: SparkSession, d: str) -> DataFrame:
    lines = select_fields(table(spark, d, "lineitem"), {"l_orderkey": "ORDER_ID", "l_quantity": "QUANTITY"})
    headers = select_fields(table(spark, d, "orders"), {"o_orderkey": "ORDER_ID", "o_custkey": "CUSTOMER_ID"})
    return jobs.quantity_by_customer(lines, headers).toDF("o_custkey", "quantity")
