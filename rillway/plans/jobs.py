"""The batch jobs: what each computes, and how to run it on files or tables.

Each transformation takes DataFrames and returns one, so it works on any source with these columns.
Sorts that only prepare a join or a grouping are left out: they do not change a result.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.functions.numbers import calc_round, years_since
from rillway.functions.text import StringOp, string_ops
from rillway.operators.aggregates import agg_text, count_rows, group_by, group_stats, sum_of
from rillway.operators.joins import equi_join
from rillway.operators.ordering import sort_rows
from rillway.operators.rows import above, all_of, equals, select_fields, where
from rillway.plans import layouts
from rillway.session import scratch_path
from rillway.sources.delimited import read_delimited, write_delimited
from rillway.sources.fields import Field, named
from rillway.sources.tables import read_query, read_table, write_table


def copy_rows(rows: DataFrame) -> DataFrame:
    return rows


def filter_customers(customers: DataFrame, min_orders: int = 5) -> DataFrame:
    """Subscribed customers with more than ``min_orders`` orders."""
    return where(customers, all_of(above("total_orders", min_orders), equals("is_subscribed", True)))


PEOPLE_ORDER = ("Last Name", "First Name")


def pick_people(people: DataFrame) -> DataFrame:
    return select_fields(people, ["First Name", "Last Name", "Job Title"])


def sort_people(people: DataFrame) -> DataFrame:
    """Names and job titles by last and first name, in any letter case."""
    return sort_rows(pick_people(people), PEOPLE_ORDER, case_sensitive=False)


def organization_age(organizations: DataFrame, as_of: int = 2025) -> DataFrame:
    return organizations.withColumn("Years in Business", years_since(named("Founded"), as_of))


def merge_customers_products(customers: DataFrame, products: DataFrame) -> DataFrame:
    return equi_join(customers, products, [("id", "Index")])


def title_counts(people: DataFrame) -> DataFrame:
    return group_by(people, "Job Title", [count_rows("Count")])


def count_by_title(people: DataFrame) -> DataFrame:
    """Number of people per job title, most common first."""
    return sort_rows(title_counts(people), [("Count", "desc")])


def closed_won_leads(leads: DataFrame, organizations: DataFrame, stage: str = "Closed Won") -> DataFrame:
    """Won leads with their organization."""
    won = where(equi_join(leads, organizations, [("Company", "Name")]), equals("Deal Stage", stage))
    return select_fields(won, ["First Name", "Last Name", "Company", "Industry", "Deal Stage"])


def sales_report(customers: DataFrame, products: DataFrame, min_price: float = 500) -> DataFrame:
    """Revenue and number of rows by country and category, above a price."""
    sold = where(equi_join(customers, products, "Index"), above("Price", min_price))
    return group_by(
        sold, ["Country", "Category"], [sum_of("Price", "Total Revenue", amount=True), count_rows("Customer Count")]
    )


def high_value_leads(
    leads: DataFrame,
    people: DataFrame,
    organizations: DataFrame,
    *,
    stage: str = "Closed Won",
    source: str = "Referral",
) -> DataFrame:
    """Won referral leads with contact data (by both names) and organization (by company)."""
    known = equi_join(leads, people, ["First Name", "Last Name"])
    enriched = equi_join(known, organizations, [("Company", "Name")])
    chosen = where(enriched, all_of(equals("Deal Stage", stage), equals("Source", source)))
    return select_fields(
        chosen,
        ["First Name", "Last Name", "Email", "Phone", "Company", "Industry", "Country", "Deal Stage"],
    )


def industry_report(organizations: DataFrame, min_employees: float = 5000) -> DataFrame:
    """Count, average and total of employees by industry, for large organizations."""
    return group_stats(
        where(organizations, above("Number of employees", min_employees)),
        "Industry",
        "Number of employees",
        count="Company Count",
        average="Average Employees",
        total="Total Employees",
        amount=dict(organizations.dtypes)["Number of employees"] != "bigint",
    )


ORDER_SITE_FIELDS = (
    "ORDER_NUMBER", "ORDERED_DATE", "SOLD_TO_CUSTOMER", "ACCOUNT_NAME", "ORG_ID",
    "BILLING_ADDRESS1", "BILLING_CITY", "BILLING_COUNTRY", "BILLING_SITE_STATUS",
    "SHIPPING_ADDRESS1", "SHIPPING_CITY", "SHIPPING_COUNTRY", "SHIPPING_SITE_STATUS",
)


def account_sites(tables: Mapping[str, DataFrame], role: str, prefix: str) -> DataFrame:
    """Address and status of an account's sites in one role (``bill`` or ``ship``)."""
    sites = tables[f"hz_cust_acct_sites_all_{role}"].select("cust_account_id", "cust_acct_site_id", "party_site_id")
    uses = tables[f"hz_cust_site_uses_all_{role}"].select("cust_acct_site_id")
    party = tables[f"hz_party_sites_{role}"].select("party_site_id", "location_id", "status")
    places = tables[f"hz_locations_{role}"].select("location_id", "address1", "city", "country")
    joined = (
        sites.join(uses, "cust_acct_site_id").join(party, "party_site_id").join(places, "location_id")
    )
    return joined.select(
        "cust_account_id",
        F.col("address1").alias(f"{prefix}_ADDRESS1"),
        F.col("city").alias(f"{prefix}_CITY"),
        F.col("country").alias(f"{prefix}_COUNTRY"),
        F.col("status").alias(f"{prefix}_SITE_STATUS"),
    )


def order_headers_with_sites(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Orders with customer account and the account's billing and shipping sites (11 tables)."""
    orders = tables["oe_order_headers_all"].select("order_number", "ordered_date", "flow_status_code", "sold_to_org_id")
    parties = tables["hz_parties"].select(F.col("party_id").alias("sold_to_org_id"), "party_name")
    accounts = tables["hz_cust_accounts"].select(
        F.col("party_id").alias("sold_to_org_id"), "cust_account_id", "account_name", "org_id"
    )
    joined = (
        orders.join(parties, "sold_to_org_id")
        .join(accounts, "sold_to_org_id")
        .join(account_sites(tables, "bill", "BILLING"), "cust_account_id")
        .join(account_sites(tables, "ship", "SHIPPING"), "cust_account_id")
    )
    return joined.select(
        F.col("order_number").alias("ORDER_NUMBER"),
        F.col("ordered_date").alias("ORDERED_DATE"),
        F.col("flow_status_code").alias("FLOW_STATUS_CODE"),
        F.col("party_name").alias("SOLD_TO_CUSTOMER"),
        F.col("account_name").alias("ACCOUNT_NAME"),
        F.col("org_id").alias("ORG_ID"),
        *[c for c in joined.columns if c.startswith(("BILLING_", "SHIPPING_"))],
    )


def order_sites(rows: DataFrame, min_value: int = 5000) -> DataFrame:
    """Tidy the order rows: chosen fields, status in lower case, rounded number above a limit."""
    chosen = select_fields(rows, ORDER_SITE_FIELDS)
    tidy = string_ops(chosen, {"BILLING_SITE_STATUS": StringOp(case="lower")})
    return where(calc_round(tidy, "ORG_ID", "roundupvalue"), above("roundupvalue", min_value))


def active_suppliers(suppliers: DataFrame, condition: str = "STATUS = 'ACTIVE'") -> DataFrame:
    return sort_rows(where(suppliers, condition), ["SUPPLIER_ID"])


def quantity_by_customer(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Total quantity per customer. Lines are first summed per order, so one line each meets its header."""
    per_order = group_by(lines, "ORDER_ID", [sum_of("QUANTITY", "QUANTITY")])
    return group_by(
        equi_join(per_order, headers, "ORDER_ID"), "CUSTOMER_ID", [agg_text("SUM(QUANTITY)", "QUANTITY")]
    )


@dataclass(frozen=True)
class FileJob:
    """A job from delimited files to a delimited folder; ``inputs`` gives path and layout by parameter."""

    transform: Callable[..., DataFrame]
    inputs: Mapping[str, tuple[str, Sequence[Field]]]
    output: str
    options: Mapping[str, object] = field(default_factory=dict)


FILE_JOBS = {
    "copy_customers": FileJob(copy_rows, {"input_csv": ("customers.csv", layouts.CUSTOMERS)}, "customers_output"),
    "copy_leads": FileJob(copy_rows, {"input_csv": ("leads.csv", layouts.LEADS)}, "leads_output"),
    "copy_products": FileJob(copy_rows, {"input_csv": ("products.csv", layouts.PRODUCTS)}, "products_output"),
    "filter_customers": FileJob(
        filter_customers, {"input_csv": ("customers.csv", layouts.CUSTOMERS)}, "high_value_customers"
    ),
    "sort_people": FileJob(sort_people, {"input_csv": ("people.csv", layouts.PEOPLE)}, "sorted_people"),
    "organization_age": FileJob(
        organization_age, {"input_csv": ("organizations.csv", layouts.ORGANIZATIONS)}, "orgs_with_age"
    ),
    "merge_customers_products": FileJob(
        merge_customers_products,
        {
            "customers_input": ("customers.csv", layouts.CUSTOMERS),
            "products_input": ("products.csv", layouts.PRODUCTS),
        },
        "merged_data",
    ),
    "count_by_title": FileJob(count_by_title, {"input_csv": ("people.csv", layouts.PEOPLE)}, "job_title_counts"),
    "closed_won_leads": FileJob(
        closed_won_leads,
        {
            "leads_input": ("leads.csv", layouts.LEADS),
            "orgs_input": ("organizations.csv", layouts.ORGANIZATIONS),
        },
        "closed_won_leads_with_orgs",
    ),
    "sales_report": FileJob(
        sales_report,
        {
            "customers_input": ("customers.csv", layouts.CUSTOMER_CONTACTS),
            "products_input": ("products.csv", layouts.PRODUCTS_PRICED),
        },
        "sales_summary_by_country_and_category",
    ),
    "high_value_leads": FileJob(
        high_value_leads,
        {
            "leads_input": ("leads.csv", layouts.LEADS_SHORT),
            "people_input": ("people.csv", layouts.PEOPLE_SHORT),
            "orgs_input": ("organizations.csv", layouts.ORGANIZATIONS_SHORT),
        },
        "consolidated_high_value_leads",
    ),
    "industry_report": FileJob(
        industry_report, {"orgs_input": ("organizations.csv", layouts.ORGANIZATIONS_PLAIN)}, "large_orgs_by_industry"
    ),
}


def run_file_job(spark: SparkSession, name: str, *, output_csv: str | None = None, **params) -> DataFrame:
    """Run a job by name. Input paths and limits not given keep their defaults; returns the result.

    The result is computed once, into scratch, before the output is touched: a job may write over
    its own input, and the rows returned are those written.
    """
    job = FILE_JOBS[name]
    frames = [
        read_delimited(spark, params.pop(param, default), fields)
        for param, (default, fields) in job.inputs.items()
    ]
    return _kept(job.transform(*frames, **params), output_csv or job.output)


def _kept(result: DataFrame, output_csv: str) -> DataFrame:
    aside = scratch_path(result.sparkSession, "result")
    result.write.parquet(aside)
    rows = result.sparkSession.read.parquet(aside)
    write_delimited(rows, output_csv)
    return rows


# The tables of the order-sites job.
ORDER_SITE_TABLES = (
    "oe_order_headers_all", "hz_parties", "hz_cust_accounts",
    "hz_cust_acct_sites_all_bill", "hz_cust_site_uses_all_bill", "hz_party_sites_bill", "hz_locations_bill",
    "hz_cust_acct_sites_all_ship", "hz_cust_site_uses_all_ship", "hz_party_sites_ship", "hz_locations_ship",
)


def run_order_sites(spark: SparkSession, url: str | None = None, table: str = "order_sites", min_value: int = 5000) -> DataFrame:
    """Order sites from catalog tables; appended to a JDBC table when ``url`` is given."""
    tables = {name: read_table(spark, name) for name in ORDER_SITE_TABLES}
    result = order_sites(order_headers_with_sites(tables), min_value)
    if url:
        write_table(result, url, table)
    return result


def run_order_sites_query(
    spark: SparkSession, url: str, query: str, table: str, *, min_value: int = 5000, **options
) -> DataFrame:
    """The same from a SQL query that the database runs; ``options`` as of ``read_query``."""
    result = order_sites(read_query(spark, url, query, **options), min_value)
    write_table(result, url, table, properties=options.get("properties"))
    return result


def run_active_suppliers(spark: SparkSession, output_csv: str = "output/suppliers.csv") -> DataFrame:
    return _kept(active_suppliers(read_table(spark, "PO_SUPPLIERS", ["SUPPLIER_ID", "NAME", "STATUS"])), output_csv)


def run_quantity_by_customer(spark: SparkSession, output_csv: str = "output/orders.csv") -> DataFrame:
    lines = read_table(spark, "OE_ORDER_LINES_ALL", ["LINE_ID", "ORDER_ID", "ITEM_ID", "QUANTITY"])
    headers = read_table(spark, "OE_ORDER_HEADERS_ALL", ["ORDER_ID", "CUSTOMER_ID", "ORDER_DATE"])
    return _kept(quantity_by_customer(lines, headers), output_csv)
