"""Declared layouts of the delimited files. The same entity differs between jobs."""

from __future__ import annotations

from rillway.sources.fields import Field, strings


def whole(name: str, group: str = "") -> Field:
    return Field(name, "long", group=group)


def day(name: str) -> Field:
    return Field(name, "date", fmt="yyyy-MM-dd")


# Column names and types of the input files.
CUSTOMERS = [
    whole("id", ","),
    *strings("first_name", "last_name", "email", "gender", "country", "city"),
    day("signup_date"),
    day("last_login_date"),
    whole("total_orders", ","),
    Field("is_subscribed", "boolean"),
    *strings("customer_tier", "source"),
]
CUSTOMER_CONTACTS = [
    whole("Index", ","),
    *strings(
        "Customer Id", "First Name", "Last Name", "Company", "City", "Country", "Phone 1", "Phone 2", "Email"
    ),
    day("Subscription Date"),
    *strings("Website"),
]
PRODUCTS = [
    whole("Index", ","),
    *strings("Name", "Description", "Brand", "Category"),
    whole("Price", ","),
    *strings("Currency"),
    whole("Stock", ","),
    whole("EAN", ","),
    *strings("Color", "Size", "Availability"),
    whole("Internal ID", ","),
]
PRODUCTS_PRICED = [
    {"Price": Field("Price", "double", group=","), "EAN": Field("EAN", trim="both")}.get(f.name, f) for f in PRODUCTS
]
PEOPLE = [
    whole("Index", ","),
    *strings("User Id", "First Name", "Last Name", "Sex", "Email", "Phone"),
    day("Date of birth"),
    *strings("Job Title"),
]
PEOPLE_SHORT = [whole("Index"), *strings("User Id", "First Name", "Last Name", "Email", "Phone", "Job Title")]
LEADS = [
    whole("Index", ","),
    *strings(
        "Account Id", "Lead Owner", "First Name", "Last Name", "Company", "Phone 1", "Phone 2",
        "Email 1", "Email 2", "Website", "Source", "Deal Stage", "Notes",
    ),
]
LEADS_SHORT = [
    whole("Index"),
    *strings("Account Id", "Lead Owner", "First Name", "Last Name", "Company", "Source", "Deal Stage"),
]
ORGANIZATIONS = [
    whole("Index", ","),
    *strings("Organization Id", "Name", "Website", "Country", "Description"),
    whole("Founded", ","),
    *strings("Industry"),
    whole("Number of employees", ","),
]
ORGANIZATIONS_PLAIN = [whole(f.name) if f.type == "long" else f for f in ORGANIZATIONS]
ORGANIZATIONS_SHORT = [whole("Index"), *strings("Organization Id", "Name", "Website", "Country", "Industry")]
