from decimal import Decimal

import pytest

from rillway.plans import jobs, layouts
from rillway.sources.delimited import read_delimited
from rillway.sources.fields import Field
from rillway.streaming.counts import count_files_as_stream, read_counts, stream_counts, stream_files


def csv(folder, name, header, *lines):
    path = folder / name
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


@pytest.fixture
def files(tmp_path):
    names = lambda layout: ",".join(f.name for f in layout)
    return {
        "customers": csv(
            tmp_path, "customers.csv", names(layouts.CUSTOMERS),
            '"1,001",Ann, Lee ,a@x,F,PT,Porto,2024-01-01,2024-02-01,6,true,gold,web',
            "2,Bob,Lee,b@x,M,PT,Porto,2024-01-01,bad,5,true,gold,web",
            "3,Cy,Lee,c@x,M,PT,Porto,2024-01-01,,9,false,gold,web",
        ),
        "contacts": csv(
            tmp_path, "contacts.csv", names(layouts.CUSTOMER_CONTACTS),
            "1,c1,Ann,Lee,Acme,Porto,PT,1,2,a@x,2024-01-01,w",
            "2,c2,Bob,Lee,Acme,Porto,PT,1,2,b@x,2024-01-01,w",
            "3,c3,Cy,Lee,Acme,Lyon,FR,1,2,c@x,2024-01-01,w",
        ),
        "products": csv(
            tmp_path, "products.csv", names(layouts.PRODUCTS),
            '1001,Lamp,d,B,Home,"1,200",EUR,5,123,red,L,yes,7',
            "2,Sofa,d,B,Home,500,EUR,5,124,red,L,yes,8",
            "3,Desk,d,B,Home,501,EUR,5,125,red,L,yes,9",
            "1,Chair,d,B,Home,700.25,EUR,5,E126,red,L,yes,9",
        ),
        "people": csv(
            tmp_path, "people.csv", names(layouts.PEOPLE),
            "1,u1,Zoe,lee,F,z@x,1,1990-01-01,Clerk",
            "2,u2,Ann,Lee,F,a@x,2,1990-01-01,Smith",
            "3,u3,Bob,Abel,M,b@x,3,1990-01-01,Clerk",
        ),
        "leads": csv(
            tmp_path, "leads.csv", names(layouts.LEADS),
            "1,a1,o,Ann,Lee,Acme,1,2,e,e,w,Referral,Closed Won,n",
            "2,a2,o,Bob,Abel,Acme,1,2,e,e,w,Web,Closed Won,n",
            "3,a3,o,Zoe,lee,Acme,1,2,e,e,w,Referral,New,n",
            "4,a4,o,Ann,Lee,acme,1,2,e,e,w,Referral,Closed Won,n",
        ),
        "orgs": csv(
            tmp_path, "organizations.csv", names(layouts.ORGANIZATIONS),
            "1,g1,Acme,w,PT,d,1990,Retail,5001",
            "2,g2,Beta,w,PT,d,2000,Retail,5000",
            "3,g3,Coda,w,FR,d,2025,Retail,6000",
        ),
        "out": str(tmp_path / "out"),
    }


def run(spark, files, name, **inputs):
    paths = {k: files.get(v, v) if isinstance(v, str) else v for k, v in inputs.items()}
    return jobs.run_file_job(spark, name, output_csv=files["out"], **paths)


def test_copies(spark, files):
    for name, source, n in (("copy_customers", "customers", 3), ("copy_leads", "leads", 4), ("copy_products", "products", 4)):
        result = run(spark, files, name, input_csv=source)
        back = read_delimited(spark, files["out"], jobs.FILE_JOBS[name].inputs["input_csv"][1])
        assert back.count() == n and back.exceptAll(result).count() == 0 and result.exceptAll(back).count() == 0
    assert read_delimited(spark, files["customers"], layouts.CUSTOMERS).first()[:3] == (1001, "Ann", "Lee")


def test_single_input_jobs(spark, files, rows):
    assert rows(run(spark, files, "filter_customers", input_csv="customers").select("id")) == [(1001,)]
    assert rows(run(spark, files, "filter_customers", input_csv="customers", min_orders=4).select("id")) == [(1001,), (2,)]
    people = run(spark, files, "sort_people", input_csv="people")
    assert [tuple(r) for r in people.collect()] == [("Bob", "Abel", "Clerk"), ("Ann", "Lee", "Smith"), ("Zoe", "lee", "Clerk")]
    ages = run(spark, files, "organization_age", input_csv="orgs")
    assert rows(ages.select("Name", "Years in Business")) == [("Acme", 35), ("Beta", 25), ("Coda", 0)]
    titles = run(spark, files, "count_by_title", input_csv="people")
    assert [tuple(r) for r in titles.collect()] == [("Clerk", 2), ("Smith", 1)]
    report = run(spark, files, "industry_report", orgs_input="orgs")
    assert rows(report) == [("Retail", 2, 5500.5, 11001)]


def test_joining_jobs(spark, files, rows):
    merged = run(spark, files, "merge_customers_products", customers_input="customers", products_input="products")
    assert rows(merged.select("id", "Name", "Price")) == [(1001, "Lamp", 1200), (2, "Sofa", 500), (3, "Desk", 501)]
    won = run(spark, files, "closed_won_leads", leads_input="leads", orgs_input="orgs")
    assert rows(won) == [("Ann", "Lee", "Acme", "Retail", "Closed Won"), ("Bob", "Abel", "Acme", "Retail", "Closed Won")]
    sales = run(spark, files, "sales_report", customers_input="contacts", products_input="products")
    assert rows(sales) == [("FR", "Home", 501.0, 1), ("PT", "Home", 700.25, 1)]
    high = run(spark, files, "high_value_leads", leads_input="leads", people_input="people", orgs_input="orgs")
    assert rows(high) == [("Ann", "Lee", "a@x", "2", "Acme", "Retail", "PT", "Closed Won")]
    written = read_delimited(spark, files["out"], [Field("Email"), Field("Country")])
    assert rows(written) == [("a@x", "PT")]


def test_order_sites(spark, rows, monkeypatch):
    def frame(columns, *data):
        return spark.createDataFrame(list(data), columns)

    tables = {
        "oe_order_headers_all": frame("order_number STRING, ordered_date DATE, flow_status_code STRING, sold_to_org_id INT",
                                      ("o1", None, "OPEN", 1), ("o2", None, "OPEN", 2), ("o3", None, "OPEN", 9)),
        "hz_parties": frame("party_id INT, party_name STRING", (1, "P1"), (2, "P2")),
        "hz_cust_accounts": frame("party_id INT, cust_account_id INT, account_name STRING, org_id DECIMAL(10,1)",
                                  (1, 10, "A1", Decimal("5000.5")), (2, 20, "A2", Decimal("5000.4"))),
    }
    for role, status in (("bill", "ACTIVE"), ("ship", "HELD")):
        tables[f"hz_cust_acct_sites_all_{role}"] = frame(
            "cust_account_id INT, cust_acct_site_id INT, party_site_id INT", (10, 100, 1000), (20, 200, 2000))
        tables[f"hz_cust_site_uses_all_{role}"] = frame("cust_acct_site_id INT", (100,), (200,))
        tables[f"hz_party_sites_{role}"] = frame(
            "party_site_id INT, location_id INT, status STRING", (1000, 1, status), (2000, 1, status))
        tables[f"hz_locations_{role}"] = frame("location_id INT, address1 STRING, city STRING, country STRING", (1, role, "c", "PT"))
    source = jobs.order_headers_with_sites(tables)
    assert "FLOW_STATUS_CODE" in source.columns and source.count() == 2
    result = jobs.order_sites(source)
    assert result.columns == [*jobs.ORDER_SITE_FIELDS, "roundupvalue"]
    row = result.first()
    assert result.count() == 1
    assert (row.ORDER_NUMBER, row.BILLING_SITE_STATUS, row.SHIPPING_SITE_STATUS, row.roundupvalue) == ("o1", "active", "HELD", 5001)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    assert rows(jobs.run_order_sites(spark)) == rows(result)
    calls = []
    monkeypatch.setattr(jobs, "read_query", lambda *args, **kwargs: calls.append((args[1:], kwargs)) or source)
    monkeypatch.setattr(jobs, "write_table", lambda df, *args, **kwargs: calls.append((args, kwargs)))
    over = jobs.run_order_sites_query(spark, "jdbc:x", "SELECT 1", "sites", properties={"user": "u"})
    assert rows(over) == rows(result)
    assert calls == [(("jdbc:x", "SELECT 1"), {"properties": {"user": "u"}}), (("jdbc:x", "sites"), {"properties": {"user": "u"}})]


def test_table_jobs(spark, rows, tmp_path):
    spark.createDataFrame([(2, "b", "ACTIVE", 0), (1, "a", "ACTIVE", 0), (3, "c", "OLD", 0)],
                          "SUPPLIER_ID INT, NAME STRING, STATUS STRING, other INT").createOrReplaceTempView("PO_SUPPLIERS")
    active = jobs.run_active_suppliers(spark, str(tmp_path / "output/orders.csv"))
    assert [tuple(r) for r in active.collect()] == [(1, "a", "ACTIVE"), (2, "b", "ACTIVE")]
    spark.createDataFrame([(1, 7, 1, 2), (2, 7, 1, 3), (3, 8, 1, 4), (4, 9, 1, 99)],
                          "LINE_ID INT, ORDER_ID INT, ITEM_ID INT, QUANTITY INT").createOrReplaceTempView("OE_ORDER_LINES_ALL")
    spark.createDataFrame([(7, 1, None), (8, 1, None), (6, 2, None)],
                          "ORDER_ID INT, CUSTOMER_ID INT, ORDER_DATE DATE").createOrReplaceTempView("OE_ORDER_HEADERS_ALL")
    assert rows(jobs.run_quantity_by_customer(spark, str(tmp_path / "q"))) == [(1, 9)]


def test_stream_counts_over_several_batches_and_restart(spark, rows, tmp_path):
    folder = str(tmp_path / "events")
    spark.createDataFrame([("a",), ("b",), ("a",)], "kind STRING").repartition(3).write.parquet(folder)
    stream = lambda: stream_files(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
    target, state = str(tmp_path / "counts"), str(tmp_path / "state")
    stream_counts(stream(), "kind", target, state)
    assert rows(read_counts(spark, target)) == [("a", 2), ("b", 1)]
    spark.createDataFrame([("c",), ("a",)], "kind STRING").write.mode("append").parquet(folder)
    stream_counts(stream(), "kind", target, state)
    assert rows(read_counts(spark, target)) == [("a", 3), ("b", 1), ("c", 1)]
    assert rows(count_files_as_stream(spark, folder, spark.read.parquet(folder).schema, "kind")) == [("a", 3), ("b", 1), ("c", 1)]


def test_a_job_may_write_over_its_input(spark, tmp_path, rows):
    path = str(tmp_path / "orgs")
    names = [f.name for f in jobs.FILE_JOBS["industry_report"].inputs["orgs_input"][1]]
    source = spark.createDataFrame([tuple("7" for _ in names)], ", ".join(f"`{n}` STRING" for n in names))
    jobs.write_delimited(source, path)
    first = rows(jobs.run_file_job(spark, "industry_report", orgs_input=path, output_csv=str(tmp_path / "out")))
    again = rows(jobs.run_file_job(spark, "industry_report", orgs_input=path, output_csv=path))
    assert first == again


def test_counts_of_an_empty_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    schema = spark.range(1).schema
    assert count_files_as_stream(spark, str(tmp_path / "none"), schema, "id").collect() == []
