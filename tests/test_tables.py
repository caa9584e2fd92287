"""The load on small sheets with every irregularity the raw data may have."""

import shutil

import pytest
from pyspark.sql import functions as F

from ledgerfield.operators.quantiles import stored
from ledgerfield.plans import customers, dimensions, facts, features
from ledgerfield.plans.warehouse import Warehouse
from ledgerfield.sources.schemas import RAW_SCHEMAS

DAY = "2024-01-%02d 00:00:00"
TABLES = ["fact_sales", "fact_installations", "fact_lead_funnel", "mart_sales_performance",
          "mart_installation_operations", "mart_customer_account_analytics", "customer_table"]


@pytest.fixture
def sheets(spark):
    data = {
        "Customers": [
            ("c1", "F", "1990-05-05", "kenya", "Nairobi", 1.0, None, DAY % 1),
            ("c2", "M", "bad", "uganda", "Kampala", None, 2.0, DAY % 1),
            ("c3", None, None, None, "Nowhere", 1.0, 1.0, DAY % 1),
            ("c4", "F", "1980-01-01", "kenya", None, 1.0, 1.0, DAY % 1),
        ],
        "Departments": [("d1", "Field")],
        "Users": [("u1", "Ann", "d1", DAY % 1), ("u2", "Bob", None, DAY % 1)],
        "Products": [("p1", "Pump", True, DAY % 1), ("p2", "Panel", None, DAY % 1)],
        "Leads": [
            ("LEAD-1", "c1", "Website", "2024-01-10 12:00:00"),
            ("LEAD-2", "c2", "Billboard", DAY % 5),
            ("LEAD-3", None, "Website", DAY % 5),
            ("LEAD-4", "c4", None, "soon"),
        ],
        "Accounts": [
            # id, customer, status, type, created, updated, installation, dispatch, first, agent,
            # product, lead
            ("a1", "c1", "Arrears", "PAYG", "2024-01-12 00:00:00", None, "i1", DAY % 9,
             "2024-02-01", "u1", "p1", "LEAD-1"),
            ("a2", "c1", "Complete", "CASH", DAY % 20, None, None, None, None, "u9", "p2",
             "LEAD-1"),
            ("a3", "c2", "No Deposit", "PAYG", DAY % 8, None, "i3", None, "never", None, None,
             "LEAD-2"),
            ("a4", "c3", "Advance", "CASH", DAY % 8, None, None, None, None, None, None, None),
            ("a5", "c4", None, "CASH", DAY % 8, None, None, None, None, None, None, "LEAD-4"),
        ],
        "Sales": [
            ("s1", "a1", "2024-01-11", DAY % 11, None), ("s2", "a1", "2024-01-14", DAY % 14, None),
            ("s3", "a3", "n/a", DAY % 9, None), ("s4", "gone", "2024-01-09", DAY % 9, None),
            ("s5", "a5", "2024-01-09", DAY % 9, None),
        ],
        "Installations": [
            ("i1", "2024-01-08", "u1", DAY % 8, None), ("i3", "2024-01-30", "u2", DAY % 30, None),
            ("i9", "2024-01-30", "u2", DAY % 30, None),
        ],
    }
    return {n: spark.createDataFrame(rows, RAW_SCHEMAS[n]) for n, rows in data.items()}


def test_dimensions(sheets):
    countries = {r["country_name"]: r["currency"] for r in
                 dimensions.dim_country(sheets["Customers"]).collect()}
    assert countries == {"kenya": "KSh", "uganda": "USh"}
    assert dimensions.dim_location(sheets["Customers"]).count() == 2
    got = {r["customer_id"]: r for r in
           dimensions.dim_customer(sheets["Customers"], "2025-06-01").collect()}
    assert set(got) == {"c1", "c2"}
    assert (got["c1"]["age"], got["c1"]["age_bucket"], got["c1"]["longitude"]) == (35, "19-35", 0)
    assert (got["c2"]["age"], got["c2"]["age_bucket"], got["c2"]["date_of_birth"]) == (0, None, None)
    risk = {r["account_status_name"]: r["risk_category"] for r in
            dimensions.dim_account_status(sheets["Accounts"]).collect()}
    assert risk == {"Arrears": "High Risk", "Complete": "Low Risk", "No Deposit": "Low Risk",
                    "Advance": "Low Risk"}
    tiers = {r["product_id"]: r["refurb_status"] for r in
             dimensions.dim_product(sheets["Products"]).collect()}
    assert tiers == {"p1": "Refurbished", "p2": "New"}


def test_fact_sales_keeps_repeated_sales(sheets):
    got = facts.fact_sales(sheets["Sales"], sheets["Accounts"], sheets["Leads"],
                           sheets["Customers"]).orderBy("sale_id").collect()
    # No account (s4) and no source (s5) drop out; the bad date stays as null.
    assert [(r["sale_id"], r["account_id"], r["sale_date"] is None) for r in got] == [
        ("s1", "a1", False), ("s2", "a1", False), ("s3", "a3", True)]


def test_snapshots(sheets):
    got = {r["account_id"]: r for r in facts.fact_accounts_snapshots(
        sheets["Accounts"], sheets["Sales"], sheets["Leads"], sheets["Customers"]).collect()}
    assert set(got) == {"a1", "a2", "a3"}
    assert got["a1"]["is_currently_in_arrears"] and not got["a3"]["is_currently_in_arrears"]
    # The source comes through a sold lead; both accounts of the lead share it.
    assert got["a1"]["lead_source_id"] == got["a2"]["lead_source_id"] != ""
    assert [got[a]["account_age_days"] for a in ("a1", "a2", "a3")] == [0, 0, 0]
    assert got["a3"]["activation_date"] is None


def test_snapshot_age_of_a_repeated_account(sheets):
    accounts = sheets["Accounts"].unionByName(
        sheets["Accounts"].where("id = 'a1'").selectExpr("* EXCEPT (created_at)",
                                                         "'2024-01-15 23:00:00' AS created_at"))
    got = facts.fact_accounts_snapshots(accounts, sheets["Sales"], sheets["Leads"],
                                        sheets["Customers"]).where("account_id = 'a1'")
    assert sorted(r["account_age_days"] for r in got.collect()) == [0, 3]


def test_installations(sheets):
    dim = dimensions.dim_customer(sheets["Customers"], "2025-01-01")
    got = facts.fact_installations(sheets["Installations"], sheets["Accounts"], sheets["Sales"],
                                   dim).orderBy("installation_id", "sale_date").collect()
    # Two sales of one account fan out; i9 has no account.
    assert [(r["installation_id"], str(r["sale_date"])) for r in got] == [
        ("i1", "2024-01-11"), ("i1", "2024-01-14"), ("i3", "None")]


def test_funnels_treat_negative_days_differently(sheets):
    plain = facts.fact_lead_funnel(sheets["Leads"], sheets["Accounts"], sheets["Sales"]).where(
        "lead_id = 'LEAD-1' AND converted_to_installation = 1").collect()
    # Lead on the 10th at noon: account after 1.5 days, sales after 0.5 and 3.5, dispatch before.
    assert sorted(r["days_to_sale"] for r in plain) == [0, 3]
    assert {(r["days_to_account"], r["days_to_dispatch"]) for r in plain} == {(1, None)}
    assert {round(r["lead_quality_score"], 4) for r in plain} == {1.0}
    numeric = facts.fact_lead_funnel_numeric(
        sheets["Leads"], sheets["Accounts"], sheets["Sales"], sheets["Installations"],
        sheets["Customers"])
    first = numeric.where("lead_id = 1 AND converted_to_installation = 1").first()
    assert (first["days_to_installation"], first["country_id"], first["lead_source_id"]) == (0, 1, 4)
    rest = {r["lead_id"]: r for r in numeric.where("lead_id > 1").collect()}
    assert (rest[2]["lead_source_id"], rest[2]["country_id"], rest[2]["converted_to_sale"]) == (
        0, 2, 0)
    assert (rest[3]["customer_id"], rest[3]["employee_id"], rest[3]["lead_quality_score"]) == (
        "", "", 0)
    assert rest[4]["lead_created_date"] is None and rest[4]["days_to_account"] is None


def test_account_and_customer_tables(sheets):
    accounts = customers.account_table(sheets)
    got = {(r["account_id"], r["sale_id"]): r for r in accounts.collect()}
    assert len(got) == 6
    a1 = got[("a1", "s1")]
    assert (a1["lead_source"], a1["product_tier"], a1["financed_amount"]) == (
        "Website", "Refurbished", 50000)
    assert (a1["installation_delay_days"], a1["days_to_sale"]) == (-3, 0)
    # Reference is the newest account, 20 January: 8 days old, 1.2 days due are held at 7.
    assert (a1["account_age_days"], a1["days_past_due"]) == (8, 7)
    assert got[("a4", None)]["country_name"] == "Unknown"
    assert got[("a4", None)]["age_bucket"] == "Unknown"
    table = {r["customer_id"]: r for r in customers.customer_aggregate(accounts).collect()}
    c1 = table["c1"]
    assert (c1["account_count"], c1["payment_type"], c1["financed_amount"]) == (3, "PAYG", 340000)
    assert c1["installation_delay_days"] == -4.5
    weights = [(0.45, 27500.0), (0.45, 27500.0), (0.8, 48000.0)]
    want = sum(p * w for p, w in weights) / sum(w for _, w in weights)
    assert c1["repayment_progress"] == pytest.approx(want)


def test_customers_are_gathered_by_one_shuffle_and_hot_ones_combined(spark, sheets):
    table = stored(customers.account_table(sheets))
    accounts = stored(table.unionByName(table.withColumns({
        "account_id": F.lit("a0"), "payment_type": F.lit(None).cast("string"),
        "product_category": F.when(F.col("account_id") == "a1", "Zebra").otherwise("Ant")})))
    got = customers.customer_aggregate(accounts)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Repartition") == 1 and plan.count("Aggregate") == 1
    want = sorted(map(str, got.collect()))
    for hot in (0, 3, 4):  # all by counts, some, and none but the largest
        assert sorted(map(str, customers.customer_aggregate(accounts, hot).collect())) == want


def test_features_of_a_frame_without_optional_columns(rows):
    df = rows([("c", 100.0, 50.0, 0.0, 10, 0, 0, 1, 20)],
              "customer_id string, financed_amount double, outstanding_balance double, "
              "arrears_balance double, days_past_due int, is_in_arrears int, is_default int, "
              "is_healthy int, account_age_days int")
    got = features.add_behavioral_features(features.add_risk_features(df)).first()
    assert (got["lead_conversion_speed"], got["install_delay_flag"]) == (None, 0)
    assert (got["lead_quality_score"], got["frequency_score"], got["monetary_score"]) == (
        0.5, 1 / 3, 1.0)


def test_segmentation_features_have_the_expected_columns(rows):
    df = rows([("c", 200000.0, "New", "PAYG", None)],
              "customer_id string, financed_amount double, product_tier string, "
              "payment_type string, gender string")
    got = features.segmentation_features(df)
    assert set(features.feature_columns()) <= set(got.columns)
    assert len(features.feature_columns()) >= 10
    row = got.first()
    assert (row["gender"], row["lead_source"], row["is_default"], row["age"]) == (
        "Unknown", "Unknown", 0, 0.0)
    assert row["financed_amount_log"] == pytest.approx(12.2060776)


def _files(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_a_load_resumes_and_refreshes_changed_months(spark, sheets, tmp_path):
    """Nothing is written again without a change; a change reaches its months alone, and the tables equal
    those of a full load."""
    def load(source, where, resume=True):
        w = Warehouse(spark, source.__getitem__, str(where), "2025-01-01", resume=resume)
        return w, {n: sorted(map(tuple, w[n].collect()), key=str) for n in TABLES}

    w, first = load(sheets, tmp_path / "a")
    assert set(w.rewritten) >= set(TABLES)
    before = _files(tmp_path / "a")
    w, again = load(sheets, tmp_path / "a")
    assert again == first and not w.rewritten and _files(tmp_path / "a") == before

    installations = sheets["Installations"]
    changed = sheets | {
        "Installations": installations.withColumn("Installation_date", F.when(
            F.col("Id") == "i3", "2024-03-02").otherwise(F.col("Installation_date"))),
        "Sales": sheets["Sales"].where("Id <> 's3'")}
    w, new = load(changed, tmp_path / "a")
    full = load(changed, tmp_path / "b", resume=False)[1]
    assert new == full and new != first
    # i3 moves from January to March; s3 had no date; the funnel loses a sale in January.
    assert w.rewritten["fact_installations"] == ["202401", "202403"]
    assert w.rewritten["mart_installation_operations"] == ["202401", "202403"]
    assert w.rewritten["fact_sales"] == [None] and "dim_customer" not in w.rewritten
    after = _files(tmp_path / "a")
    kept = [f for f in before if "/fact_sales/month=" in f and "HIVE_DEFAULT" not in f]
    assert kept and all(after[f] == before[f] for f in kept)
    assert not list((tmp_path / "a/fact_sales").glob("month=__HIVE*"))


def test_a_load_that_stops_goes_on(spark, sheets, tmp_path):
    """A table without its row of state is built again; finished ones are not."""
    w = Warehouse(spark, sheets.__getitem__, str(tmp_path), "2025-01-01", resume=True)
    w["mart_sales_performance"]
    shutil.rmtree(tmp_path / "_state/fact_sales")
    shutil.rmtree(tmp_path / "fact_sales")
    later = Warehouse(spark, sheets.__getitem__, str(tmp_path), "2025-01-01", resume=True)
    assert later["mart_sales_performance"].count() == w["mart_sales_performance"].count()
    assert set(later.rewritten) == {"fact_sales"}
    other = Warehouse(spark, sheets.__getitem__, str(tmp_path), "2024-06-01", resume=True)
    other["dim_customer"]
    assert "dim_customer" in other.rewritten  # ages are taken at another date
