"""What the plans of the load carry and how often they run."""

import pytest

from bindings import sheets
from ledgerfield.plans import facts
from ledgerfield.plans.warehouse import Warehouse

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw(spark):
    return {name: sheets.BUILDERS[name](spark, ROOT) for name in (
        "Accounts", "Sales", "Leads", "Customers", "Installations")}


def _joins(df) -> list[str]:
    """Every join of the plan with all that lies below it."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    found = []
    for i, line in enumerate(lines):
        if line.lstrip(" :+-").startswith("Join "):
            below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            found.append("\n".join(lines[i:below]))
    return found


def test_sales_and_installations_are_joined_last(raw):
    """Their columns pass one shuffle before the last one, those of the account the earlier ones."""
    sold = facts.fact_sales(raw["Sales"], raw["Accounts"], raw["Leads"], raw["Customers"])
    assert len([j for j in _joins(sold) if "AS sale_id" in j]) == 1
    funnel = facts.fact_lead_funnel_numeric(*[raw[n] for n in (
        "Leads", "Accounts", "Sales", "Installations", "Customers")])
    assert len([j for j in _joins(funnel) if "AS lead_text" in j]) == 2


def test_source_of_a_repeated_lead(spark, raw):
    """The smallest source of a sold lead counts, whichever of its sales comes first."""
    lead = raw["Leads"].where("Source IS NOT NULL")
    doubled = lead.unionByName(lead.selectExpr("* EXCEPT (Source)", "'A first' AS Source"))
    got = facts.fact_accounts_snapshots(raw["Accounts"], raw["Sales"], doubled, raw["Customers"])
    assert got.where("lead_source_id <> ''").select("lead_source_id").distinct().count() == 1


def test_first_load_takes_digests_from_written_months(spark, tmp_path, monkeypatch):
    """The plan of a table runs once in a first load; months are then read where they lie."""
    seen = []
    taken = Warehouse._months
    monkeypatch.setattr(Warehouse, "_months", lambda self, df, date: seen.append(df.inputFiles()) or taken(
        self, df, date))
    w = Warehouse(spark, lambda name: sheets.BUILDERS[name](spark, ROOT), str(tmp_path), "2025-01-01",
                  resume=True)
    first = w["fact_sales"].count()
    assert seen and all("/fact_sales/month=" in f for files in seen for f in files)
    again = Warehouse(spark, lambda name: sheets.BUILDERS[name](spark, ROOT), str(tmp_path), "2025-01-01",
                      resume=True)
    assert again["fact_sales"].count() == first and again.rewritten == {} and len(seen) == 1
