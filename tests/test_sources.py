"""Readers and sinks on temporary folders."""

import pytest

from ledgerfield.operators.quality import ValidationError, not_null, run_checks
from ledgerfield.sources import catalog, readers, scratch, sinks
from ledgerfield.sources.schemas import RAW_SCHEMAS


def test_sheets_from_csv(rows, spark, tmp_path):
    rows([("d1", "Field"), ("d2", None)], RAW_SCHEMAS["Departments"]).write.option(
        "header", True).csv(str(tmp_path / "Departments"))
    got = readers.read_sheets(spark, str(tmp_path), ["Departments"], "csv")["Departments"]
    assert got.columns == ["Id", "name"] and got.count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_sheets(spark, str(tmp_path), ["Users"])


def test_resolve_input_prefers_the_complete_one(rows, spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    rows([(1,)], "a int").write.parquet(str(one / "A"))
    for name in "AB":
        rows([(1,)], "a int").write.parquet(str(two / name))
    pick = lambda *paths: readers.resolve_input(spark, [str(p) for p in paths], ["A", "B"])
    assert pick(tmp_path / "none", one, two) == str(two)
    assert pick(tmp_path / "none", one) == str(one)
    with pytest.raises(FileNotFoundError):
        pick(tmp_path / "none")


def test_month_folders_are_pruned(rows, spark, tmp_path):
    df = rows([(i, f"2024-{m:02d}-15") for i, m in enumerate([1, 2, 2, 3, 12])],
              "id int, day string").selectExpr("id", "cast(day AS date) AS day")
    path = sinks.write_by_month(df, str(tmp_path / "t"), "day", ["id"])
    got = sinks.read_months(spark, path, "day", "2024-02-01", "2024-03-14")
    assert sorted(r["id"] for r in got.collect()) == [1, 2]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_load_stops_on_failed_checks(rows, tmp_path):
    df = rows([(1,), (None,)], "id int")
    report = run_checks(df, [not_null("id")])
    write = lambda d: sinks.write_parquet(d, str(tmp_path / "t"))
    with pytest.raises(ValidationError, match="id has no nulls"):
        sinks.load_checked(df, report, write)
    assert not (tmp_path / "t").exists()
    sinks.load_checked(df, report, write, skip_validation=True)
    assert (tmp_path / "t").exists()


def test_select_only(rows, spark):
    rows([(i,) for i in range(250)], "i int").createOrReplaceTempView("numbers_250")
    result = catalog.run_select(spark, " select i from numbers_250 ; ")
    assert (result.columns, len(result.rows), result.row_count, result.truncated) == (
        ["i"], 200, 250, True)
    for bad in ("DROP TABLE numbers_250", "WITH a AS (SELECT 1) SELECT * FROM a"):
        with pytest.raises(ValueError):
            catalog.run_select(spark, bad)


def test_scratch_follows_the_named_folder(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        assert scratch.checkpoint_root(spark) == named.rstrip("/")
    assert scratch.scratch_path(spark, "a").startswith(scratch.checkpoint_root(spark) + "/")
