"""How the bindings read and write the given tables."""

from bindings import sheets
from ledgerfield.plans.warehouse import Warehouse
from ledgerfield.sources.readers import stored_bytes

ROOT = "/root/testdata/sf0.001"


def _round_robin(df) -> bool:
    return "Repartition" in df._jdf.queryExecution().optimizedPlan().toString()


def test_large_tables_are_read_without_a_shuffle(spark, monkeypatch):
    """A small table is dealt over the cores; one beyond the limit is read in its splits, with the same rows."""
    small = sheets._table(spark, ROOT, "orders")
    monkeypatch.setattr(sheets, "DEALT_BYTES", 0)
    large = sheets._table(spark, ROOT, "orders")
    assert _round_robin(small) and not _round_robin(large)
    assert small.exceptAll(large).isEmpty() and large.exceptAll(small).isEmpty()


def test_bytes_of_files_and_folders(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "t"))
    parts = [p.stat().st_size for p in (tmp_path / "t").glob("*.parquet")]
    assert len(parts) == 3 and stored_bytes(spark, str(tmp_path / "t")) == sum(parts)


def test_lines_are_combined_once_for_both_sheets(spark):
    """Accounts and Installations read one written table of first lines, not the lines themselves."""
    for name in ("Accounts", "Installations"):
        files = sheets.BUILDERS[name](spark, ROOT).inputFiles()
        assert not [f for f in files if "lineitem" in f] and [f for f in files if "/operators/" in f]


def test_named_sheets_alone_are_written(spark, tmp_path):
    w = Warehouse(spark, lambda name: sheets.BUILDERS[name](spark, ROOT), str(tmp_path), "2025-01-01",
                  store_sheets=["Departments"])
    written = {n: w.sheet(n) for n in ("Departments", "Users")}
    assert (tmp_path / "sheets/Departments").exists() and not (tmp_path / "sheets/Users").exists()
    assert all(df.count() == sheets.BUILDERS[n](spark, ROOT).count() for n, df in written.items())
