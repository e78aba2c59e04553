"""Stored marts: the manifest, rebuilds that fail half-way, layout, counts from footers."""

from __future__ import annotations

import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from ledgerframe.functions import labels as L
from ledgerframe.plans import catalog, jobs, marts
from ledgerframe.sources import manifest, tables
from ledgerframe.sources.fixture import load_fact
from tests.conftest import SF001


@pytest.fixture
def fact_path(spark, hand):
    path = os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "fact")
    hand.coalesce(1).write.parquet(path)
    return path


def counting(monkeypatch):
    built = []
    write = marts.write_mart

    def counted(*a, **k):
        built.append(k["path"])
        return write(*a, **k)

    monkeypatch.setattr(marts, "write_mart", counted)
    return built


def test_eight_read_backs_store_three_marts(spark, fact_path, monkeypatch):
    built = counting(monkeypatch)
    got = {k: catalog.CATALOG[k](spark.read.parquet(fact_path)).collect() for k in catalog.READ_BACKS}
    assert len(built) == 3
    builds = catalog.mart_builds()
    t = spark.read.parquet(fact_path)
    for k, (mart, read) in catalog.READ_BACKS.items():
        assert got[k] == read(builds[mart](t)).collect(), k
    manifest._KNOWN.clear()  # as another session would: the manifest alone knows
    catalog.CATALOG["m01_count"](t).collect()
    assert len(built) == 3


def test_a_changed_fact_or_clock_is_built_anew(spark, fact_path, hand, monkeypatch):
    built = counting(monkeypatch)
    count = lambda: catalog.CATALOG["m01_count"](spark.read.parquet(fact_path)).first()[0]
    before = count()
    assert count() == before and len(built) == 1
    catalog.catalog("2003-01-01")["m01_count"](spark.read.parquet(fact_path)).collect()
    assert len(built) == 2
    time.sleep(1.1)
    hand.withColumn("transaction_date", F.lit("2030-01-01").cast("date")).coalesce(1).write.mode("append").parquet(fact_path)
    assert count() == before + 1 and len(built) == 3
    # rows in memory have no files by which they could be known again
    for n in (4, 5):
        catalog.CATALOG["m01_count"](hand).collect()
        assert len(built) == n


def test_a_mart_cleaned_away_is_built_anew(spark, fact_path, monkeypatch):
    t = spark.read.parquet(fact_path)
    clock = {"as_of": "a", "updated_at": "b"}
    build = lambda x: marts.daily_mart(x, updated_at="2002-01-01")
    built = counting(monkeypatch)
    first = marts.stored_mart(marts.DAILY_MART, t, build, **clock).collect()
    os.rename(built[0].removeprefix("file:"), built[0].removeprefix("file:") + "-away")
    assert sorted(marts.stored_mart(marts.DAILY_MART, t, build, **clock).collect(), key=str) == sorted(first, key=str) and len(built) == 2


def failing(df):
    """``df`` whose later rows fail while they are written."""
    n = F.sum(F.lit(1)).over(marts_window())
    return df.withColumn(df.columns[0], F.when(n > 3, F.raise_error(F.lit("lost")).cast(df.schema[0].dataType)).otherwise(F.col(df.columns[0])))


def marts_window():
    from pyspark.sql import Window

    return Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def test_a_rebuild_that_fails_half_way_leaves_the_old_mart(spark, fact_path, monkeypatch):
    root = os.path.join(os.path.dirname(fact_path), "marts")
    names = {m: f"{m}_half" for m in marts.MART_LAYOUT}
    t = spark.read.parquet(fact_path)
    jobs.rebuild_marts(t, root=root, as_of="2025-01-01", updated_at="2025-01-01")
    jobs.rebuild_marts(t, as_of="2025-01-01", updated_at="2025-01-01", names=names)
    old = marts.open_mart(spark, root, marts.DAILY_MART).collect()
    assert sorted(spark.table(names[marts.DAILY_MART]).collect(), key=str) == sorted(old, key=str) and len(old) == 9
    build = marts.daily_mart
    monkeypatch.setattr(marts, "daily_mart", lambda *a, **k: failing(build(*a, **k)))
    for where in ({"root": root}, {"names": names}):
        with pytest.raises(Exception, match="lost"):
            jobs.rebuild_marts(t, as_of="2025-01-01", updated_at="2026-01-01", **where)
    assert marts.open_mart(spark, root, marts.DAILY_MART).collect() == old
    assert sorted(spark.table(names[marts.DAILY_MART]).collect(), key=str) == sorted(old, key=str)
    monkeypatch.setattr(marts, "daily_mart", build)
    jobs.rebuild_marts(t, as_of="2025-01-01", updated_at="2026-01-01", names=names)
    assert {r["updated_at"].year for r in spark.table(names[marts.DAILY_MART]).collect()} == {2026}


def test_a_load_that_fails_leaves_the_old_table(spark, fact_path):
    folder = os.path.dirname(fact_path)
    csv = os.path.join(folder, "a.csv")
    with open(csv, "w") as f:
        f.write("transaction_date,description,debit,credit,balance,is_suspicious\n2024-01-01,A,1.00,,2.00,0\n")
    jobs.load_transactions(spark, csv, table="lf_half_load")
    with open(csv, "a") as f:
        f.write("2024-01-01,A,x,,2.00,0\n")
    with pytest.raises(Exception):
        jobs.load_transactions(spark, csv, table="lf_half_load")
    assert spark.table("lf_half_load").count() == 1
    assert spark.sql("DESCRIBE TABLE EXTENDED lf_half_load").where("col_name = 'Comment'").first()[1] == L.FACT_TABLE_COMMENT


def test_counts_come_from_footers(spark, fact_path):
    counted = tables.footer_count(spark, fact_path, "n")
    assert counted.first()["n"] == 15
    plan = counted._jdf.queryExecution().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_command_line_reads_stored_marts(spark, fact_path, capsys, monkeypatch):
    from ledgerframe import __main__ as cli

    root = os.path.join(os.path.dirname(fact_path), "cli-marts")
    assert cli.main(["marts", "--fact", fact_path, "--out", root]) == 0
    built = counting(monkeypatch)
    assert cli.main(["query", "--fact", fact_path, "--marts", root, "m01_count", "m03_monthly", "q01_overall"]) == 0
    out = capsys.readouterr().out
    assert not built and "m01_count" in out and "q01_overall" in out


def test_stored_marts_keep_columns_rows_and_layout(spark):
    t = load_fact(spark, SF001)
    for name, build in catalog.mart_builds().items():
        mart = build(t)
        stored = marts.stored_mart(name, t, lambda _, m=mart: m, as_of="layout")
        assert stored.dtypes == mart.dtypes
        assert sorted(map(str, stored.collect())) == sorted(map(str, mart.collect()))
        part = marts.MART_LAYOUT[name]["partition_by"][0]
        assert all(f"{part}=" in f for f in stored.inputFiles())
