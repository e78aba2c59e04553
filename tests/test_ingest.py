"""CSV load, table rules, surrogate ids, mart writes and comments."""

from __future__ import annotations

import datetime as dt
import os
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerframe.operators.validate import assert_valid, validate
from ledgerframe.plans import marts
from ledgerframe.schema import TRANSACTION_SCHEMA
from ledgerframe.sources import csv as csvsrc
from ledgerframe.sources import tables
from tests.conftest import make_fact

HEADER = "transaction_date,description,debit,credit,balance,is_suspicious\n"


def _write(text: str) -> str:
    d = tempfile.mkdtemp(prefix="lf-csv-", dir="/tmp")
    p = os.path.join(d, "t.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write(HEADER + text)
    return p


def test_csv_quoting_nulls_and_rounding(spark):
    p = _write('2024-01-01,"Shop, Inc",5.005,,10.00,0\n'
               '2024-01-02,"He said ""hi""",-5.005,1.00,10.00,1\n'
               '2024-01-03,,1.00,,10.00,0\n'
               '2024-01-04,"",1.00,,10.00,0\n')
    out = csvsrc.read_transactions(spark, p).orderBy("transaction_date").collect()
    assert out[0].description == "Shop, Inc" and out[0].debit == Decimal("5.01")
    assert out[0].credit is None
    assert out[1].description == 'He said "hi"' and out[1].debit == Decimal("-5.01")
    assert out[2].description is None  # unquoted empty -> NULL
    assert out[3].description == ""  # quoted empty -> ''
    assert out[0].transaction_date == dt.date(2024, 1, 1)


def test_csv_bad_amount_fails_the_load(spark):
    p = _write("2024-01-01,A,abc,,10.00,0\n")
    with pytest.raises(Exception):
        csvsrc.read_transactions(spark, p).collect()


def test_csv_quarantine_mode(spark):
    p = _write("2024-01-01,A,abc,,10.00,0\n2024-01-02,B,1.00,,10.00,0\n")
    df = csvsrc.read_transactions(spark, p, mode="PERMISSIVE")
    good, bad = csvsrc.split_quarantine(df)
    assert [r.description for r in good.collect()] == ["B"]
    assert [r.description for r in good.select("description").collect()] == ["B"]
    assert (good.count(), bad.count(), len(bad.collect())) == (1, 1, 1)


def test_csv_narrow_reads_fail_on_a_bad_row(spark):
    df = csvsrc.read_transactions(spark, _write("2024-01-01,A,abc,,10.00,0\n"))
    for narrow in (df.select("description"), df.groupBy().count()):
        with pytest.raises(Exception):
            narrow.collect()


def test_csv_line_break_inside_quotes(spark):
    p = _write('2024-01-01,"a\nb",1.00,,10.00,0\n')
    assert csvsrc.read_transactions(spark, p, multi_line=True).first().description == "a\nb"


def test_load_numbers_rows_in_file_order(spark):
    from ledgerframe.plans import jobs

    root = tempfile.mkdtemp(prefix="lf-order-", dir="/tmp")
    at = 0
    for name, n in (("a", 500), ("b", 20000), ("c", 3000)):
        with open(os.path.join(root, f"{name}.csv"), "w", encoding="utf-8") as f:
            f.write(HEADER + "".join(f"2024-01-01,r{at + i + 1},1.00,,1.00,0\n" for i in range(n)))
        at += n
    out = tempfile.mkdtemp(prefix="lf-order-", dir="/tmp")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")  # several splits a file
    try:
        jobs.load_transactions(spark, root, path=os.path.join(out, "fact"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    fact = spark.read.parquet(os.path.join(out, "fact"))
    assert fact.count() == at
    assert fact.where(F.concat(F.lit("r"), F.col("transaction_id")) != F.col("description")).count() == 0


def test_rules_report_violations(spark):
    f = make_fact(spark, [("2024-01-01", "x" * 256, "1.00", None, "1.00", 2),
                          ("2024-01-01", "A", "1.00", None, "1.00", None)])
    dup = f.union(f.limit(1))
    r = validate(dup).first()
    assert (r.flag_violations, r.length_violations, r.duplicate_ids, r.duplicate_rows) == (2, 2, 1, 2)
    with pytest.raises(ValueError):
        assert_valid(f)
    assert_valid(make_fact(spark, [("2024-01-01", "A", "1.00", None, "1.00", None)]))


def test_dense_surrogate_ids_follow_input_order(spark):
    df = spark.range(0, 1000, numPartitions=7).select(F.col("id").alias("x"))
    out = tables.with_surrogate_id(df, dense=True).collect()
    assert sorted(r.transaction_id for r in out) == list(range(1, 1001))
    assert all(r.transaction_id == r.x + 1 for r in out)
    sparse = tables.with_surrogate_id(df).select("transaction_id").distinct().count()
    assert sparse == 1000


def test_load_and_mart_round_trip(spark, hand):
    root = tempfile.mkdtemp(prefix="lf-tables-", dir="/tmp")
    fact_path = os.path.join(root, "fact")
    src = hand.drop("transaction_id")
    tables.load(src, path=fact_path)
    fact = spark.read.parquet(fact_path)
    assert sorted(r.transaction_id for r in fact.collect()) == list(range(1, 16))
    assert tables.load_report(fact).first().loaded_rows == 15
    mart = marts.anomaly_mart(fact, updated_at="2002-01-01")
    mpath = os.path.join(root, "mart")
    tables.write_mart(mart, path=mpath, sort_by=["day"], num_files=3)
    back = spark.read.parquet(mpath)
    a = [tuple(r) for r in marts.mart_by_month(back).collect()]
    b = [tuple(r) for r in marts.mart_by_month(mart).collect()]
    assert a == b


def test_catalog_table_comments(spark, hand):
    name = "lf_test_daily"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    tables.write_mart(marts.daily_mart(hand, updated_at="2002-01-01"), name=name)
    title, cols = marts.MART_COMMENTS[marts.DAILY_MART]
    tables.comment(spark, name, title, cols)
    desc = {r.col_name: r.comment for r in spark.sql(f"DESCRIBE TABLE {name}").collect()}
    assert desc["transactions_ma7"] == cols["transactions_ma7"]
    assert marts.daily_mart_count(spark.table(name)).first().rows_in_mart == 9
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_load_job_and_mart_rebuild(spark):
    from ledgerframe.plans import jobs

    p = _write("2024-01-01,A,99.99,,10.00,0\n2024-01-01,A,100.00,,10.00,1\n"
               "2024-01-02,B,,70.00,10.00,0\n2024-01-03,,1.00,,,\n")
    root = tempfile.mkdtemp(prefix="lf-job-", dir="/tmp")
    rep = jobs.load_transactions(spark, p, path=os.path.join(root, "fact"))
    assert rep.first().loaded_rows == 4
    fact = spark.read.parquet(os.path.join(root, "fact"))
    assert sorted(r.transaction_id for r in fact.collect()) == [1, 2, 3, 4]
    out = jobs.rebuild_marts(fact, root=os.path.join(root, "marts"), as_of="2025-01-01",
                             updated_at="2025-01-01T00:00:00")
    assert out[marts.DAILY_MART].first().rows_in_mart == 3
    assert out[marts.CATEGORY_MART].first().categories == 0  # no category has > 5 rows
    assert out[marts.ANOMALY_MART].first().rows_in_mart == 3
    # catalog flavour: tables with comments, load rejects rule violations
    spark.sql("DROP TABLE IF EXISTS lf_fact_job")
    assert jobs.load_transactions(spark, p, table="lf_fact_job").first().loaded_rows == 4
    bad = _write("2024-01-01,A,1.00,,10.00,2\n")
    with pytest.raises(ValueError):
        jobs.load_transactions(spark, bad, table="lf_fact_job")
    assert spark.table("lf_fact_job").count() == 4  # the failed load left the table intact
    tables.ensure_table(spark, "lf_fact_job")  # idempotent
    spark.sql("DROP TABLE IF EXISTS lf_fact_job")


def test_command_line(spark, hand, capsys):
    from ledgerframe.__main__ import main

    root = tempfile.mkdtemp(prefix="lf-cli-", dir="/tmp")
    hand.write.parquet(os.path.join(root, "fact"))
    assert main(["list"]) == 0
    assert "q04_rfm" in capsys.readouterr().out
    assert main(["query", "--fact", os.path.join(root, "fact"), "q01_overall",
                 "--as-of", "2025-01-01", "--show", "3"]) == 0
    assert "total_transactions" in capsys.readouterr().out
    assert main(["query", "--fact", os.path.join(root, "fact"), "no_such_query"]) == 2


def test_load_job_removes_its_staging_copy(spark):
    from ledgerframe.plans import jobs
    from ledgerframe.session import checkpoint_dir

    root = checkpoint_dir(spark).replace("file:", "")
    before = {d for d in os.listdir(root) if d.startswith("ledgerframe-staging-")} \
        if os.path.isdir(root) else set()
    p = _write("2024-01-01,A,1.00,,10.00,0\n")
    out = tempfile.mkdtemp(prefix="lf-stage-", dir="/tmp")
    assert jobs.load_transactions(spark, p, path=os.path.join(out, "fact")).first().loaded_rows == 1
    after = {d for d in os.listdir(root) if d.startswith("ledgerframe-staging-")}
    assert after == before


def test_csv_custom_date_format(spark):
    p = _write("07.01.2024,A,1.00,,10.00,0\n")
    out = csvsrc.read_transactions(spark, p, date_format="dd.MM.yyyy").first()
    assert out.transaction_date == dt.date(2024, 1, 7)


def test_mart_written_with_year_partitions(spark, hand):
    root = tempfile.mkdtemp(prefix="lf-part-", dir="/tmp")
    mart = marts.daily_mart(hand, updated_at="2002-01-01")
    tables.write_mart(mart, path=os.path.join(root, "daily"), sort_by=["transaction_date"],
                      partition_by=["year"])
    dirs = sorted(d for d in os.listdir(os.path.join(root, "daily")) if d.startswith("year="))
    assert dirs == ["year=2024", "year=2025", "year=__HIVE_DEFAULT_PARTITION__"]
    back = spark.read.parquet(os.path.join(root, "daily"))
    assert back.count() == mart.count()
    assert back.where("year = 2025").count() == 1  # partition pruning on the lookup key


@pytest.mark.parametrize("ids", [[1, 2, 3, 4], [1, 2, 2, 3, 2], [5, 32768, 32769, 32768, -1, -1, 0], [None, 1, None, 2], [None, 1, 2], [], [7],
                                 [1, 10**15, 1], [2**62, -2**62, 2**62], [-40000, -40000, 40000]])
def test_key_rule_by_bitmaps_counts_repeated_ids(spark, ids):
    rows = [(i, None, "x" * 256 if n == 0 else "a", None, None, None, 2 if n == 1 else 0) for n, i in enumerate(ids)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TRANSACTION_SCHEMA.fields)
    got = validate(spark.createDataFrame(rows, schema).repartition(3)).first().asDict()
    times = {i: ids.count(i) for i in ids}
    assert got == {"checked_rows": len(ids), "flag_violations": int(len(ids) > 1), "length_violations": int(len(ids) > 0),
                   "precision_violations": 0, "duplicate_ids": sum(n > 1 for n in times.values()),
                   "duplicate_rows": sum(n for n in times.values() if n > 1)}


def test_key_rule_moves_bitmaps_not_ids(spark):
    t = spark.range(200_000).select(F.col("id").alias("transaction_id"), *[F.lit(None).cast(x.dataType).alias(x.name)
                                                                           for x in TRANSACTION_SCHEMA.fields[1:]])
    out = validate(t)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in plan
    assert out.first()["checked_rows"] == 200_000 and out.first()["duplicate_ids"] == 0
