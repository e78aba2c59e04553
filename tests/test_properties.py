"""Invariants of the reports on the sf0.01 fixture, and randomised ranking checks."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerframe.operators import ranking
from ledgerframe.plans import marts, reports, rfm
from ledgerframe.sources.fixture import load_fact
from tests.conftest import SF01

AS_OF = dt.date(2002, 1, 1)


@pytest.fixture(scope="module")
def fact(spark):
    return load_fact(spark, SF01).cache()


@pytest.fixture(scope="module")
def totals(fact):
    return fact.agg(F.count(F.lit(1)).alias("n"), F.sum("debit").alias("debit"),
                    F.sum("credit").alias("credit"), F.sum("is_suspicious").alias("flags")).first()


def test_flagged_plus_normal_is_total(fact):
    assert fact.where(F.col("is_suspicious").isNull()).count() == 0
    m = marts.anomaly_mart(fact, updated_at=AS_OF)
    bad = m.where(F.col("suspicious_count") + F.col("normal_count") != F.col("total_transactions"))
    assert bad.count() == 0


def test_shares_sum_to_100(fact):
    for df, col in ((reports.stats_by(fact), "percentage"), (reports.amount_bands(fact), "percentage")):
        vals = [r[col] for r in df.collect()]
        assert abs(sum(vals) - 100) <= Decimal("0.005") * len(vals)


def test_running_totals_end_at_grand_totals(fact, totals):
    rows = reports.cumulative_daily(fact).collect()
    last = rows[-1]
    assert last.cumulative_transactions == totals.n
    assert last.cumulative_debits == totals.debit
    assert last.cumulative_credits == totals.credit
    monthly = reports.monthly_cumulative(fact).collect()
    assert monthly[-1].cumulative_txns == totals.n


def test_mart_sums_equal_fact_sums(fact, totals):
    d = marts.daily_mart(fact, updated_at=AS_OF).agg(
        F.sum("transactions").alias("n"), F.sum("total_debit").alias("debit"),
        F.sum("suspicious_count").alias("flags")).first()
    assert (d.n, d.debit, d.flags) == (totals.n, totals.debit, totals.flags)
    a = marts.anomaly_mart(fact, updated_at=AS_OF).agg(
        F.sum("total_transactions").alias("n"),
        (F.sum("suspicious_debit") + F.sum("normal_debit")).alias("debit")).first()
    assert (a.n, a.debit) == (totals.n, totals.debit)


def test_ntile_buckets_differ_by_at_most_one(fact):
    out = rfm.rfm(fact, as_of=AS_OF, n=None)
    for axis in ("r_score", "f_score", "m_score"):
        sizes = [r["count"] for r in out.groupBy(axis).count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.one_of(st.none(), st.integers(-3, 3)), min_size=1, max_size=60),
       parts=st.integers(1, 9), buckets=st.integers(1, 7))
def test_random_rank_and_ntile(spark, values, parts, buckets):
    df = spark.createDataFrame([(f"k{i:03d}", v) for i, v in enumerate(values)], "k string, v long")
    key, tb = F.col("v").desc_nulls_first(), F.col("k").asc_nulls_last()
    got = ranking.rank(df, key, "v", "r", tiebreak="k", n_parts=parts)
    exp = df.withColumn("r", F.rank().over(Window.orderBy(key)))
    assert sorted(got.collect()) == sorted(exp.collect())
    got = ranking.ntile(df, buckets, key, tb, "t", n_parts=parts)
    exp = df.withColumn("t", F.ntile(buckets).over(Window.orderBy(key, tb)))
    assert sorted(got.collect()) == sorted(exp.collect())


def test_marts_from_one_shared_rollup_equal_direct_builds(fact):
    r = marts.day_category_rollup(fact).cache()
    pairs = [
        (marts.daily_mart(fact, updated_at=AS_OF), marts.daily_mart(None, updated_at=AS_OF, rollup=r)),
        (marts.category_mart(fact, as_of=AS_OF, updated_at=AS_OF),
         marts.category_mart(None, as_of=AS_OF, updated_at=AS_OF, rollup=r)),
        (marts.anomaly_mart(fact, updated_at=AS_OF), marts.anomaly_mart(None, updated_at=AS_OF, rollup=r)),
    ]
    for direct, shared in pairs:
        a = [tuple(x) for x in direct.collect()]
        b = [tuple(x) for x in shared.collect()]
        assert a == b and len(a) > 400


def test_reports_on_the_rollup_equal_reports_on_the_fact(fact):
    from ledgerframe.operators.rollup import day_category_rollup
    from ledgerframe.plans.catalog import CATALOG, ROLLUP_KEYS

    r = day_category_rollup(fact).cache()

    def key(row):
        return tuple((x is None, repr(x)) for x in row)

    for name in sorted(ROLLUP_KEYS):
        a = sorted((tuple(x) for x in CATALOG[name](fact).collect()), key=key)
        b = sorted((tuple(x) for x in CATALOG[name](r).collect()), key=key)
        assert a == b, name


def test_run_reports_job(fact):
    from ledgerframe.plans import jobs

    out = jobs.run_reports(fact, keys=["q01_overall", "q06_large", "m03_monthly"])
    assert out["q01_overall"].first().total_transactions == 15000
    assert out["q06_large"].count() == 20 and out["m03_monthly"].count() == 81
