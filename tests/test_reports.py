"""Hand-made rows (FIXTURES.md §3) exercising each semantic trap of the reports."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from ledgerframe.plans import cohort, marts, reports, rfm
from ledgerframe.schema import TRANSACTION_SCHEMA
from tests.conftest import make_fact

AS_OF = dt.date(2002, 1, 1)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_amount_band_edges_and_order(hand):
    out = rows(reports.amount_bands(hand))
    assert [r["debit_range"] for r in out] == ["0-100", "100-500", "500-1000", "1000-5000",
                                               "5000+", "No debit"]
    assert [r["transactions"] for r in out] == [7, 2, 1, 1, 3, 1]
    # each share is rounded on its own: the sum is 100 within 0.005 per group
    assert abs(sum(r["percentage"] for r in out) - 100) <= Decimal("0.005") * len(out)
    assert out[0]["suspicious_rate"] == Decimal("0.0000")  # NULL flag is skipped by AVG
    assert out[1]["suspicious_rate"] == Decimal("0.5000")


def test_weekday_name_padding_and_sunday_zero(hand):
    out = {r["dow_number"]: r for r in rows(reports.weekday_flags(hand))}
    assert out[0]["day_of_week"] == "Sunday   "
    assert len(out[3]["day_of_week"]) == 9 and out[3]["day_of_week"] == "Wednesday"
    assert None in out and out[None]["day_of_week"] is None  # NULL date group


def test_risk_band_edges(hand):
    out = {r["amount_category"]: r["total"] for r in rows(reports.risk_bands(hand))}
    # 10000.00 and NULL debit are micro; 10000.01 is small
    assert out["Малые (10k-50k)"] == 1
    assert out["Микро (<10k)"] == 14


def test_credit_only_category_volume_zero(hand):
    m = {r["category"]: r for r in rows(marts.category_mart(hand, as_of=AS_OF, min_rows=0))}
    assert m["C"]["total_volume"] == Decimal("0.00")  # COALESCE(NULL + 70, 0)
    assert m["C"]["total_credit"] == Decimal("70.00")
    assert m["C"]["total_debit"] == Decimal("0.00")
    r = {x["category"]: x for x in rows(rfm.rfm(hand, as_of=AS_OF, min_rows=0, n=None))}
    assert r["C"]["total_amount"] == Decimal("70.00")


def test_daily_net_flow_zero_when_one_side_null(hand):
    m = {r["transaction_date"]: r for r in rows(marts.daily_mart(hand, updated_at="2002-01-01"))}
    day = m[dt.date(2024, 1, 1)]
    assert day["total_debit"] == Decimal("199.99") and day["total_credit"] == Decimal("0.00")
    assert day["net_flow"] == Decimal("0.00")
    assert m[dt.date(2024, 1, 7)]["net_flow"] == Decimal("19999.01")
    # NULL date is one group, ordered last: its 7-row average spans the 6 days before it
    assert None in m


def test_first_last_null_date_and_ties(hand):
    out = {r["description"]: r for r in rows(reports.first_last(hand))}
    assert out["D"]["first_txn_date"] == dt.date(2024, 1, 5)
    assert out["D"]["first_amount"] == Decimal("-5.00")
    assert out["D"]["last_txn_date"] is None and out["D"]["days_active"] is None
    assert out["D"]["last_amount"] == Decimal("1.00")
    assert out["A"]["first_amount"] == Decimal("99.99")  # tie on date: lower id first
    assert out["A"]["last_amount"] == Decimal("500.00")
    assert None not in out


def test_cohort_year_blind_weeks(hand):
    out = {r["cohort_week"]: r for r in rows(cohort.cohort_retention(hand))}
    assert set(out) == {"2024-01-01", "2024-01-08"}
    a = out["2024-01-01"]
    assert a["cohort_size"] == 4 and a["week_0_pct"] == Decimal("100.00") and a["week_0_txns"] == 10
    e = out["2024-01-08"]
    # 2025-01-08 is ISO week 2 like 2024-01-08: counted as week 0; 2024-12-30 is week -1
    assert e["cohort_size"] == 1 and e["week_0_txns"] == 2
    assert e["week_1_pct"] is None
    el = {r["cohort_week"]: r for r in rows(cohort.cohort_retention(hand, week_distance="elapsed"))}
    assert el["2024-01-08"]["week_0_txns"] == 1


def test_anomaly_mart_null_flag_and_null_category(hand):
    m = {r["day"]: r for r in rows(marts.anomaly_mart(hand, updated_at="2002-01-01"))}
    day = m[dt.date(2024, 1, 8)]
    assert (day["total_transactions"], day["suspicious_count"], day["normal_count"]) == (2, 0, 1)
    assert day["normal_categories"] == 0 and day["suspicious_categories"] == 0
    assert day["suspicious_categories_share"] is None
    assert day["day_name"] == "Monday   " and day["day_of_week"] == 1


def test_period_change_zero_previous_month(spark):
    f = make_fact(spark, [("2024-01-10", "A", "0.00", None, "1.00", 0),
                          ("2024-02-10", "A", "5.00", None, "1.00", 0)])
    guarded = rows(reports.monthly_dynamics(f))
    assert guarded[1]["growth_pct"] is None
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|divide by zero|Division by zero"):
        reports.period_change(f).collect()
    assert rows(reports.period_change(f, safe=True))[1]["debit_growth_pct"] is None


def test_ntile_seven_into_five(spark):
    data = [("2024-01-0%d" % (i + 1), c, "1.00", None, "1.00", 0)
            for i, c in enumerate("ABCDEFG") for _ in range(6)]
    f = make_fact(spark, data)
    out = rows(rfm.rfm(f, as_of=AS_OF, n=None))
    sizes = sorted(sum(1 for r in out if r["r_score"] == b) for b in range(1, 6))
    assert sorted(sizes, reverse=True) == [2, 2, 1, 1, 1]
    by_cat = {r["category"]: r["r_score"] for r in out}
    assert by_cat["G"] == 1 and by_cat["F"] == 1 and by_cat["A"] == 5  # most recent is best


def test_empty_input(spark):
    f = spark.createDataFrame([], TRANSACTION_SCHEMA)
    assert reports.overall_stats(f).first()["total_transactions"] == 0
    assert reports.top_days(f).count() == 0
    assert marts.daily_mart(f).count() == 0
    dash = reports.dashboard(f).first()
    assert dash["total_transactions"] == 0 and dash["avg_daily_txns"] is None
    assert rfm.rfm(f, as_of=AS_OF).count() == 0
    assert cohort.cohort_retention(f).count() == 0


def test_kpi_text_values(hand):
    out = {r["metric_name"]: r for r in rows(reports.kpis_long(hand))}
    assert len(out) == 10
    assert out["Всего транзакций"]["value"] == "15"
    assert out["Период"]["value"] == "2024-01-01 - 2025-01-08"
    assert out["Общий кредит"]["value"] == "71.00" and out["Общий кредит"]["unit"] == "руб"


def test_rollup_grain_matches_fact_grain_on_edge_rows(hand):
    """NULL dates, categories and flags survive the (day, category) pre-aggregate."""
    from ledgerframe.operators.rollup import day_category_rollup
    from ledgerframe.plans.catalog import CATALOG, ROLLUP_KEYS

    r = day_category_rollup(hand).cache()

    def key(row):
        return tuple((x is None, repr(x)) for x in row)

    for name in sorted(ROLLUP_KEYS):
        a = sorted((tuple(x) for x in CATALOG[name](hand).collect()), key=key)
        b = sorted((tuple(x) for x in CATALOG[name](r).collect()), key=key)
        assert a == b, name


def test_rfm_invert_scores_makes_five_the_best(spark):
    data = [("2024-01-0%d" % (i + 1), c, "1.00", None, "1.00", 0)
            for i, c in enumerate("ABCDEFG") for _ in range(6)]
    f = make_fact(spark, data)
    plain = {r["category"]: r["r_score"] for r in rows(rfm.rfm(f, as_of=AS_OF, n=None))}
    inv = {r["category"]: r["r_score"] for r in rows(rfm.rfm(f, as_of=AS_OF, n=None,
                                                             invert_scores=True))}
    assert plain["G"] == 1 and inv["G"] == 5  # G is the most recent category
    assert plain["A"] == 5 and inv["A"] == 1
