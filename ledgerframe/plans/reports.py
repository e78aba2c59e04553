"""Analytic reports over the transaction fact table.

Each function takes the fact DataFrame ``t`` (``schema.TRANSACTION_SCHEMA``)
and returns a DataFrame. Column names and thresholds are parameters
whose defaults equal the original reports. Where the original order is
ambiguous on ties, the group key (or the transaction id) is the last
sort key, so results are deterministic.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.operators.rollup import Measures, day_category_rollup, is_rollup

from ledgerframe.functions import calendar as cal
from ledgerframe.functions import labels as L
from ledgerframe.functions.exact import (
    UNROUNDED_SCALE,
    as_count,
    div_round,
    mean,
    money,
    percent,
    sql_ref,
)
from ledgerframe.operators.bands import above_band, range_band
from ledgerframe.operators.grouped import (
    FLAG,
    by_weekday,
    daily,
    mean_of,
    monthly,
    stats_by,
    sum_count,
)
from ledgerframe.operators.ranking import decimal_slice, fraction_key, ranks_desc
from ledgerframe.operators.window import (
    asc,
    desc,
    growth_pct,
    moving_mean,
    previous,
    running_sum,
    share_of_total,
    sort_bounded,
    top_k,
)
from ledgerframe.session import staged


def _as_of(as_of) -> Column:
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = _dt.date.fromisoformat(as_of)
    return F.lit(as_of)


# ------------------------------------------------------------------ basic stats
def overall_stats(t: DataFrame) -> DataFrame:
    """One row: count, first/last date, distinct categories, debit/credit sums, mean balance."""
    m = Measures(t)
    return t.agg(
        m.rows().alias("total_transactions"),
        F.min("transaction_date").alias("first_date"),
        F.max("transaction_date").alias("last_date"),
        as_count(F.countDistinct("description")).alias("unique_categories"),
        money(m.sum("debit")).alias("total_debits"),
        money(m.sum("credit")).alias("total_credits"),
        mean(m.sum("balance"), m.count("balance"), 2, scale=2).alias("avg_balance"),
    )


def top_days(t: DataFrame, n: int = 10) -> DataFrame:
    """The n days with the largest debit sum (NULL sums last)."""
    m = Measures(t)
    d = daily(t, [m.rows().alias("transactions_count"),
                  money(m.sum("debit")).alias("total_debit"),
                  money(m.sum("credit")).alias("total_credit")])
    return top_k(d, [F.col("total_debit").desc_nulls_last(), asc("transaction_date")], n)


# -------------------------------------------------------------- detailed stats
def amount_bands(t: DataFrame, bands=L.DEBIT_BANDS, else_label: str = L.NO_DEBIT_LABEL) -> DataFrame:
    """Count, share % and flag rate (4 dp) per debit band, by smallest debit (NULL last)."""
    m = Measures(t)
    g = t.groupBy(range_band("debit", bands, else_label).alias("debit_range")).agg(
        m.rows().alias("transactions"),
        m.sum(FLAG).alias("__fs"),
        m.count(FLAG).alias("__fn"),
        F.min("debit").alias("__min_debit"),
    )
    g = share_of_total(g, "transactions", "percentage", bounded=True)  # six bands
    out = g.select(
        "debit_range",
        as_count("transactions").alias("transactions"),
        "percentage",
        mean("__fs", "__fn", 4).alias("suspicious_rate"),
        "__min_debit",
    )
    return sort_bounded(out, [asc("__min_debit"), asc("debit_range")]).drop("__min_debit")


def weekday_flags(t: DataFrame) -> DataFrame:
    return by_weekday(t)


def daily_moving_average(t: DataFrame, sizes=(7, 30)) -> DataFrame:
    """Daily count with its moving averages over the last N rows (days present)."""
    m = Measures(t)
    d = daily(t, [m.rows().alias("daily_transactions")])
    order = [asc("transaction_date")]
    keys = ["transaction_date"]
    cols = [moving_mean("daily_transactions", keys, n, 2).alias(f"moving_avg_{n}days") for n in sizes]
    return d.select("transaction_date", as_count("daily_transactions").alias("daily_transactions"),
                    *cols).orderBy(*order)


def top_flagged(t: DataFrame, n: int = 10, min_rows: int = 10) -> DataFrame:
    """n descriptions by flagged % among those with more than ``min_rows`` rows."""
    m = Measures(t)
    g = t.groupBy("description").agg(m.rows().alias("total_count"),
                                     m.flagged(1).alias("suspicious_count"))
    g = g.where(F.col("total_count") > min_rows).select(
        "description",
        as_count("total_count").alias("total_count"),
        as_count("suspicious_count").alias("suspicious_count"),
        percent("suspicious_count", "total_count", zero_is_null=False).alias("suspicious_percentage"),
    )
    return top_k(g, [desc("suspicious_percentage"), asc("description")], n)


def cumulative_daily(t: DataFrame) -> DataFrame:
    """Daily count, debit, credit and their running totals."""
    m = Measures(t)
    d = daily(t, [m.rows().alias("trans_count"),
                  money(m.sum("debit")).alias("total_debit"),
                  money(m.sum("credit")).alias("total_credit")])
    order = [asc("transaction_date")]
    keys = ["transaction_date"]
    return d.select(
        "transaction_date",
        as_count("trans_count").alias("trans_count"),
        "total_debit",
        "total_credit",
        as_count(running_sum("trans_count", keys)).alias("cumulative_transactions"),
        money(running_sum("total_debit", keys)).alias("cumulative_debits"),
        money(running_sum("total_credit", keys)).alias("cumulative_credits"),
    ).orderBy(*order)


# ---------------------------------------------------------- big categories
def big_categories(t: DataFrame, min_volume=L.BIG_CATEGORY_VOLUME, as_of=None) -> DataFrame:
    """Profile of categories whose debit+credit volume exceeds ``min_volume``.

    One aggregation: the volume filter of the IN-subquery is a HAVING on the
    same groups (a NULL description never matches IN, so it is dropped).
    """
    m = Measures(t)
    vol = m.volume()
    g = (
        t.where(F.col("description").isNotNull())
        .groupBy(F.col("description").alias("category"))
        .agg(
            m.rows().alias("transaction_count"),
            F.min("transaction_date").alias("first_seen"),
            F.max("transaction_date").alias("last_seen"),
            *m.sum_count("debit"),
            *m.sum_count("credit"),
            vol.alias("__vol"),
        )
        .where(F.col("__vol") > F.lit(min_volume))
    )
    sd, sc = F.col("__s_debit"), F.col("__s_credit")
    out = g.select(
        "category",
        as_count("transaction_count").alias("transaction_count"),
        "first_seen",
        "last_seen",
        cal.days_between(_as_of(as_of), F.col("last_seen")).alias("days_since_last"),
        mean_of("debit").alias("avg_debit"),
        mean_of("credit").alias("avg_credit"),
        money(sd).alias("total_debit"),
        money(sc).alias("total_credit"),
        F.when(sc > 0, div_round(sd, sc, 2, num_scale=2, den_scale=2)).alias("debit_credit_ratio"),
        (sd + sc).alias("__order"),
    )
    return out.orderBy(desc("__order"), asc("category")).drop("__order")


# ---------------------------------------------------------- suspicious analysis
def flag_stats(t: DataFrame) -> DataFrame:
    return stats_by(t, FLAG, count_alias="count", order=False)


def monthly_flag_trend(t: DataFrame) -> DataFrame:
    """Per YYYY-MM: total, flagged, rate %, mean debit of flagged and of normal rows."""
    m = Measures(t)
    g = t.groupBy(cal.month_key("transaction_date").alias("month")).agg(
        m.rows().alias("__cnt"),
        m.flagged(1).alias("__flagged"),
        m.sum(FLAG).alias("__fs"),
        *m.debit_where_flag(1, "sd"),
        *m.debit_where_flag(0, "nd"),
    )
    return g.select(
        "month",
        as_count("__cnt").alias("total_transactions"),
        as_count("__flagged").alias("suspicious_count"),
        percent("__fs", "__cnt", zero_is_null=False).alias("suspicious_rate"),
        mean_of("sd").alias("avg_suspicious_debit"),
        mean_of("nd").alias("avg_normal_debit"),
    ).orderBy(asc("month"))


def top_flagged_detail(t: DataFrame, n: int = 20, min_rows: int = 10) -> DataFrame:
    """n descriptions by flagged %, > ``min_rows`` rows and at least one flagged."""
    m = Measures(t)
    g = t.groupBy("description").agg(
        m.rows().alias("total"),
        m.sum(FLAG).alias("suspicious"),
        *m.sum_count("debit"),
        *m.sum_count("credit"),
    ).where((F.col("total") > min_rows) & (F.col("suspicious") > 0))
    out = g.select(
        "description",
        as_count("total").alias("total"),
        as_count("suspicious").alias("suspicious"),
        percent("suspicious", "total", zero_is_null=False).alias("suspicious_pct"),
        mean_of("debit").alias("avg_debit"),
        mean_of("credit").alias("avg_credit"),
    )
    return top_k(out, [desc("suspicious_pct"), asc("description")], n)


def weekday_flag_sums(t: DataFrame) -> DataFrame:
    return by_weekday(t, "day_of_week", "dow", "total", "suspicious", "suspicious_pct",
                      flag_mode="sum")


def large_flagged(t: DataFrame, min_debit=L.LARGE_DEBIT, n: int = 20) -> DataFrame:
    """The n largest flagged rows with debit above ``min_debit``."""
    rows = t.where((F.col(FLAG) == 1) & (F.col("debit") > F.lit(min_debit)))
    return top_k(rows, [desc("debit"), asc("transaction_id")], n).select(
        "transaction_date", "description", "debit", "credit", "balance")


# ---------------------------------------------------------- window analyses
def daily_moving(t: DataFrame) -> DataFrame:
    """Daily count/debit/flag rate with 7- and 30-row moving averages."""
    m = Measures(t)
    d = daily(t, [m.rows().alias("__cnt"), m.sum("debit").alias("__debit"),
                  m.sum(FLAG).alias("__fs"), m.count(FLAG).alias("__fn")])
    d = d.withColumn("__rate", mean("__fs", "__fn", UNROUNDED_SCALE))
    order = [asc("transaction_date")]
    keys = ["transaction_date"]
    return d.select(
        "transaction_date",
        as_count("__cnt").alias("daily_transactions"),
        moving_mean("__cnt", keys, 7, 2).alias("moving_avg_7days"),
        moving_mean("__cnt", keys, 30, 2).alias("moving_avg_30days"),
        money("__debit").alias("daily_debit"),
        moving_mean("__debit", keys, 7, 2, scale=2).alias("debit_moving_avg"),
        F.col("__rate").alias("daily_suspicious_rate"),
        moving_mean("__rate", keys, 7, 4, scale=UNROUNDED_SCALE).alias("suspicious_moving_avg"),
    ).orderBy(*order)


def rank_categories(t: DataFrame, n: int | None = 30, min_rows: int = 5) -> DataFrame:
    """Categories (> ``min_rows`` rows) ranked by debit, frequency and risk; top n by debit rank (all if n is None)."""
    m = Measures(t)
    g = t.groupBy("description").agg(
        m.rows().alias("txn_count"),
        m.sum("debit").alias("__sd"),
        m.sum("credit").alias("__sc"),
        m.sum(FLAG).alias("__fs"),
        m.count(FLAG).alias("__fn"),
    ).where(F.col("txn_count") > min_rows)
    g = staged(g, "ranking")  # the total and the ranks read it
    cents = F.when(F.col("__sd").isNotNull(), F.array((F.col("__sd") * 100).cast("decimal(38,0)")))
    g = share_of_total(g, "txn_count", "pct_of_total_txns")
    g = ranks_desc(g, {
        "debit_rank": (cents, decimal_slice((F.col("__sd") * 100).cast("decimal(38,0)"))),
        "frequency_rank": (F.array("txn_count"), decimal_slice(F.col("txn_count"))),
        # exact for any denominator; slices of a thousandth
        "risk_rank": (fraction_key("__fs", "__fn"),
                      F.when(F.col("__fn") > 0, F.floor(F.col("__fs") * 1000 / F.col("__fn")))),
    })
    out = g.select(
        "description",
        as_count("txn_count").alias("txn_count"),
        money("__sd").alias("total_debit"),
        money("__sc").alias("total_credit"),
        percent("__fs", "__fn").alias("suspicious_pct"),
        "debit_rank",
        "frequency_rank",
        "risk_rank",
        "pct_of_total_txns",
    )
    order = [asc("debit_rank"), asc("description")]
    return top_k(out, order, n) if n else out.orderBy(*order)


def monthly_cumulative(t: DataFrame) -> DataFrame:
    """Monthly totals, running totals and a 3-row moving average of the count."""
    m = Measures(t)
    m = monthly(t, [m.rows().alias("__cnt"), m.sum("debit").alias("__sd"),
                    m.sum("credit").alias("__sc"), m.sum(FLAG).alias("__fs")])
    order = [asc("__month")]
    keys = ["__month"]
    return m.select(
        cal.month_key("__month").alias("month"),
        as_count("__cnt").alias("monthly_txns"),
        money("__sd").alias("monthly_debit"),
        money("__sc").alias("monthly_credit"),
        as_count("__fs").alias("monthly_suspicious"),
        as_count(running_sum("__cnt", keys)).alias("cumulative_txns"),
        money(running_sum("__sd", keys)).alias("cumulative_debit"),
        money(running_sum("__sc", keys)).alias("cumulative_credit"),
        as_count(moving_mean("__cnt", keys, 3, 0)).alias("avg_last_3_months"),
        "__month",
    ).orderBy(*order).drop("__month")


def period_change(t: DataFrame, safe: bool = False) -> DataFrame:
    """Month vs previous month: previous values and growth % (unguarded by default)."""
    m = Measures(t)
    m = monthly(t, [m.rows().alias("__cnt"), m.sum("debit").alias("__sd")])
    order = [asc("__month")]
    keys = ["__month"]
    return m.select(
        cal.month_key("__month").alias("month"),
        as_count("__cnt").alias("txns"),
        money("__sd").alias("total_debit"),
        as_count(previous("__cnt", keys)).alias("prev_month_txns"),
        money(previous("__sd", keys)).alias("prev_month_debit"),
        growth_pct("__cnt", keys, 2, safe=safe).alias("txn_growth_pct"),
        growth_pct("__sd", keys, 2, scale=2, safe=safe).alias("debit_growth_pct"),
        "__month",
    ).orderBy(*order).drop("__month")


def first_last(t: DataFrame, key: str = "description", order: str = "transaction_date",
               value: str = "debit", tiebreak: str = "transaction_id", n: int = 30) -> DataFrame:
    """Per key: first and last date and value, days between, change; top n by days active.

    Rows are ordered by ``order`` with NULLs last, then ``tiebreak``; the
    first row is the smallest, the last row the largest in that order (so
    a key with a NULL date has a NULL last date). Computed with
    min_by/max_by hash aggregates, which combine map-side: no sort of the
    fact table and no hot-key partition. The tie-break must be a unique
    integer below 10^24 (the transaction id).
    """
    # (date IS NULL, date, id) packed into one exact DECIMAL(38,0) order key:
    # null flag * 10^36 + (epoch day + 500000) * 10^24 + id. Fixed-width
    # aggregation buffers let Spark use hash aggregation (a struct key would
    # fall back to sorting each task's fact rows by category).
    o = F.expr(
        f"CAST(IF({sql_ref(order)} IS NULL, 1, 0) AS DECIMAL(38,0)) * 1000000000000000000000000000000000000"
        f" + CAST(coalesce(unix_date({sql_ref(order)}), 0) + 500000 AS DECIMAL(38,0))"
        f" * 1000000000000000000000000 + CAST({sql_ref(tiebreak)} AS DECIMAL(38,0))")
    g = t.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min_by(F.col(order), o).alias("__first_d"), F.min_by(F.col(value), o).alias("__first_v"),
        F.max_by(F.col(order), o).alias("__last_d"), F.max_by(F.col(value), o).alias("__last_v"))
    out = g.select(
        F.col(key),
        F.col("__first_d").alias("first_txn_date"),
        money("__first_v").alias("first_amount"),
        F.col("__last_d").alias("last_txn_date"),
        money("__last_v").alias("last_amount"),
        cal.days_between(F.col("__last_d"), F.col("__first_d")).alias("days_active"),
        money(F.col("__last_v") - F.col("__first_v")).alias("amount_change"),
    )
    return top_k(out, [F.col("days_active").desc_nulls_last(), asc(key)], n)


# ---------------------------------------------------------- business insights
def kpis_long(t: DataFrame) -> DataFrame:
    """Ten headline KPIs in long form (group, name, text value, unit).

    Two distinct counts expand every row they read, so they read the (day,
    category) rollup instead of the fact.
    """
    t = t if is_rollup(t) else day_category_rollup(t)
    m = Measures(t)
    a = t.agg(
        F.coalesce(m.rows(), F.lit(0)).alias("total_txns"),  # no rows sum to null in a rollup
        F.countDistinct("description").alias("total_categories"),
        F.countDistinct("transaction_date").alias("active_days"),
        F.min("transaction_date").alias("first_date"),
        F.max("transaction_date").alias("last_date"),
        m.sum("debit").alias("total_debit"),
        m.sum("credit").alias("total_credit"),
        m.sum(FLAG).alias("total_suspicious"),
        *m.sum_count("debit"),
        *m.sum_count("credit"),
    )
    s = lambda c: c.cast("string")
    values = [
        s(F.col("total_txns")),
        s(F.col("total_categories")),
        s(F.col("active_days")),
        F.concat(s(F.col("first_date")), F.lit(L.PERIOD_SEPARATOR), s(F.col("last_date"))),
        s(money("total_debit")),
        s(money("total_credit")),
        s(mean_of("debit")),
        s(mean_of("credit")),
        s(F.col("total_suspicious")),
        s(percent("total_suspicious", "total_txns", zero_is_null=False)),
    ]
    rows = [
        F.struct(F.lit(L.KPI_GROUP).alias("metric_group"), F.lit(name).alias("metric_name"),
                 v.alias("value"), F.lit(unit).alias("unit"))
        for (name, unit), v in zip(L.KPI_ROWS, values)
    ]
    return a.select(F.inline(F.array(*rows)))


def monthly_dynamics(t: DataFrame) -> DataFrame:
    """Monthly totals, distinct categories, flagged %, guarded debit growth %."""
    m = Measures(t)
    m = monthly(t, [m.rows().alias("__cnt"), F.countDistinct("description").alias("__cats"),
                    *m.sum_count("debit"), m.sum("credit").alias("__sc"), m.sum(FLAG).alias("__fs")])
    order = [asc("__month")]
    keys = ["__month"]
    return m.select(
        cal.month_key("__month").alias("month"),
        as_count("__cnt").alias("transactions"),
        as_count("__cats").alias("categories"),
        money("__s_debit").alias("total_debit"),
        money("__sc").alias("total_credit"),
        mean_of("debit").alias("avg_debit"),
        as_count("__fs").alias("suspicious_count"),
        percent("__fs", "__cnt", zero_is_null=False).alias("suspicious_pct"),
        growth_pct("__s_debit", keys, 2, scale=2, safe=True).alias("growth_pct"),
        "__month",
    ).orderBy(*order).drop("__month")


def top_categories(t: DataFrame, n: int = 10, min_rows: int = 10) -> DataFrame:
    """n categories (> ``min_rows`` rows) by debit sum, NULL sums last."""
    m = Measures(t)
    g = t.groupBy(F.col("description").alias("category")).agg(
        m.rows().alias("__cnt"), *m.sum_count("debit"), m.sum("credit").alias("__sc"),
        m.sum(FLAG).alias("__fs"),
    ).where(F.col("__cnt") > min_rows)
    out = g.select(
        "category",
        as_count("__cnt").alias("txn_count"),
        money("__s_debit").alias("total_debit"),
        money("__sc").alias("total_credit"),
        mean_of("debit").alias("avg_debit"),
        as_count("__fs").alias("suspicious_count"),
        percent("__fs", "__cnt", zero_is_null=False).alias("suspicious_pct"),
        F.col("__s_debit").alias("__order"),
    )
    return top_k(out, [F.col("__order").desc_nulls_last(), asc("category")], n).drop("__order")


def weekday_profile(t: DataFrame) -> DataFrame:
    return by_weekday(t, "day_of_week", "dow", "total_txns", "suspicious_txns", "suspicious_pct",
                      flag_mode="sum", with_means=True)


def day_of_month_profile(t: DataFrame) -> DataFrame:
    """Per day of month: row count (named avg_transactions), means, flagged %."""
    m = Measures(t)
    g = t.groupBy(cal.day_of_month("transaction_date").alias("day_of_month")).agg(
        m.rows().alias("__cnt"), *m.sum_count("debit"), *m.sum_count("credit"),
        m.sum(FLAG).alias("__fs"), m.count(FLAG).alias("__fn"))
    g = g.select(
        "day_of_month",
        as_count("__cnt").alias("avg_transactions"),
        mean_of("debit").alias("avg_debit"),
        mean_of("credit").alias("avg_credit"),
        percent("__fs", "__fn").alias("avg_suspicious_pct"),
    )
    return sort_bounded(g, [asc("day_of_month")])


def risk_bands(t: DataFrame, bands=L.RISK_AMOUNT_BANDS, levels=L.RISK_LEVELS) -> DataFrame:
    """Four debit bands with flagged %, then a risk level from the rounded %."""
    m = Measures(t)
    g = t.groupBy(above_band("debit", bands, L.RISK_AMOUNT_ELSE).alias("amount_category")).agg(
        m.rows().alias("__cnt"), m.sum(FLAG).alias("__fs"))
    g = g.select(
        "amount_category",
        as_count("__cnt").alias("total"),
        as_count("__fs").alias("suspicious"),
        percent("__fs", "__cnt", zero_is_null=False).alias("risk_percentage"),
    )
    g = g.withColumn("risk_level", above_band("risk_percentage", levels, L.RISK_LEVEL_ELSE))
    return sort_bounded(g, [desc("risk_percentage"), asc("amount_category")])


def dashboard(t: DataFrame) -> DataFrame:
    """One row of seven headline numbers, from a single pass over the fact table.

    The mean of daily counts is rows / day groups, where the day groups
    are the distinct dates plus one group for NULL dates if any. The two
    distinct counts expand the (day, category) rollup, not the fact.
    """
    t = t if is_rollup(t) else day_category_rollup(t)
    m = Measures(t)
    day_groups = F.countDistinct("transaction_date") + F.max(
        F.when(F.col("transaction_date").isNull(), 1).otherwise(0))
    a = t.agg(
        F.coalesce(m.rows(), F.lit(0)).alias("__cnt"),
        F.countDistinct("description").alias("__cats"),
        *m.sum_count("debit"),
        m.sum(FLAG).alias("__fs"),
        m.flagged(1).alias("__flagged"),
        day_groups.alias("__days"),
    )
    return a.select(
        as_count("__cnt").alias("total_transactions"),
        as_count("__cats").alias("unique_categories"),
        mean_of("debit").alias("overall_avg_debit"),
        percent("__fs", "__cnt", zero_is_null=False).alias("overall_risk_pct"),
        as_count("__flagged").alias("total_suspicious"),
        money("__s_debit").alias("total_volume"),
        div_round(F.col("__cnt"), F.col("__days"), 2).alias("avg_daily_txns"),
    )

