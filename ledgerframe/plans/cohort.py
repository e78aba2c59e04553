"""Weekly cohort retention of categories.

A category's cohort is the ISO week (Monday start) of its first date.
For every cohort: its size (categories), and for week numbers 0..periods-1
the share of the cohort active in that week and the transactions in it.

The week number is, by default, the difference of ISO week-of-year
numbers (``week_distance='iso_week'``), as in the original report: it
ignores the year, so activity a year later in the same ISO week counts
as week 0 and weeks across New Year go negative; same-number weeks of
different years are merged before the pivot. ``week_distance='elapsed'``
uses whole weeks elapsed instead.

Plan: one aggregation of the fact table to (category, activity week);
the cohort week is the minimum activity week per category (truncation
to weeks is monotone, so it equals the week of the first date), taken
by a window over that small frame, whose groups are bounded by the
number of weeks, not by the rows of a hot category. The fact table is
scanned once; there is no self-join and no join with the cohort sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.operators.rollup import Measures

from ledgerframe.functions import calendar as cal
from ledgerframe.functions.exact import as_count, percent
from ledgerframe.operators.window import asc


def category_weeks(t: DataFrame) -> DataFrame:
    """(description, activity_week, transactions, cohort_week) for known categories and dates."""
    m = Measures(t)
    cw = t.where(F.col("description").isNotNull() & F.col("transaction_date").isNotNull()) \
        .groupBy("description", cal.week_start("transaction_date").alias("activity_week")) \
        .agg(m.rows().alias("transactions"))
    return cw.withColumn("cohort_week",
                         F.min("activity_week").over(Window.partitionBy("description")))


def cohort_retention(t: DataFrame, periods: int = 5, week_distance: str = "iso_week") -> DataFrame:
    cw = category_weeks(t)
    if week_distance == "iso_week":
        wn = cal.iso_week("activity_week") - cal.iso_week("cohort_week")
    elif week_distance == "elapsed":
        wn = F.floor(F.datediff("activity_week", "cohort_week") / 7).cast("bigint")
    else:
        raise ValueError("week_distance must be 'iso_week' or 'elapsed'")

    # Per category first: the frame is already hash-partitioned by category
    # (the cohort window), so this level needs no shuffle, and afterwards
    # each category appears once per (cohort week, week number), making the
    # active-category count a plain count instead of a COUNT(DISTINCT).
    # A category has exactly one (category, week) row in its own cohort
    # week, so counting those rows gives the cohort size in the same pass:
    # no second pass over the frame and no join.
    per_cat = cw.groupBy("description", "cohort_week", wn.alias("week_number")).agg(
        F.sum("transactions").alias("transactions"),
        F.count(F.when(F.col("activity_week") == F.col("cohort_week"), 1)).alias("__first"),
    )
    ret = per_cat.groupBy("cohort_week", "week_number").agg(
        F.count(F.lit(1)).alias("active_categories"),
        F.sum("transactions").alias("total_transactions"),
        F.sum("__first").alias("__firsts"),
    )
    pivot = [
        F.max(F.when(F.col("week_number") == k, F.col(src))).alias(f"__{src}_{k}")
        for src in ("active_categories", "total_transactions")
        for k in range(periods)
    ]
    out = ret.groupBy("cohort_week").agg(F.sum("__firsts").alias("cohort_size"), *pivot)
    pct = [
        percent(f"__active_categories_{k}", "cohort_size", zero_is_null=False).alias(f"week_{k}_pct")
        for k in range(periods)
    ]
    txns = [as_count(f"__total_transactions_{k}").alias(f"week_{k}_txns") for k in range(periods)]
    return out.select(
        cal.date_str("cohort_week").alias("cohort_week"),
        as_count("cohort_size").alias("cohort_size"),
        *pct,
        *txns,
    ).orderBy(asc("cohort_week"))
