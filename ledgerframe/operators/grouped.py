"""Grouped aggregate building blocks over a transaction DataFrame.

Aggregates are expressed as (sum, count) pairs so that means, rates and
shares can be finished exactly after the shuffle (``functions.exact``);
Spark plans them as partial + final hash aggregation, so a hot group is
combined map-side and never travels as raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.operators.rollup import Measures

from ledgerframe.functions import calendar as cal
from ledgerframe.functions.exact import as_count, mean, money, percent
from ledgerframe.operators.window import asc, share_of_total, sort_bounded

FLAG = "is_suspicious"


def count_rows() -> Column:
    return F.count(F.lit(1))


def flagged(value: int = 1) -> Column:
    """SUM(CASE WHEN flag = value THEN 1 ELSE 0 END): 0, never NULL."""
    return F.sum(F.when(F.col(FLAG) == value, 1).otherwise(0))


def sum_count(col: str, prefix: str | None = None, when: Column | None = None) -> list[Column]:
    """[SUM(x) AS __s_p, COUNT(x) AS __n_p] for an exact mean later."""
    p = prefix or col
    x = F.col(col) if when is None else F.when(when, F.col(col))
    return [F.sum(x).alias(f"__s_{p}"), F.count(x).alias(f"__n_{p}")]


def mean_of(prefix: str, digits: int = 2, scale: int = 2) -> Column:
    return mean(f"__s_{prefix}", f"__n_{prefix}", digits, scale=scale)


def stats_by(t: DataFrame, key: str = FLAG, count_alias: str = "transaction_count",
             order: bool = True, bounded: bool | None = None) -> DataFrame:
    """Per key: count, share of all rows %, mean debit/credit/balance, min/max balance.

    ``bounded`` says the key has a small fixed set of values (default: only
    for the 0/1 flag), so the result is gathered into one partition; for
    any other key the share uses a broadcast one-row total and the sort is
    distributed.
    """
    if bounded is None:
        bounded = key == FLAG
    g = t.groupBy(key).agg(
        count_rows().alias("__cnt"),
        *sum_count("debit"),
        *sum_count("credit"),
        *sum_count("balance"),
        F.min("balance").alias("__minb"),
        F.max("balance").alias("__maxb"),
    )
    g = share_of_total(g, "__cnt", "percentage", bounded=bounded)
    out = g.select(
        F.col(key),
        as_count("__cnt").alias(count_alias),
        "percentage",
        mean_of("debit").alias("avg_debit"),
        mean_of("credit").alias("avg_credit"),
        mean_of("balance").alias("avg_balance"),
        money("__minb").alias("min_balance"),
        money("__maxb").alias("max_balance"),
    )
    if not order:
        return out
    return sort_bounded(out, [asc(key)]) if bounded else out.orderBy(asc(key))


def by_weekday(
    t: DataFrame,
    name_col: str = "day_of_week",
    number_col: str = "dow_number",
    total_col: str = "total_transactions",
    flagged_col: str = "suspicious_count",
    pct_col: str = "suspicious_percentage",
    flag_mode: str = "case",
    with_means: bool = False,
) -> DataFrame:
    """Per weekday name and number (Sunday = 0): totals, flagged, flagged %.

    ``flag_mode='case'`` counts rows with flag = 1 (never NULL);
    ``flag_mode='sum'`` is SUM(flag), which skips NULL flags.
    """
    m = Measures(t)
    flag_agg = m.flagged(1) if flag_mode == "case" else m.sum(FLAG)
    extra = [*m.sum_count("debit"), *m.sum_count("credit")] if with_means else []
    g = t.groupBy(
        cal.day_name("transaction_date").alias(name_col),
        cal.day_of_week("transaction_date").alias(number_col),
    ).agg(m.rows().alias("__cnt"), flag_agg.alias("__flag"), *extra)
    cols = [
        F.col(name_col),
        F.col(number_col),
        as_count("__cnt").alias(total_col),
        as_count("__flag").alias(flagged_col),
        percent("__flag", "__cnt", zero_is_null=False).alias(pct_col),
    ]
    if with_means:
        cols += [mean_of("debit").alias("avg_debit"), mean_of("credit").alias("avg_credit")]
    return sort_bounded(g.select(*cols), [asc(number_col)])


def daily(t: DataFrame, aggs: Sequence[Column], key: Column | None = None,
          name: str = "transaction_date") -> DataFrame:
    """GROUP BY day (NULL dates form one group of their own)."""
    k = key if key is not None else F.col("transaction_date")
    return t.groupBy(k.alias(name)).agg(*aggs)


def monthly(t: DataFrame, aggs: Sequence[Column], name: str = "__month") -> DataFrame:
    """GROUP BY DATE_TRUNC('month', date), keyed by the month's first day."""
    return t.groupBy(cal.month_start("transaction_date").alias(name)).agg(*aggs)
