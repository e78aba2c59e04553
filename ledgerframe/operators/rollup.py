"""The (day, category) pre-aggregate and grain-agnostic aggregate measures.

Most reports only need sums and counts per day or per category, so they
can run either on the fact table or on ``day_category_rollup(fact)``,
which is much smaller than the fact wherever a category has several
transactions a day. ``Measures`` gives each report the right aggregate
for the grain it is handed: ``rows()`` is COUNT(*) on the fact and
SUM(n) on the rollup, ``sum("debit")`` is SUM(debit) or SUM(s_debit),
and so on. Both grains keep the fact's ``transaction_date`` and
``description`` columns, so grouping code is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAG = "is_suspicious"

ROLLUP_COLUMNS = ("n", "s_debit", "n_debit", "s_flag", "n_flag", "n_f1")


def is_rollup(df: DataFrame) -> bool:
    """True for a ``day_category_rollup`` frame (as opposed to the fact table)."""
    return set(ROLLUP_COLUMNS) <= set(df.columns)


def day_category_rollup(t: DataFrame) -> DataFrame:
    """(day, category) pre-aggregate from which the marts and most reports derive.

    One row per day and category with the sums, counts and flagged/normal
    splits the marts need. Per-day category counts and per-category day
    counts become plain row counts over it (no COUNT(DISTINCT), no
    Expand), and both levels aggregate map-side, so a hot category or day
    never travels as raw rows. ``rebuild_marts`` materialises it once and
    derives the three marts from it: one scan of the fact table.
    """
    f1 = F.col(FLAG) == 1
    f0 = F.col(FLAG) == 0
    return t.groupBy("transaction_date", "description").agg(
        F.count(F.lit(1)).alias("n"),
        *[a for c in ("debit", "credit", "balance")
          for a in (F.sum(c).alias(f"s_{c}"), F.count(c).alias(f"n_{c}"))],
        F.sum(FLAG).alias("s_flag"),
        F.count(FLAG).alias("n_flag"),
        F.sum(F.coalesce(F.col("debit"), F.lit(0)) + F.coalesce(F.col("credit"), F.lit(0)))
        .alias("s_volume"),
        F.sum(F.when(f1, 1).otherwise(0)).alias("n_f1"),
        F.sum(F.when(f0, 1).otherwise(0)).alias("n_f0"),
        # SUM(CASE WHEN flag = k THEN amount ELSE 0 END)
        F.sum(F.when(f1, F.col("debit")).otherwise(0)).alias("sd_f1"),
        F.sum(F.when(f0, F.col("debit")).otherwise(0)).alias("sd_f0"),
        F.sum(F.when(f1, F.col("credit")).otherwise(0)).alias("sc_f1"),
        F.sum(F.when(f0, F.col("credit")).otherwise(0)).alias("sc_f0"),
        # debit sum and count of flagged / normal rows only, for their means
        F.sum(F.when(f1, F.col("debit"))).alias("__s_d_f1"),
        F.count(F.when(f1, F.col("debit"))).alias("__n_d_f1"),
        F.sum(F.when(f0, F.col("debit"))).alias("__s_d_f0"),
        F.count(F.when(f0, F.col("debit"))).alias("__n_d_f0"),
    )


class Measures:
    """Aggregate expressions for the fact table or its (day, category) rollup."""

    def __init__(self, df: DataFrame):
        self.rollup = is_rollup(df)

    def rows(self) -> Column:
        """COUNT(*) of transactions."""
        return F.sum("n") if self.rollup else F.count(F.lit(1))

    def sum(self, col: str) -> Column:
        """SUM(col) for debit, credit, balance or the flag (NULL when all NULL)."""
        name = "flag" if col == FLAG else col
        return F.sum(f"s_{name}") if self.rollup else F.sum(col)

    def count(self, col: str) -> Column:
        """COUNT(col): non-NULL values of debit, credit, balance or the flag."""
        name = "flag" if col == FLAG else col
        return F.sum(f"n_{name}") if self.rollup else F.count(col)

    def flagged(self, value: int = 1) -> Column:
        """SUM(CASE WHEN flag = value THEN 1 ELSE 0 END)."""
        if self.rollup:
            return F.sum(f"n_f{value}")
        return F.sum(F.when(F.col(FLAG) == value, 1).otherwise(0))

    def volume(self) -> Column:
        """SUM(COALESCE(debit, 0) + COALESCE(credit, 0))."""
        if self.rollup:
            return F.sum("s_volume")
        return F.sum(F.coalesce(F.col("debit"), F.lit(0)) + F.coalesce(F.col("credit"), F.lit(0)))

    def sum_count(self, col: str, prefix: str | None = None) -> list[Column]:
        """[SUM(col) AS __s_p, COUNT(col) AS __n_p] for an exact mean later."""
        p = prefix or col
        return [self.sum(col).alias(f"__s_{p}"), self.count(col).alias(f"__n_{p}")]

    def debit_where_flag(self, value: int, prefix: str) -> list[Column]:
        """Sum and count of the debit of rows with flag = value (AVG(CASE ...) parts)."""
        if self.rollup:
            return [F.sum(f"__s_d_f{value}").alias(f"__s_{prefix}"),
                    F.sum(f"__n_d_f{value}").alias(f"__n_{prefix}")]
        x = F.when(F.col(FLAG) == value, F.col("debit"))
        return [F.sum(x).alias(f"__s_{prefix}"), F.count(x).alias(f"__n_{prefix}")]
