"""Ordered (window) operators over aggregated time series.

Every window here runs over an already aggregated frame (one row per
day, month or week), so its size is bounded by the calendar, not by
the fact table: ``Window.orderBy`` without a partition key is a single
small task even at 100 TB. Row frames count rows present, not calendar
days (a missing day is skipped), as SQL ``ROWS`` frames do.

SQL orders NULL last ascending; each order here says so explicitly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.functions.exact import div_round, div_round_sql, percent, sql_ref


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def asc(c) -> Column:
    """SQL ascending order: NULLs last."""
    return _c(c).asc_nulls_last()


def desc(c) -> Column:
    """SQL descending order: NULLs first."""
    return _c(c).desc_nulls_first()


def ordered(order: Sequence[Column | str], partition: Sequence[str] = ()) -> Window:
    cols = [o if isinstance(o, Column) else asc(o) for o in order]
    w = Window.orderBy(*cols)
    return w.partitionBy(*partition) if partition else w


def _names(value, order, partition) -> bool:
    return isinstance(value, str) and all(isinstance(o, str) for o in order) and all(
        isinstance(p, str) for p in partition)


def over_sql(order: Sequence[str], partition: Sequence[str] = (), frame: str = "") -> str:
    """OVER clause text; names order ascending with NULLs last (SQL's default)."""
    part = f"PARTITION BY {', '.join(sql_ref(p) for p in partition)} " if partition else ""
    cols = ", ".join(f"{sql_ref(o)} ASC NULLS LAST" for o in order)
    return f"OVER ({part}ORDER BY {cols}{' ' + frame if frame else ''})"


def _rows(rows: int) -> str:
    return f"ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW"


def moving_mean(value, order: Sequence, rows: int, digits: int, scale: int = 0,
                partition: Sequence[str] = ()) -> Column:
    """Exact AVG(value) OVER (ORDER BY .. ROWS rows-1 PRECEDING .. CURRENT ROW).

    NULL values are skipped; a frame of only NULLs gives NULL. With column
    names for ``value`` and ``order`` the whole expression is one SQL string.
    """
    if _names(value, order, partition):
        w = over_sql(order, partition, _rows(rows))
        v = sql_ref(value)
        return F.expr(div_round_sql(f"sum({v}) {w}", f"count({v}) {w}", digits, num_scale=scale))
    w = ordered(order, partition).rowsBetween(-(rows - 1), Window.currentRow)
    return div_round(F.sum(_c(value)).over(w), F.count(_c(value)).over(w), digits,
                     num_scale=scale)


def moving_deviation(value, order: Sequence, rows: int, digits: int,
                     partition: Sequence[str] = ()) -> Column:
    """round(value - AVG(value) OVER rows frame, digits) from the unrounded mean.

    value - s/n = (value*n - s)/n, exact for an integer ``value``.
    """
    if _names(value, order, partition):
        w = over_sql(order, partition, _rows(rows))
        v = sql_ref(value)
        return F.expr(div_round_sql(f"{v} * count({v}) {w} - sum({v}) {w}", f"count({v}) {w}",
                                    digits))
    w = ordered(order, partition).rowsBetween(-(rows - 1), Window.currentRow)
    s = F.sum(_c(value)).over(w)
    n = F.count(_c(value)).over(w)
    return div_round(_c(value) * n - s, n, digits)


def running_sum(value, order: Sequence, partition: Sequence[str] = ()) -> Column:
    """SUM(value) OVER (ORDER BY ..): default RANGE frame, ties included."""
    if _names(value, order, partition):
        return F.expr(f"sum({sql_ref(value)}) " + over_sql(
            order, partition, "RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"))
    w = ordered(order, partition).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(_c(value)).over(w)


def previous(value, order: Sequence, partition: Sequence[str] = ()) -> Column:
    """LAG(value, 1) OVER (ORDER BY ..)."""
    if _names(value, order, partition):
        return F.expr(f"lag({sql_ref(value)}, 1) " + over_sql(order, partition))
    return F.lag(_c(value), 1).over(ordered(order, partition))


def growth_pct(value, order: Sequence, digits: int = 2, scale: int = 0, safe: bool = False,
               partition: Sequence[str] = ()) -> Column:
    """round(100.0 * (v - LAG(v)) / LAG(v), digits).

    ``safe=False`` keeps the unguarded division (a zero previous value
    raises, as in SQL); ``safe=True`` is the NULLIF(LAG(v), 0) form.
    """
    if _names(value, order, partition):
        prev = f"lag({sql_ref(value)}, 1) " + over_sql(order, partition)
        return F.expr(div_round_sql(f"({sql_ref(value)} - {prev}) * 100", prev, digits,
                                    num_scale=scale, den_scale=scale, zero_is_null=safe))
    prev = previous(value, order, partition)
    return div_round((_c(value) - prev) * F.lit(100), prev, digits, num_scale=scale,
                     den_scale=scale, zero_is_null=safe)


def share_of_total(df: DataFrame, value: str, alias: str, digits: int = 2,
                   scale: int = 0, bounded: bool = False) -> DataFrame:
    """Add round(100.0 * value / SUM(value) OVER (), digits) to an aggregated frame.

    ``bounded=True`` (a small fixed set of groups, gathered into one
    partition): a window over the whole frame, no second branch.
    Otherwise the grand total is a one-row aggregate joined by broadcast
    (one row is a fixed size), so no single-partition window over ``df``
    is planned.
    """
    if bounded:
        total = F.expr(f"sum({sql_ref(value)}) OVER ()")
        return df.coalesce(1).withColumn("__total", total).withColumn(
            alias, percent(value, "__total", digits, part_scale=scale, whole_scale=scale)
        ).drop("__total")
    total = df.agg(F.sum(value).alias("__total"))
    return df.crossJoin(F.broadcast(total)).withColumn(
        alias, percent(value, "__total", digits, part_scale=scale, whole_scale=scale)
    ).drop("__total")


def top_k(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """ORDER BY .. LIMIT n: planned as TakeOrderedAndProject (per-task top-n, then merge)."""
    return df.orderBy(*order).limit(n)


def sort_bounded(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """ORDER BY for a result with a small fixed set of groups (<= 32).

    Used for flags, weekdays, amount bands and days of the month. The final
    aggregate under it reads at most (map tasks x groups) partial rows,
    which adaptive execution would coalesce into one partition anyway, so
    the rows are gathered into one partition and sorted there: no range
    partitioning and its sampling job. Results keyed by months, weeks or
    categories keep the distributed ``orderBy``.
    """
    return df.coalesce(1).orderBy(*order)
