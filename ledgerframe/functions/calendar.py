"""Calendar expressions with SQL (NUMERIC/ISO) semantics.

Spark's own names differ in small ways that change results:
``dayofweek`` counts Sunday as 1 (SQL DOW counts it as 0), ``EEEE``
is not blank padded (SQL ``TO_CHAR(d, 'Day')`` pads to 9 characters),
and ``date - date`` is an interval, not a day count. Every helper here
returns the SQL value and keeps NULL dates NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_NAME_WIDTH = 9  # longest English weekday name, 'Wednesday'


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def day_name(d) -> Column:
    """TO_CHAR(d, 'Day'): English weekday name blank-padded to 9."""
    return F.rpad(F.date_format(_c(d), "EEEE"), DAY_NAME_WIDTH, " ")


def day_of_week(d) -> Column:
    """EXTRACT(DOW FROM d): Sunday = 0 .. Saturday = 6, as BIGINT."""
    return (F.dayofweek(_c(d)) - 1).cast("bigint")


def year(d) -> Column:
    return F.year(_c(d)).cast("bigint")


def month(d) -> Column:
    return F.month(_c(d)).cast("bigint")


def day_of_month(d) -> Column:
    return F.dayofmonth(_c(d)).cast("bigint")


def iso_week(d) -> Column:
    """EXTRACT(WEEK FROM d): ISO-8601 week number (week of the Thursday)."""
    return F.weekofyear(_c(d)).cast("bigint")


def week_start(d) -> Column:
    """DATE_TRUNC('week', d) as a DATE: the Monday on or before d."""
    return F.trunc(_c(d), "week")


def month_start(d) -> Column:
    """DATE_TRUNC('month', d) as a DATE."""
    return F.trunc(_c(d), "month")


def month_key(d) -> Column:
    """TO_CHAR(d, 'YYYY-MM')."""
    return F.date_format(_c(d), "yyyy-MM")


def date_str(d) -> Column:
    """TO_CHAR(d, 'YYYY-MM-DD')."""
    return F.date_format(_c(d), "yyyy-MM-dd")


def days_between(later, earlier) -> Column:
    """later - earlier for DATEs, an integer day count as BIGINT."""
    return F.datediff(_c(later), _c(earlier)).cast("bigint")
