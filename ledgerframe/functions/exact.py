"""Exact decimal arithmetic on Spark columns.

Spark's ``avg`` on a decimal keeps 6 fractional digits and ``avg`` on an
integer is a double; rounding either to 2 or 4 digits can land on the
wrong side of a half (0.005 -> 0.01 when the true mean is 0.0049999...).
SQL's NUMERIC rounds the exact quotient half away from zero, so every
mean, share, rate and ratio here is computed as an exact rational:

    value = X / Y            X, Y integers (unscaled decimals)
    ip    = X div Y          truncated toward zero (long)
    rem   = X %   Y          same sign as X, |rem| < |Y|
    frac  = (2|rem|*10^k + |Y|) div (2|Y|)    exact half-up of |rem/Y|*10^k
    round(value, k) = ip + sign(value) * frac / 10^k

All steps are built-in JVM expressions on DECIMAL(38,0), so the plan
stays inside whole-stage codegen. They are only ever applied to
aggregated rows (days, months, categories), never per fact row.

Bounds: |X| * 2 * 10^k < 10^38, |Y| < 10^19, |value| < 9.2e18, k <= 17.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerframe.schema import decimal_type

# Scale used for results the reference leaves unrounded (AVG of a NUMERIC).
UNROUNDED_SCALE = 16

_INT38 = "decimal(38,0)"
_IDENT = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def sql_ref(x: str) -> str:
    """SQL text for a column name (quoted) or an SQL expression (parenthesised)."""
    return f"`{x}`" if _IDENT.match(x) else f"({x})"


def div_round_sql(num: str, den: str, digits: int, num_scale: int = 0, den_scale: int = 0,
                  zero_is_null: bool = True) -> str:
    """The SQL text of :func:`div_round` for SQL operands (names or expressions).

    Built as one expression string so a whole exact division costs a
    single call into the JVM when the plan is built.
    """
    if not 0 <= digits <= 17:
        raise ValueError("digits must be in 0..17")
    x, y = sql_ref(num), sql_ref(den)
    x = f"CAST({x} * {10 ** num_scale} AS DECIMAL(38,0))" if num_scale else f"CAST({x} AS DECIMAL(38,0))"
    y = f"CAST({y} * {10 ** den_scale} AS DECIMAL(38,0))" if den_scale else f"CAST({y} AS DECIMAL(38,0))"
    shift = den_scale - num_scale
    if shift > 0:
        x = f"CAST({x} * {10 ** shift} AS DECIMAL(38,0))"
    elif shift < 0:
        y = f"CAST({y} * {10 ** (-shift)} AS DECIMAL(38,0))"
    if zero_is_null:
        y = f"NULLIF({y}, CAST(0 AS DECIMAL(38,0)))"
    frac = (f"(CAST(abs({x} % {y}) * {2 * 10 ** digits} AS DECIMAL(38,0)) + abs({y})) "
            f"div CAST(abs({y}) * 2 AS DECIMAL(38,0))")
    sign = f"CASE WHEN ({x} < 0) <> ({y} < 0) THEN -1 ELSE 1 END"
    return (f"CAST(CAST({x} div {y} AS DECIMAL(20,0)) + "
            f"CAST(({frac}) * {sign} AS DECIMAL(19,0)) / CAST({10 ** digits} AS DECIMAL(19,0)) "
            f"AS DECIMAL(38,{digits}))")


def unscaled(col, scale: int) -> Column:
    """Exact integer image of a decimal with ``scale`` fractional digits."""
    c = _c(col)
    if scale:
        c = c * F.lit(10**scale)
    return c.cast(_INT38)


def div_round(
    num,
    den,
    digits: int,
    num_scale: int = 0,
    den_scale: int = 0,
    zero_is_null: bool = True,
) -> Column:
    """round(num / den, digits), half away from zero, exact.

    ``num_scale``/``den_scale`` are the fractional digits of the inputs
    (0 for integer columns, 2 for money). NULL in, NULL out. A zero
    denominator gives NULL when ``zero_is_null`` (the AVG / NULLIF form);
    otherwise it raises DIVIDE_BY_ZERO like an unguarded SQL division.
    """
    if isinstance(num, str) and isinstance(den, str):
        return F.expr(div_round_sql(num, den, digits, num_scale, den_scale, zero_is_null))
    if not 0 <= digits <= 17:
        raise ValueError("digits must be in 0..17")
    x = unscaled(num, num_scale)
    y = unscaled(den, den_scale)
    shift = den_scale - num_scale
    if shift > 0:
        x = (x * F.lit(10**shift)).cast(_INT38)
    elif shift < 0:
        y = (y * F.lit(10 ** (-shift))).cast(_INT38)
    if zero_is_null:
        y = F.nullif(y, F.lit(0).cast(_INT38))
    ip = _div(x, y)
    rem = x % y
    frac = _div(
        (F.abs(rem) * F.lit(2 * 10**digits)).cast(_INT38) + F.abs(y),
        (F.abs(y) * F.lit(2)).cast(_INT38),
    )
    sign = F.when((x < 0) != (y < 0), F.lit(-1)).otherwise(F.lit(1))
    frac_dec = (frac * sign).cast("decimal(19,0)") / F.lit(10**digits).cast(
        "decimal(19,0)"
    )
    return (ip.cast("decimal(20,0)") + frac_dec).cast(decimal_type(digits))


def _div(a: Column, b: Column) -> Column:
    """Integral division truncated toward zero (SQL ``div``, a long)."""
    return F.call_function("div", a, b)


def mean(sum_col, count_col, digits: int, scale: int = 0) -> Column:
    """Exact AVG: sum / count of non-NULL values, NULL when count is 0."""
    return div_round(sum_col, count_col, digits, num_scale=scale)


def percent(part, whole, digits: int = 2, part_scale: int = 0,
            whole_scale: int = 0, zero_is_null: bool = True) -> Column:
    """round(100.0 * part / whole, digits), exact."""
    if isinstance(part, str) and isinstance(whole, str):
        return div_round(f"{sql_ref(part)} * 100", whole, digits, num_scale=part_scale,
                         den_scale=whole_scale, zero_is_null=zero_is_null)
    return div_round(
        _c(part) * F.lit(100),
        whole,
        digits,
        num_scale=part_scale,
        den_scale=whole_scale,
        zero_is_null=zero_is_null,
    )


def money(col) -> Column:
    """A money amount in the report type (sums of DECIMAL(15,2) stay exact)."""
    return _c(col).cast(decimal_type(2))


def as_count(col) -> Column:
    return _c(col).cast("bigint")
