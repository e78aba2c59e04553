"""CASE-style banding: first matching rule wins, else a default label."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _lit(v):
    return F.lit(Decimal(str(v)))


def range_band(value, bands: Sequence[tuple], else_label: str) -> Column:
    """Bands of (label, low, high, high_inclusive); low is inclusive.

    A NULL value matches no band and gets ``else_label``. Shared edges go
    to the earlier band because the first match wins.
    """
    v = _c(value)
    expr = None
    for label, low, high, high_incl in bands:
        cond = F.lit(True)
        if low is not None:
            cond = cond & (v >= _lit(low))
        if high is not None:
            cond = cond & ((v <= _lit(high)) if high_incl else (v < _lit(high)))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(else_label))


def above_band(value, rules: Sequence[tuple], else_label: str) -> Column:
    """Rules of (label, edge): first edge with value > edge wins."""
    v = _c(value)
    expr = None
    for label, edge in rules:
        cond = v > _lit(edge)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(else_label))


def between_band(value, rules: Sequence[tuple], else_label: str) -> Column:
    """Rules of (label, low, high) inclusive; high None means no upper edge."""
    v = _c(value)
    expr = None
    for label, low, high in rules:
        cond = v >= F.lit(low) if high is None else v.between(F.lit(low), F.lit(high))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(else_label))
