"""Reusable DataFrame operators (DataFrame in, DataFrame or Column out)."""

from ledgerframe.operators import bands, grouped, window  # noqa: F401
