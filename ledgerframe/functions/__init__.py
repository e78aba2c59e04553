"""Column expressions: exact decimal math, calendar parts, fixed labels."""

from ledgerframe.functions import calendar, exact, labels  # noqa: F401
