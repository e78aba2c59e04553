"""ledgerframe: transaction analytics as Spark DataFrame operators.

Every public operator takes a transaction DataFrame (see ``schema``) and
returns a DataFrame; nothing is collected to the driver. Sub-packages:

- ``sources``   reading, validating and writing tables (CSV, parquet, catalog)
- ``functions`` column expressions: exact decimal rounding, calendar parts, labels
- ``operators`` reusable building blocks (grouped stats, bands, windows,
                distributed ranking, the (day, category) rollup with
                grain-agnostic measures, validation rules)
- ``plans``     the analytic reports and marts composed from the operators,
                the load / mart-rebuild / run-all jobs and the catalogue

``python -m ledgerframe`` runs the jobs and any catalogued query.
"""

from ledgerframe.schema import TRANSACTION_SCHEMA  # noqa: F401

__all__ = ["TRANSACTION_SCHEMA"]
