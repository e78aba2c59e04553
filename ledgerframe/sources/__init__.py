"""Reading, validating and writing transaction and mart tables."""

from ledgerframe.sources.csv import read_transactions, split_quarantine  # noqa: F401
from ledgerframe.sources.fixture import load_fact, transactions_from_orders  # noqa: F401
from ledgerframe.sources.tables import (  # noqa: F401
    comment,
    ensure_table,
    load,
    load_report,
    mart_report,
    preview,
    with_surrogate_id,
    write_mart,
)
