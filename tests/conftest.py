from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from ledgerframe.schema import TRANSACTION_SCHEMA  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from ledgerframe.session import build_session

    import tempfile

    wh = tempfile.mkdtemp(prefix="lf-warehouse-", dir="/tmp")
    s = build_session("local[4]", app_name="ledgerframe-tests", shuffle_partitions=8,
                      extra={"spark.sql.warehouse.dir": wh})
    yield s
    s.stop()


def D(x):
    return None if x is None else Decimal(x)


def d(s):
    return None if s is None else dt.date.fromisoformat(s)


# Hand-made rows (FIXTURES.md §3): date, description, debit, credit, balance, flag
HAND_ROWS = [
    ("2024-01-01", "A", "99.99", None, "10.00", 0),
    ("2024-01-01", "A", "100.00", None, "10.00", 1),
    ("2024-01-02", "A", "500.00", None, "10.00", 0),
    ("2024-01-02", "B", "1000.00", None, "10.00", 0),
    ("2024-01-04", "B", "5000.00", None, "10.00", 1),
    ("2024-01-04", "B", "5000.01", None, "10.00", 0),
    ("2024-01-05", "C", None, "70.00", "10.00", 0),
    ("2024-01-05", "D", "-5.00", None, "10.00", 0),
    ("2024-01-07", "D", "10000.00", "1.00", "10.00", 1),
    ("2024-01-07", "D", "10000.01", None, "10.00", 0),
    (None, "D", "1.00", None, "10.00", 0),
    ("2024-01-08", None, "1.00", None, "10.00", 0),
    ("2024-01-08", "E", "1.00", None, None, None),
    ("2024-12-30", "E", "1.00", None, "10.00", 0),
    ("2025-01-08", "E", "1.00", None, "10.00", 0),
]


def make_fact(spark, rows=HAND_ROWS):
    data = [(i + 1, d(r[0]), r[1], D(r[2]), D(r[3]), D(r[4]), r[5]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, TRANSACTION_SCHEMA)


@pytest.fixture(scope="session")
def hand(spark):
    return make_fact(spark)
