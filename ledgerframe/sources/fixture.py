"""Transaction fact table derived from the driver's ``orders`` table.

Deterministic, row-for-row the same as the derivation used by the SQL
oracle: every order becomes one transaction. Money is cut in integer
cents and then scaled by an exact decimal, so no engine-specific
double-to-decimal rounding enters. Pure projection: no shuffle, and
the scan reads only the five ``orders`` columns it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


# Both steps are SQL expression lists: two calls into the JVM build the
# whole projection.
_STEP1 = [
    "o_orderkey AS k",
    "o_orderstatus AS status",
    "o_orderdate AS odate",
    "(o_custkey % 40) * (o_orderkey % 40) AS cat",
    "CAST(round(o_totalprice * 100) AS BIGINT) AS cents",
]
_DEBIT_CENTS = """CASE WHEN k % 10 < 1 THEN cents
     WHEN k % 10 < 4 THEN CAST((cents - cents % 10) / 10 AS BIGINT)
     WHEN k % 10 < 7 THEN CAST((cents - cents % 100) / 100 AS BIGINT)
     ELSE CAST((cents - cents % 1000) / 1000 AS BIGINT) END"""
_IS_CREDIT = "(status = 'O' OR cat % 13 = 7)"
_STEP2 = [
    "CAST(k AS BIGINT) AS transaction_id",
    "CASE WHEN k % 997 = 0 THEN NULL ELSE CAST(odate AS DATE) END AS transaction_date",
    "CASE WHEN k % 211 = 0 THEN NULL ELSE concat('cat-', CAST(cat AS STRING)) END AS description",
    f"CASE WHEN {_IS_CREDIT} THEN NULL ELSE CAST(({_DEBIT_CENTS}) * 0.01 AS DECIMAL(15,2)) END AS debit",
    f"CASE WHEN {_IS_CREDIT} THEN CAST(cents * 0.01 AS DECIMAL(15,2)) END AS credit",
    "CAST(cents * 0.01 AS DECIMAL(15,2)) AS balance",
    "CASE WHEN (k * 7919) % 997 < 10 * (cat % 16) THEN 1 ELSE 0 END AS is_suspicious",
]


def transactions_from_orders(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(*_STEP1).selectExpr(*_STEP2)


def load_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table for one scale-factor folder of the driver's tables."""
    return transactions_from_orders(spark.read.parquet(f"{sf_dir}/orders.parquet"))
