"""Declared table rules checked as DataFrame aggregates.

A parquet table cannot carry CHECK / PRIMARY KEY constraints, so the
rules of the fact schema are checked here and reported as counts:

- flag domain: is_suspicious IN (0, 1); NULL passes, as a CHECK does;
- description length <= 255 characters;
- amount precision: |amount| < 10^13 (DECIMAL(15,2));
- key uniqueness: no transaction_id occurs twice.

Row rules are one global aggregate. The key rule sets one bit an id in
bitmaps of 32,768 neighbouring ids, combined map-side: where as many bits are
set as rows were counted, no id occurs twice, so the exchange carries
bitmaps instead of ids. Only ids of the other buckets are counted one by
one. Ids that lie too far apart for bitmaps (one job counts and spans them)
are all counted one by one.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.schema import MAX_DESCRIPTION_LENGTH

_AMOUNT_LIMIT = Decimal(10) ** 13


#: ids per row up to which bitmaps are used: 8 bytes a row, as much as the id itself
SPREAD = 64
_COLUMNS = ["checked_rows", "flag_violations", "length_violations", "precision_violations", "duplicate_ids", "duplicate_rows"]


def _row_rules() -> list:
    bad_flag = F.col("is_suspicious").isNotNull() & ~F.col("is_suspicious").isin(0, 1)
    too_long = F.length("description") > MAX_DESCRIPTION_LENGTH
    too_big = F.coalesce(
        (F.abs(F.col("debit")) >= F.lit(_AMOUNT_LIMIT))
        | (F.abs(F.col("credit")) >= F.lit(_AMOUNT_LIMIT))
        | (F.abs(F.col("balance")) >= F.lit(_AMOUNT_LIMIT)),
        F.lit(False),
    )
    return [
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(bad_flag, 1)).alias("flag_violations"),
        F.count(F.when(too_long, 1)).alias("length_violations"),
        F.count(F.when(too_big, 1)).alias("precision_violations"),
    ]


def _repeats(t: DataFrame, id_col: str) -> DataFrame:
    """One row: ids that occur twice or more, and their rows."""
    per_id = t.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return per_id.agg(F.count(F.lit(1)).alias("duplicate_ids"), F.sum("n").alias("duplicate_rows"))


def _near(t: DataFrame, id_col: str) -> bool:
    """Whether the ids are whole numbers that lie near enough to one another for bitmaps (one job)."""
    if t.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        return False
    s = t.agg(F.count(id_col).alias("n"), F.min(id_col).alias("a"), F.max(id_col).alias("b")).first()
    return s["n"] == 0 or s["b"] - s["a"] < SPREAD * s["n"]


def validate(t: DataFrame, id_col: str = "transaction_id", check_unique: bool = True) -> DataFrame:
    """One row of violation counts (all zero for a valid table).

    ``check_unique=False`` skips the key rule; use it when the ids were just
    generated and are unique by construction. Rows without an id count as
    rows of one id.
    """
    rules = ["flag_violations", "length_violations", "precision_violations"]
    if not check_unique:
        out = t.agg(*_row_rules()).withColumns({"duplicate_ids": F.lit(0), "duplicate_rows": F.lit(0)})
    elif _near(t, id_col):
        bucket, bit = F.bitmap_bucket_number(F.col(id_col).cast("bigint")), F.bitmap_bit_position(F.col(id_col).cast("bigint"))
        buckets = t.groupBy(bucket.alias("__bucket")).agg(*_row_rules(), F.bitmap_count(F.bitmap_construct_agg(bit)).alias("__bits"))
        full = buckets.where((F.col("n") != F.col("__bits")) & (F.col("n") > 1)).select("__bucket")
        suspect = t.select(id_col, bucket.alias("__in")).join(full, F.col("__in").eqNullSafe(F.col("__bucket")), "left_semi")
        out = buckets.agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in rules]).crossJoin(_repeats(suspect, id_col))  # one row each
    else:
        out = t.agg(*_row_rules()).crossJoin(_repeats(t, id_col))  # one row each
    return out.withColumnRenamed("n", "checked_rows").select(*[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in _COLUMNS])


def assert_valid(t: DataFrame, id_col: str = "transaction_id", check_unique: bool = True) -> None:
    """Raise ValueError naming the broken rules (runs one small job)."""
    row = validate(t, id_col, check_unique).first()
    broken = {k: v for k, v in row.asDict().items() if k != "checked_rows" and v}
    if broken:
        raise ValueError(f"table rules violated: {broken}")
