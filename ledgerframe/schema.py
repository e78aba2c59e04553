"""Declared fact-table schema and output type conventions."""

from __future__ import annotations

from pyspark.sql import types as T

# Fact table: one row per transaction.
TRANSACTION_SCHEMA = T.StructType(
    [
        T.StructField("transaction_id", T.LongType(), False),
        T.StructField("transaction_date", T.DateType(), True),
        T.StructField("description", T.StringType(), True),
        T.StructField("debit", T.DecimalType(15, 2), True),
        T.StructField("credit", T.DecimalType(15, 2), True),
        T.StructField("balance", T.DecimalType(15, 2), True),
        T.StructField("is_suspicious", T.IntegerType(), True),
    ]
)

# The CSV file carries every column but the surrogate id, in this order.
CSV_COLUMNS = [f.name for f in TRANSACTION_SCHEMA.fields[1:]]

MAX_DESCRIPTION_LENGTH = 255


# Output type conventions shared by every report so that results compare
# exactly across engines: counts and calendar parts are BIGINT, every
# decimal result is DECIMAL(38, s) with s the rounding scale of the column.
def decimal_type(scale: int) -> str:
    return f"decimal(38,{scale})"
