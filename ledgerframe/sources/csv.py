"""CSV ingest of transaction files.

The files carry six columns by position (date, description, debit,
credit, balance, flag) after a header line that is skipped. Parsing is
FAILFAST, as a database bulk load aborts on the first bad row; the
optional quarantine mode keeps good rows and returns bad lines apart.

SQL CSV conventions are kept: a doubled quote inside a quoted field is
one quote, an unquoted empty field is NULL and a quoted empty field is
the empty string. Spark reads both empties as NULL unless the empty
value is a sentinel, so a private sentinel is mapped back to ''.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerframe.schema import CSV_COLUMNS, TRANSACTION_SCHEMA

_EMPTY_SENTINEL = "\u0000lf-empty\u0000"
CORRUPT_COLUMN = "_corrupt_record"
POSITION = ("_lf_file", "_lf_block", "_lf_row")


def csv_schema(with_corrupt: bool = False) -> T.StructType:
    fields = [f for f in TRANSACTION_SCHEMA.fields if f.name in CSV_COLUMNS]
    if with_corrupt:
        fields = fields + [T.StructField(CORRUPT_COLUMN, T.StringType(), True)]
    return T.StructType(fields)


def read_transactions(
    spark: SparkSession,
    path: str | list[str],
    date_format: str = "yyyy-MM-dd",
    mode: str = "FAILFAST",
    delimiter: str = ",",
    header: bool = True,
    multi_line: bool = False,
    position: bool = False,
) -> DataFrame:
    """Read transaction CSV files into the fact columns (no id yet).

    ``mode`` is FAILFAST (default, abort on a bad row) or PERMISSIVE, in
    which case bad rows keep their raw line in ``_corrupt_record`` and
    NULL fields; use ``split_quarantine`` to separate them.

    Every read parses every column, whatever is selected later: a scan
    pruned to some columns would take a row for good whose other fields
    cannot be parsed.

    ``multi_line`` allows line breaks inside quoted fields; a file is then
    read by one task, so give many files. ``position`` adds the columns of
    ``POSITION`` (file, start of the split in it, a number that grows along
    the split) for ids in file order.
    """
    permissive = mode.upper() == "PERMISSIVE"
    reader = (
        spark.read.schema(csv_schema(with_corrupt=permissive))
        .option("header", header)
        .option("sep", delimiter)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", mode.upper())
        .option("dateFormat", date_format)
        .option("emptyValue", _EMPTY_SENTINEL)
        .option("nullValue", "")
        .option("enforceSchema", True)
        .option("multiLine", multi_line)
    )
    if permissive:
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
    df = reader.csv(path)
    if position:
        df = df.select("*", F.col("_metadata.file_path").alias(POSITION[0]),
                       F.col("_metadata.file_block_start").alias(POSITION[1]),
                       F.monotonically_increasing_id().alias(POSITION[2]))
    # always true, and needs every field of the file
    df = df.where(F.hash(*csv_schema(with_corrupt=permissive).names) >= -(2 ** 31))
    return df.withColumn(
        "description",
        F.when(F.col("description") == _EMPTY_SENTINEL, F.lit("")).otherwise(
            F.col("description")
        ),
    )


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the corrupt column, bad raw lines) of a PERMISSIVE read."""
    bad = df.where(F.col(CORRUPT_COLUMN).isNotNull()).select(CORRUPT_COLUMN)
    good = df.where(F.col(CORRUPT_COLUMN).isNull()).drop(CORRUPT_COLUMN)
    return good, bad
