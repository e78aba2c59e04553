"""Table management: load, surrogate ids, marts, comments, read-backs.

Secondary B-tree indexes have no Spark counterpart; their purpose (fast
lookup by date, year, category, risk) is served by the physical layout
written here: rows range-partitioned and sorted on the lookup key, so
parquet min/max statistics let scans skip files and row groups, with
optional directory partitioning (``partition_by``) for pruning.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerframe.schema import TRANSACTION_SCHEMA
from ledgerframe.sources.csv import POSITION

FACT_TABLE = "fact_transactions"


# ---------------------------------------------------------------- ids (L3)
def with_surrogate_id(df: DataFrame, dense: bool = False, col: str = "transaction_id") -> DataFrame:
    """Attach a surrogate id restarted at every load.

    ``dense=False``: ``monotonically_increasing_id`` (unique, ordered by
    input position, one pass, not contiguous).
    ``dense=True``: 1..N. Rows read with ``position=True`` (``POSITION``
    columns, dropped here) are numbered in file order: files by path,
    splits by their start, rows along the split. Other rows follow the
    order of Spark's partitions, which for a scan of several files is not
    the order of the files.
    """
    if dense and set(POSITION) <= set(df.columns):
        return _file_order_id(df, col)
    pid = F.spark_partition_id()
    mid = F.monotonically_increasing_id()
    if not dense:
        return df.select(mid.alias(col), *df.columns)
    tagged = df.select(
        pid.alias("_pid"),
        (mid - F.shiftleft(pid.cast("bigint"), 33)).alias("_pos"),
        *df.columns,
    )
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(
            F.sum("_n").over(
                Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_off"),
    )
    return tagged.join(offsets, "_pid").select(
        (F.col("_off") + F.col("_pos") + 1).alias(col), *df.columns
    )


def _file_order_id(df: DataFrame, col: str) -> DataFrame:
    """Dense ids in file order: rows before the file, plus rows before the split, plus the place in it.

    Counts are combined to one row per split, summed along each file in
    parallel and then along the files; only that last sum, over one row
    per file, runs in one task. Spark chooses the join by the size of the
    table of splits (no broadcast is forced).
    """
    file, block, row = POSITION
    before = (Window.unboundedPreceding, -1)
    splits = df.groupBy(file, block).agg(F.count(F.lit(1)).alias("_n"), F.min(row).alias("_first"))
    files = splits.groupBy(file).agg(F.sum("_n").alias("_n"))
    files = files.select(F.col(file).alias("_of"), F.coalesce(
        F.sum("_n").over(Window.orderBy(file).rowsBetween(*before)), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy(file).orderBy(block).rowsBetween(*before)), F.lit(0))
    offsets = (splits.withColumn("_inside", inside).join(files, F.col(file) == F.col("_of"))
               .select(F.col(file).alias("_of"), F.col(block).alias("_at"),
                       (F.col("_start") + F.col("_inside") - F.col("_first") + 1).alias("_off")))
    rows = df.join(offsets, (F.col(file) == F.col("_of")) & (F.col(block) == F.col("_at")))
    return rows.select((F.col("_off") + F.col(row)).alias(col), *[c for c in df.columns if c not in POSITION])


# ---------------------------------------------------------- fact table (L1, L4, L9)
def ensure_table(spark: SparkSession, name: str = FACT_TABLE, location: str | None = None) -> None:
    """CREATE TABLE IF NOT EXISTS with the declared fact schema (parquet)."""
    cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TRANSACTION_SCHEMA.fields)
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet{loc}")


def declared(df: DataFrame, dense_ids: bool = True) -> DataFrame:
    """Rows in the declared columns and types of the fact, with ids if they have none."""
    rows = df if "transaction_id" in df.columns else with_surrogate_id(df, dense=dense_ids)
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in TRANSACTION_SCHEMA.fields])


def load(
    df: DataFrame,
    name: str = FACT_TABLE,
    mode: str = "overwrite",
    dense_ids: bool = True,
    path: str | None = None,
) -> None:
    """Full reload of the fact table: replace its rows, ids restarted."""
    writer = declared(df, dense_ids).write.mode(mode).format("parquet")
    if path:
        writer.save(path)
    else:
        writer.saveAsTable(name)


def load_report(df: DataFrame) -> DataFrame:
    """Row count after a load: one row, ``loaded_rows``."""
    return df.agg(F.count(F.lit(1)).alias("loaded_rows"))


# ---------------------------------------------------------------- marts (L10-L15)
def write_mart(
    df: DataFrame,
    name: str | None = None,
    path: str | None = None,
    sort_by: list[Column | str] | None = None,
    partition_by: list[str] | None = None,
    num_files: int | None = None,
    bloom: list[str] | None = None,
) -> None:
    """Rebuild a mart: overwrite it with ``df`` in key order.

    ``sort_by`` range-partitions and sorts the rows so each file covers
    a key range (file skipping on the lookup keys); ``partition_by``
    adds directory partitions (e.g. ``year``). Without ``num_files`` the
    range exchange uses the session's shuffle partitions and adaptive
    execution coalesces them to the data size, so a small mart is not
    scattered over thousands of tiny files on a large cluster. ``bloom``
    names columns that get Parquet bloom filters (lookups by equality skip
    row groups whose range holds the value by chance only).
    """
    if (name is None) == (path is None):
        raise ValueError("give exactly one of name or path")
    out = df
    if sort_by:
        out = (out.repartitionByRange(num_files, *sort_by) if num_files
               else out.repartitionByRange(*sort_by))
        # the folder first, as the writer asks for it: it would sort anew by the folder alone and lose the order of the rows
        out = out.sortWithinPartitions(*[F.col(c).asc() for c in partition_by or []], *sort_by)
    writer = out.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    for column in bloom or []:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    if name:
        writer.saveAsTable(name)
    else:
        writer.save(path)


def publish(df: DataFrame, name: str, write, base: str) -> None:
    """Write ``df`` to a new folder under ``base`` with ``write(df, folder)``, then point the catalog table at it.

    Readers see the old rows until the table moves and the new ones from
    then on; a write that fails or a driver that is lost half-way leaves the
    old table as it was. A table of other columns is replaced. Old folders stay.
    """
    spark = df.sparkSession
    location = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    write(df, location)
    fields = [(f.name, f.dataType) for f in df.schema.fields]
    same = spark.catalog.tableExists(name) and [(f.name, f.dataType) for f in spark.table(name).schema.fields] == fields
    if same:
        spark.sql(f"ALTER TABLE {name} SET LOCATION {_quote(location)}")
        spark.catalog.refreshTable(name)
        return
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    columns = ", ".join(f"{_ident(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet LOCATION {_quote(location)}")


def bucketed(df: DataFrame, by: str, base: str, buckets: int | None = None) -> DataFrame:
    """``df`` stored in buckets of ``by``, sorted by it, and read back: grouping or joining by it needs no exchange.

    One file a bucket (rows of one value of ``by`` are together, so give a
    frame that is aggregated to few rows a value). The files lie in a folder
    of their own under ``base``; the catalog entry that Spark needs to write
    buckets is removed again, the returned frame keeps what it says.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"lf_bucketed_{uuid.uuid4().hex}"
    (df.repartition(n, by).write.bucketBy(n, by).sortBy(by).format("parquet")
     .option("path", f"{base.rstrip('/')}/{name}").saveAsTable(name))
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def comment(spark: SparkSession, table: str, table_comment: str | None = None,
            columns: dict[str, str] | None = None) -> None:
    """Attach documentation to a catalog table and its columns."""
    if table_comment is not None:
        spark.sql(f"COMMENT ON TABLE {table} IS {_quote(table_comment)}")
    for col, text in (columns or {}).items():
        spark.sql(f"ALTER TABLE {table} ALTER COLUMN {col} COMMENT {_quote(text)}")


def mart_report(df: DataFrame, alias: str = "rows_in_mart") -> DataFrame:
    """Row count of a mart as one row."""
    return df.agg(F.count(F.lit(1)).alias(alias))


def preview(df: DataFrame, order_by: list[Column], n: int = 10) -> DataFrame:
    """First ``n`` rows in a fixed key order (a bare LIMIT is arbitrary)."""
    return df.orderBy(*order_by).limit(n)


# ---------------------------------------------------------------- catalog metadata (L5, L9, L11)
def described(spark: SparkSession, table: str) -> DataFrame:
    """The columns of a catalog table as rows: position, column_name, data_type, comment (null: none).

    One row a column, so the driver holds a schema and no data.
    """
    rows = [(i, c.name, c.dataType, c.description) for i, c in enumerate(spark.catalog.listColumns(table), 1)]
    return spark.createDataFrame(rows, "position bigint, column_name string, data_type string, comment string")


def filled(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, filled_rows, total_rows): how many rows carry a value in each column; one pass with map-side sums."""
    names = columns or df.columns
    sums = df.agg(F.count(F.lit(1)).alias("__all"), *[F.count(F.col(c)).alias(f"__{i}") for i, c in enumerate(names)])
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"__{i}").alias("filled_rows"), F.col("__all").alias("total_rows"))
                     for i, c in enumerate(names)])
    return sums.select(F.inline(each))


def footer_count(spark: SparkSession, path: str, alias: str = "rows") -> DataFrame:
    """Row count of a Parquet folder from its footers: the scan itself returns one count a file.

    The count is pushed into the reader by Spark's second data source
    interface, in a session of its own (catalog and files are shared), so
    that the settings of the caller's session stay.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "csv,json,text,orc,avro")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path).agg(F.count(F.lit(1)).alias(alias))
