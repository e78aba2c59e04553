"""Load reports: the fact written as CSV files, loaded by the load job and read back.

Files go to the shared folder the cluster names, in the order of the
transaction id, so that the ids a load gives can be told from their place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.schema import CSV_COLUMNS
from ledgerframe.functions import labels as L
from ledgerframe.session import checkpoint_dir
from ledgerframe.sources import csv as csvsrc
from ledgerframe.sources import tables


def _folder(t: DataFrame, name: str) -> str:
    return f"{checkpoint_dir(t.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_csv(t: DataFrame, path: str) -> None:
    """The columns of the CSV format, in id order over the files; null is an empty field, an empty text a quoted one."""
    ordered = t.repartitionByRange("transaction_id").sortWithinPartitions("transaction_id")
    (ordered.select(*CSV_COLUMNS).write.option("header", True).option("escape", '"')
     .option("nullValue", "").option("emptyValue", '""').csv(path))


def csv_round_trip(t: DataFrame) -> DataFrame:
    """Rows of the fact after they went through CSV files."""
    path = _folder(t, "fact-csv")
    write_csv(t, path)
    return csvsrc.read_transactions(t.sparkSession, path, multi_line=False)


def csv_line_breaks(t: DataFrame) -> DataFrame:
    """Rows whose description holds a line break, quotes and a delimiter, after they went through CSV files."""
    path = _folder(t, "fact-csv")
    broken = F.concat(F.col("description"), F.lit('\n"second", line'))
    write_csv(t.withColumn("description", broken), path)
    return csvsrc.read_transactions(t.sparkSession, path, multi_line=True)


def _loaded(t: DataFrame, times: int = 1) -> DataFrame:
    from ledgerframe.plans.jobs import load_transactions

    spark, files, table = t.sparkSession, _folder(t, "fact-csv"), _folder(t, "fact")
    write_csv(t, files)
    for _ in range(times):
        load_transactions(spark, files, path=table)
    return spark.read.parquet(table)


def ids_in_file_order(t: DataFrame) -> DataFrame:
    """The loaded fact: ids 1..N in the order of the files."""
    return _loaded(t)


def reload_twice(t: DataFrame) -> DataFrame:
    """A second load replaces the first: rows, distinct range of ids."""
    return _loaded(t, times=2).agg(
        F.count(F.lit(1)).alias("loaded_rows"),
        F.min("transaction_id").alias("first_id"), F.max("transaction_id").alias("last_id"))


def _as_table(t: DataFrame, use):
    """``use(name)`` on a catalog table that holds the rows of ``t``; the entry goes, the rows stay in their folder."""
    spark, name = t.sparkSession, f"lf_fact_{uuid.uuid4().hex}"
    tables.ensure_table(spark, name, _folder(t, "fact-table"))
    try:
        tables.publish(tables.declared(t), name, lambda df, folder: df.write.parquet(folder), _folder(t, "fact-rows"))
        rows = spark.read.parquet(*spark.table(name).inputFiles())
        return use(name), rows
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def declared_columns(t: DataFrame) -> DataFrame:
    """The declared fact as the catalog knows it, a row a column, with how many loaded rows fill each."""
    meta, rows = _as_table(t, lambda name: tables.described(t.sparkSession, name))
    return (meta.join(tables.filled(rows), "column_name").orderBy("position")
            .select("position", "column_name", "data_type", "filled_rows", "total_rows"))


def ensured_twice(t: DataFrame) -> DataFrame:
    """Creating a table that is there changes nothing: its columns and the rows loaded before, after a second time."""
    spark = t.sparkSession

    def again(name: str) -> int:
        tables.ensure_table(spark, name)
        return len(spark.catalog.listColumns(name))

    columns, rows = _as_table(t, again)
    return rows.agg(F.lit(columns).cast("bigint").alias("n_columns"), F.count(F.lit(1)).alias("n_rows"))


def documentation(t: DataFrame) -> DataFrame:
    """Comments of the loaded fact and its columns, as the catalog has them, with the rows that each speaks of."""
    spark = t.sparkSession

    def commented(name: str) -> DataFrame:
        tables.comment(spark, name, L.FACT_TABLE_COMMENT, L.FACT_COLUMN_COMMENTS)
        said = [("", spark.catalog.getTable(name).description)]
        said += [(c.name, c.description) for c in spark.catalog.listColumns(name) if c.description]
        return spark.createDataFrame(said, "column_name string, comment string")

    meta, rows = _as_table(t, commented)
    counts = tables.filled(rows)
    whole = counts.limit(1).select(F.lit("").alias("column_name"), F.col("total_rows").alias("described_rows"))
    each = counts.select("column_name", F.col("filled_rows").alias("described_rows"))
    return meta.join(whole.unionAll(each), "column_name").select("column_name", "comment", "described_rows")
