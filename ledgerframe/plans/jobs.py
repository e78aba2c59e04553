"""End-to-end batch jobs: load transaction files, rebuild the marts.

``load_transactions`` is the load entry: read CSV (FAILFAST), check the
table rules, replace the fact table with fresh surrogate ids, report the
row count. ``rebuild_marts`` is the mart entry: every mart is a full
rebuild written in key order with its documentation, then counted.
Both write to a catalog table (``name``) or a path (``root``), never to
the driver.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerframe.functions import labels as L
from ledgerframe.operators.validate import assert_valid
from ledgerframe.plans import marts
from ledgerframe.sources import csv as csvsrc
from ledgerframe.session import checkpoint_dir, staged
from ledgerframe.sources import manifest, tables


def load_transactions(
    spark: SparkSession,
    csv_path: str | list[str],
    table: str | None = tables.FACT_TABLE,
    path: str | None = None,
    date_format: str = "yyyy-MM-dd",
    check_rules: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """CSV -> rule check -> overwrite the fact table -> one-row load report.

    The CSV is parsed exactly once: it is staged as parquet in the shared
    checkpoint folder (the parse is FAILFAST, so a bad row aborts here),
    and the rule check and the dense ids, in file order, read the
    columnar copy.
    """
    raw = csvsrc.read_transactions(spark, csv_path, date_format=date_format,
                                   multi_line=multi_line, position=True)
    stage_path = _staging_path(spark)
    try:
        raw.write.mode("overwrite").parquet(stage_path)
        rows = tables.with_surrogate_id(spark.read.parquet(stage_path), dense=True)
        if check_rules:
            # row rules only: the ids were just generated and are unique by construction
            assert_valid(rows, check_unique=False)
        if path:
            tables.load(rows, path=path)
            return tables.footer_count(spark, path, "loaded_rows")
        else:
            base = f"{checkpoint_dir(spark).rstrip('/')}/ledgerframe-tables"
            tables.publish(tables.declared(rows), table, lambda df, folder: df.write.parquet(folder), base)
            tables.comment(spark, table, L.FACT_TABLE_COMMENT, L.FACT_COLUMN_COMMENTS)
            return tables.load_report(spark.table(table))
    finally:
        _delete(spark, stage_path)  # the staged copy is as large as the input


def _delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through the Hadoop file system of the cluster."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _staging_path(spark: SparkSession) -> str:
    root = checkpoint_dir(spark)
    return f"{root.rstrip('/')}/ledgerframe-staging-{uuid.uuid4().hex}"


def rebuild_marts(
    t: DataFrame,
    root: str | None = None,
    as_of=None,
    updated_at=None,
    names: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Rebuild the daily, category and anomaly marts; return their row-count reports.

    The fact table is scanned once: all three marts derive from one
    stored (day, category) pre-aggregate.

    With ``root`` the marts are Parquet folders under it, entered in its
    manifest when they are whole (``marts.open_mart`` reads the last);
    otherwise they are catalog tables (``names`` may rename them) with
    comments attached, moved to the new rows when those are whole.
    """
    spark = t.sparkSession
    # one scan of the fact table: the shared (day, category) pre-aggregate is
    # written to the cluster's shared folder and feeds all three marts
    r = staged(marts.day_category_rollup(t), "rollup")
    builds = {
        marts.DAILY_MART: (marts.daily_mart(None, updated_at=updated_at, rollup=r), "rows_in_mart"),
        marts.CATEGORY_MART: (marts.category_mart(None, as_of=as_of, updated_at=updated_at,
                                                  rollup=r), "categories"),
        marts.ANOMALY_MART: (marts.anomaly_mart(None, updated_at=updated_at, rollup=r),
                             "rows_in_mart"),
    }
    reports = {}
    for key, (df, count_alias) in builds.items():
        if root:
            written = manifest.store(spark, root.rstrip("/"), key, None, df, marts.write_laid_out(key))
        else:
            name = (names or {}).get(key, key)
            base = f"{checkpoint_dir(spark).rstrip('/')}/ledgerframe-tables"
            tables.publish(df, name, marts.write_laid_out(key, parted=False), base)
            if key in marts.MART_COMMENTS:
                title, cols = marts.MART_COMMENTS[key]
                tables.comment(spark, name, title, cols)
            written = spark.table(name)
        reports[key] = tables.mart_report(written, count_alias)
    return reports


def run_reports(t: DataFrame, keys=None, as_of=None, updated_at=None,
                pinned: bool = True) -> dict[str, DataFrame]:
    """Every catalogued report, mart and read-back with one pre-aggregation.

    The (day, category) rollup is computed once and written to the shared
    folder in buckets of categories; the queries that need only day- or category-level
    sums and counts read the columns they use, the few that need row-level
    values read the fact table. Each mart that a read-back asks for is
    stored once and serves all its read-backs. Returns DataFrames keyed
    by name.
    ``pinned=True`` uses the catalogue's fixed clock values; otherwise
    ``as_of`` / ``updated_at`` (None: the moment the query runs).
    """
    from ledgerframe.operators.rollup import day_category_rollup
    from ledgerframe.plans.catalog import AS_OF, READ_BACKS, ROLLUP_KEYS, UPDATED_AT, catalog, mart_builds

    if pinned:
        as_of, updated_at = AS_OF, UPDATED_AT
    cat = catalog(as_of, updated_at)
    wanted = list(keys or cat)
    rollup = None
    if any(k in ROLLUP_KEYS for k in wanted):
        # in buckets of categories: the reports by category (RFM, cohorts, ranks, category mart) group where the rows lie
        rollup = tables.bucketed(day_category_rollup(t), "description", checkpoint_dir(t.sparkSession))
    builds = mart_builds(as_of, updated_at)
    clock = {"as_of": as_of or _dt.date.today(), "updated_at": updated_at or "build"}
    stored = {m: marts.stored_mart(m, t, lambda _, m=m: builds[m](rollup), **clock)
              for m in {READ_BACKS[k][0] for k in wanted if k in READ_BACKS}}

    def result(k: str) -> DataFrame:
        if k in READ_BACKS:
            mart, read = READ_BACKS[k]
            return read(stored[mart])
        return cat[k](rollup if k in ROLLUP_KEYS else t)

    return {k: result(k) for k in wanted}
