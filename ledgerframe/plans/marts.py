"""The three marts (daily, category, anomaly) and the queries that read them.

A mart build is a DataFrame; ``sources.tables.write_mart`` materialises it
(overwrite = full rebuild) range-sorted on its lookup key. Read-back
functions take the mart DataFrame, whether freshly built or read from
the table, so ``mart_by_month(spark.table('mart_suspicious_analysis'))``
and ``mart_by_month(anomaly_mart(t))`` are the same query.

``updated_at`` defaults to the build time; pass a fixed timestamp for
reproducible output.
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.functions import calendar as cal
from ledgerframe.functions import labels as L
from ledgerframe.functions.exact import (
    UNROUNDED_SCALE,
    as_count,
    div_round,
    mean,
    money,
    percent,
)
from ledgerframe.operators.bands import above_band
from ledgerframe.operators.grouped import FLAG, mean_of
from ledgerframe.operators.rollup import day_category_rollup, is_rollup  # noqa: F401
from ledgerframe.operators.window import (
    asc,
    desc,
    moving_deviation,
    moving_mean,
    sort_bounded,
    top_k,
)
from ledgerframe.plans.reports import _as_of
from ledgerframe.sources import manifest
from ledgerframe.sources.tables import mart_report, preview, write_mart

DAILY_MART = "mart_daily_metrics"
CATEGORY_MART = "mart_category_summary"
ANOMALY_MART = "mart_suspicious_analysis"

# Layout of each mart table: the order of its files and rows (column, descending), the folders it is parted
# into where it is a folder, and the columns whose values a Parquet bloom filter finds.
MART_LAYOUT = {
    DAILY_MART: {"sort_by": [("transaction_date", False)], "partition_by": ["year"]},
    CATEGORY_MART: {"sort_by": [("total_volume", True), ("category", False)], "partition_by": ["risk_segment"], "bloom": ["category"]},
    ANOMALY_MART: {"sort_by": [("day", True)], "partition_by": ["year"]},
}

# Documentation attached to the marts when written to the catalog.
MART_COMMENTS = {
    DAILY_MART: (L.DAILY_MART_COMMENT, L.DAILY_MART_COLUMN_COMMENTS),
    ANOMALY_MART: (L.ANOMALY_MART_COMMENT, L.ANOMALY_MART_COLUMN_COMMENTS),
}


def _updated_at(updated_at) -> Column:
    """Build time as a wall-clock TIMESTAMP_NTZ (the same in every session zone)."""
    if updated_at is None:
        return F.localtimestamp()
    if isinstance(updated_at, Column):
        return updated_at
    if isinstance(updated_at, str):
        updated_at = _dt.datetime.fromisoformat(updated_at)
    if isinstance(updated_at, _dt.date) and not isinstance(updated_at, _dt.datetime):
        updated_at = _dt.datetime.combine(updated_at, _dt.time())
    return F.expr(f"TIMESTAMP_NTZ '{updated_at.replace(tzinfo=None).isoformat(sep=' ')}'")


def _zero(col) -> Column:
    return F.coalesce(col, F.lit(0))


# ------------------------------------------------------- shared pre-aggregate
def _rollup(t: DataFrame | None, rollup: DataFrame | None) -> DataFrame:
    if rollup is not None:
        return rollup
    if t is not None and is_rollup(t):
        return t
    if t is None:
        raise ValueError("give the fact table or its day_category_rollup")
    return day_category_rollup(t)


def write_laid_out(name: str, parted: bool = True):
    """A writer of the named mart in its layout: ``write(mart, folder)``."""
    layout = MART_LAYOUT[name]

    def write(mart: DataFrame, path: str) -> None:
        order = [desc(c) if down else asc(c) for c, down in layout["sort_by"]]
        write_mart(mart, path=path, sort_by=order, partition_by=layout["partition_by"] if parted else None, bloom=layout.get("bloom"))

    return write


def stored_mart(name: str, t: DataFrame, build, **clock) -> DataFrame:
    """The mart of the fact ``t`` in its layout, read from the shared folder.

    A mart stored before from the same files with the same clock values is
    opened; else ``build(t)`` is written and entered in the manifest. A fact
    that is not read from files cannot be known again and is always built.
    """
    spark = t.sparkSession
    where = manifest.root(spark)
    key = manifest.key_of(t, name, **clock)
    found = manifest.find(spark, where, name, key) if key else None
    return manifest.store(spark, where, name, key, build(t), write_laid_out(name)) if found is None else found


def open_mart(spark, root: str, name: str) -> DataFrame:
    """The mart that ``jobs.rebuild_marts(root=...)`` last finished under ``root``."""
    found = manifest.find(spark, root, name)
    if found is None:
        raise FileNotFoundError(f"no {name} stored under {root}")
    return found


def layout_report(name: str, mart: DataFrame) -> DataFrame:
    """How a stored mart lies in its files, a row a folder: (mart, part, n_rows, lowest_key, highest_key, out_of_order, overlaps, folders).

    ``out_of_order`` counts rows that stand elsewhere in their file than the
    layout's order puts them, ``overlaps`` files of a folder whose range of the
    leading key meets the next file's, ``folders`` the folders that hold rows
    of the part (a lookup by it reads no other).
    """
    layout = MART_LAYOUT[name]
    order = [desc(c) if down else asc(c) for c, down in layout["sort_by"]]
    key, down = layout["sort_by"][0]
    part = layout["partition_by"][0]
    rows = mart.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    rows = rows.withColumn("__place", F.row_number().over(Window.partitionBy("__file").orderBy(*order)))
    files = rows.groupBy(F.col(part).cast("string").alias("part"), "__file").agg(
        F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"),
        F.count(F.when(F.col("__place") != F.col("__at") + 1, 1)).alias("moved"))
    by_key = Window.partitionBy("part").orderBy(F.col("low"), F.col("high"))
    files = files.withColumn("meets", F.lead("low").over(by_key) < F.col("high"))
    return files.groupBy("part").agg(
        F.sum("n").alias("n_rows"), F.min("low").cast("string").alias("lowest_key"), F.max("high").cast("string").alias("highest_key"),
        F.sum("moved").alias("out_of_order"), F.count(F.when(F.col("meets"), 1)).alias("overlaps"),
        F.countDistinct(F.regexp_replace("__file", "/[^/]*$", "")).alias("folders"),
    ).select(F.lit(name).alias("mart"), "part", "n_rows", "lowest_key", "highest_key", "out_of_order", "overlaps", "folders")


# ---------------------------------------------------------------- daily mart
def daily_mart(t: DataFrame | None, updated_at=None, rollup: DataFrame | None = None) -> DataFrame:
    """One row per day (NULL dates form one row): counts, sums, means, 7-row averages."""
    d = _rollup(t, rollup).groupBy("transaction_date").agg(
        F.sum("n").alias("__cnt"),
        F.count("description").alias("__cats"),
        F.sum("s_flag").alias("__fs"),
        *[F.sum(f"{k}_{c}").alias(f"__{k}_{c}") for c in ("debit", "credit", "balance")
          for k in ("s", "n")],
    )
    order = [asc("transaction_date")]
    keys = ["transaction_date"]
    return d.select(
        "transaction_date",
        cal.year("transaction_date").alias("year"),
        cal.month("transaction_date").alias("month"),
        cal.day_of_week("transaction_date").alias("day_of_week"),
        cal.day_name("transaction_date").alias("day_name"),
        as_count("__cnt").alias("transactions"),
        as_count("__cats").alias("unique_categories"),
        money(_zero(F.col("__s_debit"))).alias("total_debit"),
        money(_zero(F.col("__s_credit"))).alias("total_credit"),
        money(_zero(F.col("__s_debit") - F.col("__s_credit"))).alias("net_flow"),
        as_count("__fs").alias("suspicious_count"),
        percent("__fs", "__cnt").alias("suspicious_rate"),
        money(_zero(mean_of("debit"))).alias("avg_debit"),
        money(_zero(mean_of("credit"))).alias("avg_credit"),
        money(_zero(mean_of("balance"))).alias("avg_balance"),
        moving_mean("__cnt", keys, 7, 2).alias("transactions_ma7"),
        moving_mean("__fs", keys, 7, 2).alias("suspicious_ma7"),
        _updated_at(updated_at).alias("updated_at"),
    ).orderBy(*order)


def daily_mart_count(mart: DataFrame) -> DataFrame:
    return mart_report(mart, "rows_in_mart")


def daily_mart_preview(mart: DataFrame, n: int = 10) -> DataFrame:
    return preview(mart, [asc("transaction_date")], n)


# ------------------------------------------------------------- category mart
def category_mart(t: DataFrame | None, as_of=None, updated_at=None, min_rows: int = 5,
                  rollup: DataFrame | None = None) -> DataFrame:
    """One row per category with more than ``min_rows`` rows: span, volume, means, segments."""
    g = _rollup(t, rollup).groupBy(F.col("description").alias("category")).agg(
        F.sum("n").alias("__cnt"),
        F.count("transaction_date").alias("__days"),  # one rollup row per (day, category)
        F.min("transaction_date").alias("first_seen"),
        F.max("transaction_date").alias("last_seen"),
        *[F.sum(f"{k}_{c}").alias(f"__{k}_{c}") for c in ("debit", "credit") for k in ("s", "n")],
        F.sum("s_flag").alias("__fs"),
        F.sum("n_flag").alias("__fn"),
    ).where(F.col("__cnt") > min_rows)
    volume = _zero(F.col("__s_debit") + F.col("__s_credit"))
    fs, fn = F.col("__fs"), F.col("__fn")
    # flagged share compared unrounded: fs/fn > 0.1  <=>  10*fs > fn (fn > 0)
    risk = (
        F.when((fn > 0) & (fs * 10 > fn), F.lit(L.RISK_SEGMENTS[0][0]))
        .when((fn > 0) & (fs * 20 > fn), F.lit(L.RISK_SEGMENTS[1][0]))
        .otherwise(F.lit(L.RISK_SEGMENT_ELSE))
    )
    return g.select(
        "category",
        as_count("__cnt").alias("transaction_count"),
        as_count("__days").alias("active_days"),
        "first_seen",
        "last_seen",
        cal.days_between(_as_of(as_of), F.col("last_seen")).alias("days_since_last"),
        money(_zero(F.col("__s_debit"))).alias("total_debit"),
        money(_zero(F.col("__s_credit"))).alias("total_credit"),
        money(volume).alias("total_volume"),
        money(_zero(mean_of("debit"))).alias("avg_debit"),
        money(_zero(mean_of("credit"))).alias("avg_credit"),
        as_count("__fs").alias("suspicious_count"),
        percent("__fs", "__fn").alias("suspicious_percentage"),
        above_band(volume, L.VALUE_SEGMENTS, L.VALUE_SEGMENT_ELSE).alias("value_segment"),
        above_band("__cnt", L.FREQUENCY_SEGMENTS, L.FREQUENCY_SEGMENT_ELSE).alias("frequency_segment"),
        risk.alias("risk_segment"),
        _updated_at(updated_at).alias("updated_at"),
    ).orderBy(desc("total_volume"), asc("category"))


def category_mart_count(mart: DataFrame) -> DataFrame:
    return mart_report(mart, "categories")


def category_mart_preview(mart: DataFrame, n: int = 10) -> DataFrame:
    return preview(mart, [desc("total_volume"), asc("category")], n)


# -------------------------------------------------------------- anomaly mart
def _anomaly_daily(r: DataFrame) -> DataFrame:
    """Flagged vs normal split per day from the (day, category) rollup.

    The two distinct category counts are counts of rollup rows with a
    flagged / normal row (instead of two COUNT(DISTINCT), which Spark plans
    as an Expand that triples the fact rows).
    """
    known = F.col("description").isNotNull()
    return r.groupBy(F.col("transaction_date").alias("day")).agg(
        F.sum("n").alias("total_transactions"),
        F.sum("n_f1").alias("suspicious_count"),
        F.sum("n_f0").alias("normal_count"),
        F.sum("sd_f1").alias("suspicious_debit"),
        F.sum("sd_f0").alias("normal_debit"),
        F.sum("sc_f1").alias("suspicious_credit"),
        F.sum("sc_f0").alias("normal_credit"),
        F.sum("__s_d_f1").alias("__s_sdm"),
        F.sum("__n_d_f1").alias("__n_sdm"),
        F.sum("__s_d_f0").alias("__s_ndm"),
        F.sum("__n_d_f0").alias("__n_ndm"),
        F.count(F.when(known & (F.col("n_f1") > 0), 1)).alias("suspicious_categories"),
        F.count(F.when(known & (F.col("n_f0") > 0), 1)).alias("normal_categories"),
    )


def anomaly_mart(t: DataFrame | None, updated_at=None, rollup: DataFrame | None = None) -> DataFrame:
    """Daily flagged-vs-normal mart with a 7-row baseline and anomaly labels."""
    b = _anomaly_daily(_rollup(t, rollup))
    order = [asc("day")]
    keys = ["day"]
    sc = F.col("suspicious_count")
    s = b.select(
        "day",
        as_count("total_transactions").alias("total_transactions"),
        as_count("suspicious_count").alias("suspicious_count"),
        as_count("normal_count").alias("normal_count"),
        percent("suspicious_count", "total_transactions").alias("suspicious_rate"),
        moving_mean("suspicious_count", keys, 7, 2).alias("avg_suspicious_7d"),
        moving_deviation("suspicious_count", keys, 7, 2).alias("deviation_from_avg"),
        money("suspicious_debit").alias("suspicious_debit"),
        money("normal_debit").alias("normal_debit"),
        money("suspicious_credit").alias("suspicious_credit"),
        money("normal_credit").alias("normal_credit"),
        mean_of("sdm").alias("avg_suspicious_debit"),
        mean_of("ndm").alias("avg_normal_debit"),
        as_count("suspicious_categories").alias("suspicious_categories"),
        as_count("normal_categories").alias("normal_categories"),
    )
    s = s.withColumn(
        "suspicious_debit_share",
        percent("suspicious_debit", F.col("suspicious_debit") + F.col("normal_debit"),
                part_scale=2, whole_scale=2),
    ).withColumn(
        "suspicious_debit_multiplier",
        money(_zero(div_round("avg_suspicious_debit", "avg_normal_debit", 2,
                              num_scale=2, den_scale=2))),
    )
    avg7 = F.col("avg_suspicious_7d")
    label = None
    for name, op, factor in L.ANOMALY_RULES:
        edge = avg7 * F.lit(Decimal(factor))
        cond = sc > edge if op == ">" else sc < edge
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
    label = label.otherwise(F.lit(L.ANOMALY_NORMAL))
    scat, ncat = F.col("suspicious_categories"), F.col("normal_categories")
    return s.select(
        "day",
        cal.date_str("day").alias("date_str"),
        cal.year("day").alias("year"),
        cal.month("day").alias("month"),
        cal.day_of_week("day").alias("day_of_week"),
        cal.day_name("day").alias("day_name"),
        "total_transactions",
        "suspicious_count",
        "normal_count",
        "suspicious_rate",
        "avg_suspicious_7d",
        "deviation_from_avg",
        label.alias("anomaly_flag"),
        "suspicious_debit",
        "normal_debit",
        "suspicious_credit",
        "normal_credit",
        "suspicious_debit_share",
        "avg_suspicious_debit",
        "avg_normal_debit",
        "suspicious_debit_multiplier",
        "suspicious_categories",
        "normal_categories",
        percent(scat, scat + ncat).alias("suspicious_categories_share"),
        F.when(F.col("suspicious_rate") > L.HIGH_RISK_DAY_RATE, 1).otherwise(0).cast("bigint")
        .alias("high_risk_day_flag"),
        F.when(F.col("suspicious_debit_multiplier") > L.LARGE_MULTIPLIER, 1).otherwise(0)
        .cast("bigint").alias("large_suspicious_flag"),
        _updated_at(updated_at).alias("updated_at"),
    ).orderBy(desc("day"))


def top_risk_days(mart: DataFrame, n: int = 20) -> DataFrame:
    """The n mart days with the highest flagged rate (rate > 0)."""
    rows = mart.where(F.col("suspicious_rate") > 0)
    return top_k(rows, [desc("suspicious_rate"), asc("day")], n).select(
        "date_str", "day_name", "total_transactions", "suspicious_count", "suspicious_rate",
        "anomaly_flag", "suspicious_debit", "avg_suspicious_debit")


def anomalous_days(mart: DataFrame, labels=tuple(L.ANOMALY_LABELS)) -> DataFrame:
    """Mart days labelled as anomalies, by deviation from the baseline."""
    return mart.where(F.col("anomaly_flag").isin(*labels)).orderBy(
        desc("deviation_from_avg"), asc("day")).select(
        "date_str", "day_name", "total_transactions", "suspicious_count", "avg_suspicious_7d",
        "deviation_from_avg", "anomaly_flag", "suspicious_debit", "suspicious_categories")


def mart_by_weekday(mart: DataFrame) -> DataFrame:
    """Per weekday: mean and max rate, flagged sum, mean multiplier, critical days."""
    g = mart.groupBy("day_name", "day_of_week").agg(
        F.sum("suspicious_rate").alias("__sr"), F.count("suspicious_rate").alias("__nr"),
        F.max("suspicious_rate").alias("max_suspicious_rate"),
        F.sum("suspicious_count").alias("total_suspicious"),
        F.sum("suspicious_debit_multiplier").alias("__sm"),
        F.count("suspicious_debit_multiplier").alias("__nm"),
        F.count(F.when(F.col("anomaly_flag") == L.ANOMALY_CRITICAL, 1))
        .alias("critical_anomaly_days"),
    )
    g = g.select(
        "day_name",
        mean("__sr", "__nr", UNROUNDED_SCALE, scale=2).alias("avg_suspicious_rate"),
        "max_suspicious_rate",
        as_count("total_suspicious").alias("total_suspicious"),
        mean("__sm", "__nm", UNROUNDED_SCALE, scale=2).alias("avg_amount_multiplier"),
        as_count("critical_anomaly_days").alias("critical_anomaly_days"),
        "day_of_week",
    )
    return sort_bounded(g, [asc("day_of_week")]).drop("day_of_week")


def mart_by_month(mart: DataFrame) -> DataFrame:
    """Per year and month: mean daily rate, rate of the sums, totals, anomaly days."""
    g = mart.groupBy("year", "month").agg(
        F.sum("suspicious_rate").alias("__sr"), F.count("suspicious_rate").alias("__nr"),
        F.sum("suspicious_count").alias("__sc"),
        F.sum("total_transactions").alias("__tt"),
        F.sum("suspicious_debit").alias("__sd"),
        F.count(F.when(F.col("anomaly_flag").like(L.ANOMALY_PATTERN), 1)).alias("__ad"),
    )
    return g.select(
        "year",
        "month",
        mean("__sr", "__nr", UNROUNDED_SCALE, scale=2).alias("avg_monthly_rate"),
        as_count("__sc").alias("total_suspicious"),
        as_count("__tt").alias("total_txns"),
        percent("__sc", "__tt", zero_is_null=False).alias("actual_rate"),
        money("__sd").alias("total_suspicious_debit"),
        as_count("__ad").alias("anomaly_days"),
    ).orderBy(asc("year"), asc("month"))
