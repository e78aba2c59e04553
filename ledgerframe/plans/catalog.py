"""Named catalogue of every report, mart and read-back.

``CATALOG[key](t)`` runs one query over a fact DataFrame ``t``. Results
that depend on the clock take the pinned ``AS_OF`` / ``UPDATED_AT`` so
they are reproducible (the original reports use CURRENT_DATE and
CURRENT_TIMESTAMP; pass your own to the plan functions).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame

from ledgerframe.operators.validate import validate
from ledgerframe.plans import cohort, loads, marts, reports, rfm
from ledgerframe.sources.tables import load_report

AS_OF = _dt.date(2002, 1, 1)
UPDATED_AT = _dt.datetime(2002, 1, 1, 0, 0, 0)


# name -> (mart, query over the stored mart)
READ_BACKS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "m01_count": (marts.DAILY_MART, marts.daily_mart_count),
    "m01_preview": (marts.DAILY_MART, marts.daily_mart_preview),
    "m02_count": (marts.CATEGORY_MART, marts.category_mart_count),
    "m02_preview": (marts.CATEGORY_MART, marts.category_mart_preview),
    "m03_top_days": (marts.ANOMALY_MART, marts.top_risk_days),
    "m03_anomalies": (marts.ANOMALY_MART, marts.anomalous_days),
    "m03_weekday": (marts.ANOMALY_MART, marts.mart_by_weekday),
    "m03_monthly": (marts.ANOMALY_MART, marts.mart_by_month),
}


def mart_builds(as_of=AS_OF, updated_at=UPDATED_AT) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Mart name -> its build over the fact table or its rollup."""
    return {
        marts.DAILY_MART: lambda t: marts.daily_mart(t, updated_at=updated_at),
        marts.CATEGORY_MART: lambda t: marts.category_mart(t, as_of=as_of, updated_at=updated_at),
        marts.ANOMALY_MART: lambda t: marts.anomaly_mart(t, updated_at=updated_at),
    }


def _read_back(mart: str, build, read, clock: dict) -> Callable[[DataFrame], DataFrame]:
    """A read-back reads the stored mart; the first one of a fact stores it (see ``sources.manifest``)."""
    return lambda t: read(marts.stored_mart(mart, t, build, **clock))


def _layouts(t: DataFrame, builds, clock: dict) -> DataFrame:
    """How the three stored marts lie in their files."""
    reports = [marts.layout_report(m, marts.stored_mart(m, t, build, **clock)) for m, build in builds.items()]
    return reports[0].unionAll(reports[1]).unionAll(reports[2])


def read_stored(root: str, spark) -> dict[str, Callable[[], DataFrame]]:
    """name -> read-back over the marts that ``jobs.rebuild_marts(root=...)`` stored under ``root``."""
    return {k: (lambda mart=mart, read=read: read(marts.open_mart(spark, root, mart)))
            for k, (mart, read) in READ_BACKS.items()}


def catalog(as_of=AS_OF, updated_at=UPDATED_AT) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """name -> query over a fact table (or its rollup, for ROLLUP_KEYS).

    ``as_of`` replaces CURRENT_DATE and ``updated_at`` CURRENT_TIMESTAMP;
    pass None for the clock values of the moment the query runs.
    """
    builds = mart_builds(as_of, updated_at)
    # a mart of today's date is known again today; its build time is that of the build
    clock = {"as_of": as_of or _dt.date.today(), "updated_at": updated_at or "build"}
    return {
        # load and table rules
        "l01_reload": loads.reload_twice,
        "l02_csv_round_trip": loads.csv_round_trip,
        "l02_csv_line_breaks": loads.csv_line_breaks,
        "l03_surrogate_id": loads.ids_in_file_order,
        "l04_load_report": load_report,
        "l05_schema": loads.declared_columns,
        "l06_validate": validate,
        "l09_ensure": loads.ensured_twice,
        "l11_comments": loads.documentation,
        "l14_layout": lambda t: _layouts(t, builds, clock),
        # basic stats
        "q01_overall": reports.overall_stats,
        "q01_by_flag": lambda t: reports.stats_by(t),
        "q01_top_days": reports.top_days,
        # detailed stats
        "q03_amount_bands": reports.amount_bands,
        "q03_weekday": reports.weekday_flags,
        "q03_moving_avg": reports.daily_moving_average,
        "q03_top_flagged": reports.top_flagged,
        "q03_cumulative": reports.cumulative_daily,
        # RFM
        "q04_rfm": lambda t: rfm.rfm(t, as_of=as_of),
        "q04_rfm_all": lambda t: rfm.rfm(t, n=None, as_of=as_of),
        "q04_big_categories": lambda t: reports.big_categories(t, as_of=as_of),
        "q04_big_categories_1m": lambda t: reports.big_categories(t, min_volume=1000000, as_of=as_of),
        # cohorts
        "q05_cohort": cohort.cohort_retention,
        # suspicious analysis
        "q06_by_flag": reports.flag_stats,
        "q06_monthly": reports.monthly_flag_trend,
        "q06_top_flagged": reports.top_flagged_detail,
        "q06_weekday": reports.weekday_flag_sums,
        "q06_large": reports.large_flagged,
        # window analyses
        "q07_daily_moving": reports.daily_moving,
        "q07_ranking": reports.rank_categories,
        "q07_ranking_all": lambda t: reports.rank_categories(t, n=None),
        "q07_monthly_cumulative": reports.monthly_cumulative,
        "q07_period_change": reports.period_change,
        "q07_first_last": reports.first_last,
        # business insights
        "q08_kpis": reports.kpis_long,
        "q08_monthly": reports.monthly_dynamics,
        "q08_top_categories": reports.top_categories,
        "q08_weekday": reports.weekday_profile,
        "q08_seasonality": reports.day_of_month_profile,
        "q08_risk_bands": reports.risk_bands,
        "q08_dashboard": reports.dashboard,
        # marts, and the queries that read a stored one
        "m01_daily": builds[marts.DAILY_MART],
        "m02_category": builds[marts.CATEGORY_MART],
        "m03_anomaly": builds[marts.ANOMALY_MART],
        **{k: _read_back(mart, builds[mart], read, clock) for k, (mart, read) in READ_BACKS.items()},
    }


CATALOG: dict[str, Callable[[DataFrame], DataFrame]] = catalog()

# Queries that need only day- or category-level sums and counts: they run
# unchanged on the (day, category) rollup of the fact table. The others
# need row-level values (amount bands, balance extremes per flag, first/
# last rows, largest rows, per-row rules) and read the fact table.
ROLLUP_KEYS = frozenset({
    "q01_overall", "q01_top_days",
    "q03_weekday", "q03_moving_avg", "q03_top_flagged", "q03_cumulative",
    "q04_rfm", "q04_rfm_all", "q04_big_categories", "q04_big_categories_1m", "q05_cohort",
    "q06_monthly", "q06_top_flagged", "q06_weekday",
    "q07_daily_moving", "q07_ranking", "q07_ranking_all", "q07_monthly_cumulative", "q07_period_change",
    "q08_kpis", "q08_monthly", "q08_top_categories", "q08_weekday", "q08_seasonality",
    "q08_dashboard",
    "m01_daily", "m01_count", "m01_preview", "m02_category", "m02_count", "m02_preview",
    "m03_anomaly", "m03_top_days", "m03_anomalies", "m03_weekday", "m03_monthly",
})
FACT_KEYS = frozenset(CATALOG) - ROLLUP_KEYS
