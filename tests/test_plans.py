"""Physical-plan properties that matter at scale, checked on a stored fact table."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

import pytest

from ledgerframe.plans import cohort, marts, reports
from ledgerframe.sources.fixture import load_fact
from tests.conftest import SF001


@pytest.fixture(scope="module")
def fact(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="lf-plan-", dir="/tmp"), "fact")
    load_fact(spark, SF001).write.parquet(path)
    return spark.read.parquet(path)


def plan(df) -> str:
    jvm = df.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def tree(df) -> str:
    """The operator tree of the formatted plan (without per-node details)."""
    return plan(df).split("\n\n")[0]


def test_filter_and_columns_reach_the_scan(fact):
    p = plan(reports.large_flagged(fact))
    assert "PushedFilters: [IsNotNull(is_suspicious), IsNotNull(debit), EqualTo(is_suspicious,1)" in p
    assert "GreaterThan(debit,100000" in p
    assert "TakeOrderedAndProject" in p


def test_projection_is_pruned(fact):
    p = plan(reports.monthly_flag_trend(fact))
    assert "ReadSchema: struct<transaction_date:date,debit:decimal(15,2),is_suspicious:int>" in p


def test_cohort_scans_the_fact_once_without_join_of_fact(fact):
    p = tree(cohort.cohort_retention(fact))
    assert p.count("Scan parquet") == 1, p
    assert "Join" not in p


def test_first_last_is_an_aggregate_not_a_sort_of_the_fact(fact):
    p = plan(reports.first_last(fact))
    assert "Window" not in p
    assert "HashAggregate" in p and "SortAggregate" not in p and "Sort " not in tree(reports.first_last(fact))


def test_anomaly_mart_has_no_expand(fact):
    p = plan(marts.anomaly_mart(fact, updated_at=dt.datetime(2002, 1, 1)))
    assert "Expand" not in p


def test_distinct_counts_expand_the_rollup_and_not_the_fact(fact):
    for df in (reports.dashboard(fact), reports.kpis_long(fact)):
        p = tree(df)
        below = p[p.index("Expand"):]
        assert "Exchange" in below and "Aggregate" in below.split("Scan parquet")[0]


def test_dashboard_and_big_categories_single_pass(fact):
    for df in (reports.dashboard(fact), reports.big_categories(fact, min_volume=1000000)):
        p = tree(df)
        assert p.count("Scan parquet") == 1, p
        assert "Join" not in p


def test_daily_windows_run_on_aggregated_days(fact):
    # the only single-partition exchange is above the per-day aggregate
    p = plan(marts.daily_mart(fact, updated_at=dt.datetime(2002, 1, 1)))
    below_window = p.split("Window")[1]
    assert "HashAggregate" in below_window


def _nodes(p: str):
    """(id, name, depth) of each operator line of a formatted plan tree."""
    import re

    out = []
    for line in p.split("\n\n")[0].splitlines()[1:]:
        m = re.match(r"^([ :|+\-]*)(\w[\w ]*?) \((\d+)\)", line)
        if m:
            out.append((int(m.group(3)), m.group(2).strip(), len(m.group(1))))
    return out


def _single_partition_ids(p: str):
    import re

    ids = set()
    for block in p.split("\n\n")[1:]:
        m = re.match(r"\((\d+)\) (Exchange|ShuffleQueryStage)", block.strip())
        if m and "SinglePartition" in block:
            ids.add(int(m.group(1)))
    return ids


def _aggregated_below(nodes, idx) -> bool:
    """Every path from nodes[idx] down to a scan passes an aggregate or a broadcast."""
    _, _, depth = nodes[idx]
    j = idx + 1
    children = []
    while j < len(nodes) and nodes[j][2] > depth:
        if not children or nodes[j][2] == nodes[children[0]][2]:
            children.append(j)
        j += 1
    if not children:
        return False  # a leaf (scan) reached without aggregation
    for c in children:
        name = nodes[c][1]
        if "Aggregate" in name or "BroadcastExchange" in name or "Scan ExistingRDD" in name:
            continue  # aggregated (or a checkpointed, already aggregated frame)
        if not _aggregated_below(nodes, c):
            return False
    return True


@pytest.mark.parametrize("key", ["q01_overall", "q01_by_flag", "q03_moving_avg", "q03_cumulative",
                                 "q04_rfm", "q05_cohort", "q07_daily_moving", "q07_ranking",
                                 "q07_monthly_cumulative", "q07_period_change", "q08_kpis",
                                 "q08_monthly", "q08_dashboard", "m01_daily", "m02_category",
                                 "m03_anomaly", "m03_weekday", "m03_monthly", "l06_validate"])
def test_no_single_partition_exchange_over_raw_fact_rows(fact, key):
    from ledgerframe.plans.catalog import CATALOG

    p = plan(CATALOG[key](fact))
    nodes = _nodes(p)
    single = _single_partition_ids(p)
    for i, (nid, name, _) in enumerate(nodes):
        if nid in single:
            assert _aggregated_below(nodes, i), f"{key}: single-partition exchange ({nid}) over raw rows"


def test_bucketed_rollup_groups_categories_without_an_exchange(spark):
    from ledgerframe.operators.rollup import day_category_rollup
    from ledgerframe.plans import cohort, marts
    from ledgerframe.session import checkpoint_dir
    from ledgerframe.sources import tables
    from ledgerframe.sources.fixture import load_fact
    from tests.conftest import SF001

    plain = day_category_rollup(load_fact(spark, SF001))
    rollup = tables.bucketed(plain, "description", checkpoint_dir(spark), buckets=4)
    assert sorted(map(str, rollup.collect())) == sorted(map(str, plain.collect()))
    for report in (lambda r: marts.category_mart(r, updated_at="2002-01-01", as_of="2002-01-01"), cohort.cohort_retention):
        plan = report(rollup)._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        first = max(i for i, line in enumerate(lines) if "Aggregate(keys=[description" in line)
        assert "Bucketed: true" in plan and not any("Exchange" in line for line in lines[first:]), plan
        assert sorted(map(str, report(rollup).collect())) == sorted(map(str, report(plain).collect()))
