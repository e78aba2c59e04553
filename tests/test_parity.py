"""Every catalogued query equals its DuckDB oracle on the driver's sf0.01 tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from ledgerframe.plans.catalog import CATALOG
from lf_oracle.compare import compare, duck
from tests.conftest import SF01, SF001

NAMES = sorted(CATALOG)


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_has_an_oracle():
    assert set(CATALOG) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_parity_sf001(spark, con, name):
    ok, msg = compare(E.queries()[name](spark, SF01), con, E.oracle_sql()[name])
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["day", "date_str", "year"]


def test_fixture_equals_oracle_derivation(spark):
    from ledgerframe.sources.fixture import load_fact
    from lf_oracle.sql import FACT

    c = duck(SF001)
    ok, msg = compare(load_fact(spark, SF001), c, FACT)
    assert ok, msg


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE",
                 "timestamp_ntz": "TIMESTAMP"}  # both are wall-clock timestamps without a zone


def test_result_types_match_oracle(spark):
    """Same column names and exactly the same types as the oracle, for every query."""
    con = duck(SF001)
    for name in NAMES:
        df = E.queries()[name](spark, SF001)
        ours = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(),
                                          f.dataType.simpleString().upper())
                for f in df.schema.fields}
        rel = con.sql(E.oracle_sql()[name])
        theirs = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        assert ours == theirs, name


@pytest.mark.parametrize("name", ["m01_preview", "m03_top_days", "q03_weekday", "q05_cohort",
                                  "q06_monthly", "q08_kpis"])
def test_results_do_not_depend_on_the_session_time_zone(spark, con, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        ok, msg = compare(E.queries()[name](spark, SF01), con, E.oracle_sql()[name])
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert ok, msg


def test_core_queries_stay_when_a_library_of_the_training_operators_is_missing():
    """A fresh interpreter in which numpy cannot be imported still registers every core query."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(E.__file__))
    code = ("import sys; sys.modules['numpy'] = None; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as E; "
            "from ledgerframe.plans.catalog import CATALOG; "
            "assert set(E.queries()) == set(E.oracle_sql()) == set(CATALOG)")
    done = subprocess.run([sys.executable, "-c", code, root], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
