"""Command line: load transaction files, rebuild the marts, run named queries.

    python -m ledgerframe load  --csv 'in/*.csv' --path out/fact        (or --table NAME)
    python -m ledgerframe marts --fact out/fact --out out/marts         (or catalog tables)
    python -m ledgerframe query --fact out/fact q01_overall q04_rfm --show 20
    python -m ledgerframe query --fact out/fact --all --out out/reports
    python -m ledgerframe query --fact out/fact --marts out/marts m03_monthly   # reads the stored marts
    python -m ledgerframe list

``--fact`` is a parquet folder or a catalog table name. Queries use the
current date and time unless ``--as-of`` / ``--updated-at`` pin them.
With ``--all`` every query is computed through one shared pre-aggregate.
Results are shown (``--show``) or written as parquet under ``--out``;
nothing larger than the shown rows reaches the driver.
"""

from __future__ import annotations

import argparse
import datetime as dt
import os
import sys


def _fact(spark, ref: str):
    return spark.read.parquet(ref) if os.sep in ref or "://" in ref else spark.table(ref)


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="ledgerframe")
    sub = ap.add_subparsers(dest="cmd", required=True)
    ld = sub.add_parser("load", help="CSV -> rules -> overwrite the fact table")
    ld.add_argument("--csv", required=True, nargs="+")
    ld.add_argument("--table", default=None)
    ld.add_argument("--path", default=None)
    ld.add_argument("--date-format", default="yyyy-MM-dd")
    mk = sub.add_parser("marts", help="rebuild the three marts from one pre-aggregate")
    mk.add_argument("--fact", required=True)
    mk.add_argument("--out", default=None, help="parquet root; catalog tables if omitted")
    mk.add_argument("--as-of", default=None)
    qy = sub.add_parser("query", help="run catalogued queries")
    qy.add_argument("--fact", required=True)
    qy.add_argument("names", nargs="*")
    qy.add_argument("--all", action="store_true")
    qy.add_argument("--marts", default=None, help="root of stored marts: read-backs read them, nothing is rebuilt")
    qy.add_argument("--as-of", default=None)
    qy.add_argument("--updated-at", default=None)
    qy.add_argument("--show", type=int, default=20)
    qy.add_argument("--out", default=None, help="write each result as parquet here")
    sub.add_parser("list", help="list query names")
    a = ap.parse_args(argv)

    from ledgerframe.plans import jobs
    from ledgerframe.plans.catalog import CATALOG, READ_BACKS, ROLLUP_KEYS, catalog, read_stored

    if a.cmd == "list":
        for k in CATALOG:
            print(f"{k:26s} {'rollup' if k in ROLLUP_KEYS else 'fact'}")
        return 0

    from ledgerframe.session import build_session

    spark = build_session()
    if a.cmd == "load":
        jobs.load_transactions(spark, a.csv, table=a.table or "fact_transactions", path=a.path,
                               date_format=a.date_format).show()
        return 0
    as_of = dt.date.fromisoformat(a.as_of) if a.as_of else None
    t = _fact(spark, a.fact)
    if a.cmd == "marts":
        for name, rep in jobs.rebuild_marts(t, root=a.out, as_of=as_of).items():
            print(name, rep.first()[0])
        return 0
    updated_at = dt.datetime.fromisoformat(a.updated_at) if a.updated_at else None
    cat = catalog(as_of, updated_at)
    names = list(cat) if a.all else a.names
    unknown = [n for n in names if n not in cat]
    if unknown or not names:
        print(f"unknown or no query names: {unknown}; see `list`", file=sys.stderr)
        return 2
    if a.all:
        stored = set(READ_BACKS) if a.marts else set()
        results = jobs.run_reports(t, keys=[n for n in names if n not in stored], as_of=as_of, updated_at=updated_at,
                                   pinned=False)
    else:
        results = {n: cat[n](t) for n in names if not (a.marts and n in READ_BACKS)}
    if a.marts:
        results |= {n: read() for n, read in read_stored(a.marts, spark).items() if n in names}
    for name, df in results.items():
        if a.out:
            df.write.mode("overwrite").parquet(f"{a.out.rstrip('/')}/{name}")
            print(f"wrote {name}")
        else:
            print(f"== {name}")
            df.show(a.show, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
