"""Distributed RANK / ROW_NUMBER / NTILE equal the single-partition windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerframe.operators import ranking


def _frame(spark, n, seed, hot_share=0.34):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        if rnd.random() < hot_share:
            v = 0  # one value shared by a third of the rows
        elif rnd.random() < 0.05:
            v = None
        else:
            v = rnd.randint(-20, 20)
        rows.append((f"k{i:05d}", v))
    return spark.createDataFrame(rows, "k string, v long")


@pytest.mark.parametrize("n,parts,seed", [(1, 3, 1), (17, 4, 2), (500, 7, 3), (2000, 16, 4)])
def test_rank_matches_native(spark, n, parts, seed):
    df = _frame(spark, n, seed)
    got = ranking.rank_desc(df, "v", "r", tiebreak="k", n_parts=parts)
    exp = df.withColumn("r", F.rank().over(Window.orderBy(F.col("v").desc_nulls_first())))
    assert sorted(got.collect()) == sorted(exp.collect())


@pytest.mark.parametrize("n,parts,buckets", [(7, 3, 5), (3, 4, 5), (1001, 8, 5), (250, 5, 7)])
def test_ntile_and_row_number_match_native(spark, n, parts, buckets):
    df = _frame(spark, n, n)
    key, tb = F.col("v").asc_nulls_last(), F.col("k").asc_nulls_last()
    w = Window.orderBy(key, tb)
    got = ranking.ntile(df, buckets, key, tb, "t", n_parts=parts)
    exp = df.withColumn("t", F.ntile(buckets).over(w))
    assert sorted(got.collect()) == sorted(exp.collect())
    got = ranking.row_number(df, key, tb, "t", n_parts=parts)
    exp = df.withColumn("t", F.row_number().over(w))
    assert sorted(got.collect()) == sorted(exp.collect())


def test_plan_has_no_single_partition_exchange_of_rows(spark):
    out = ranking.rank_desc(_frame(spark, 100, 9), "v", "r", tiebreak="k", n_parts=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_wide_frame_of_many_rows_matches_native(spark, tmp_path):
    """200,000 rows, extra columns, 16 slices, a value shared by a third; results written and compared in full."""
    v = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 41 == 0, None).otherwise(F.xxhash64("id") % 5000)
    df = spark.range(0, 200_000, 1, 16).select(
        F.format_string("k%06d", F.col("id")).alias("k"), v.cast("long").alias("v"),
        F.md5(F.col("id").cast("string")).alias("pad"), (F.col("id") * 2).alias("x"), F.lit("y").alias("z"))
    key, tb = F.col("v").desc_nulls_first(), F.col("k").asc_nulls_last()
    got = ranking.rank_desc(df, "v", "r", tiebreak="k", n_parts=16)
    got = ranking.row_number(got, key, tb, "n", n_parts=16)
    got = ranking.ntile(got, 5, key, tb, "t", n_parts=16)
    got.write.parquet(str(tmp_path / "got"))
    w = Window.orderBy(key, tb)
    want = (df.withColumn("r", F.rank().over(Window.orderBy(key)).cast("long"))
            .withColumn("n", F.row_number().over(w).cast("long")).withColumn("t", F.ntile(5).over(w).cast("long")))
    back = spark.read.parquet(str(tmp_path / "got"))
    assert back.count() == 200_000
    assert want.exceptAll(back).count() == 0


def _whole(key):
    return F.when(F.col(key).isNotNull(), F.array(F.col(key).cast("decimal(38,0)")))


@pytest.mark.parametrize("n,seed", [(0, 1), (1, 2), (700, 3), (3000, 4)])
def test_ranks_by_counting_match_native(spark, n, seed):
    rnd = random.Random(seed)
    wide = [0, 7, 9, 10, 99, 100, 101, 999, 1000, 1001, 10**12, 10**12 + 1, -1, -9, -10, -10**15, None]
    rows = [(f"k{i % 50}", rnd.choice(wide), None if rnd.random() < 0.34 else rnd.randint(-10**9, 10**9)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, v long, w long").repartition(4)
    got = ranking.ranks_desc(df, {"rv": (_whole("v"), ranking.decimal_slice(F.col("v"))), "rw": (_whole("w"), ranking.decimal_slice(F.col("w")))})
    native = lambda c: F.rank().over(Window.orderBy(F.col(c).desc_nulls_first())).cast("bigint")
    exp = df.withColumn("rv", native("v")).withColumn("rw", native("w"))
    assert sorted(got.collect(), key=str) == sorted(exp.collect(), key=str)


def test_ranks_by_counting_run_no_job_and_gather_no_rows(spark):
    df = spark.range(10_000).select((F.col("id") % 97).alias("v"))
    status = spark.sparkContext.statusTracker()
    before = set(status.getJobIdsForGroup(None))
    out = ranking.ranks_desc(df, {"r": (_whole("v"), ranking.decimal_slice(F.col("v")))})
    assert set(status.getJobIdsForGroup(None)) == before
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(__axis" in plan


def test_slices_never_fall_where_keys_rise(spark):
    values = sorted({0, *[s * (10**e + d) for e in range(37) for d in (-1, 0, 1, 10**max(0, e - 3)) for s in (1, -1)]})
    rows = spark.createDataFrame([(str(v),) for v in values], "v string").select(F.col("v").cast("decimal(38,0)").alias("v"))
    got = [r["s"] for r in rows.select("v", ranking.decimal_slice(F.col("v")).alias("s")).orderBy("v").collect()]
    assert got == sorted(got) and len(set(got)) > 100


def test_fraction_keys_order_exactly(spark):
    from fractions import Fraction

    rnd = random.Random(8)
    pairs = [(rnd.randrange(d + 1), d) for d in (rnd.choice([1, 2, 3, 10, 3 * 10**8 + 1, 2**62, 10**18 - 1]) for _ in range(400))]
    pairs += [(10**18 - 2, 10**18 - 1), (10**18 - 3, 10**18 - 2), (1, 3), (2, 6), (0, 5), (0, 7), (5, 5), (7, 2), (-1, 3), (-7, 2), (2**61, 2**62)]
    a, b = 1, 1
    while b < 2**62:  # neighbours whose continued fractions are longest
        pairs += [(a, b), (a, b - 1)] if b > 1 else []
        a, b = b, a + b
    df = spark.createDataFrame(pairs, "n bigint, d bigint").withColumn("k", ranking.fraction_key("n", "d"))
    rows = df.orderBy("k").collect()
    values = [Fraction(r["n"], r["d"]) for r in rows]
    assert values == sorted(values)
    assert len({tuple(r["k"]) for r in rows}) == len(set(values))
    none = spark.createDataFrame([(1, 0), (None, 2), (1, None)], "n bigint, d bigint").select(ranking.fraction_key("n", "d").alias("k"))
    assert [r["k"] for r in none.collect()] == [None, None, None]
