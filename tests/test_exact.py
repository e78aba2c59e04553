"""Exact rounding helper vs Python's decimal arithmetic (half away from zero)."""

from __future__ import annotations

import random
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerframe.functions.exact import div_round


def _expected(num: Decimal, den: Decimal, k: int):
    if den == 0:
        return None
    with localcontext() as ctx:
        ctx.prec = 80
        return (num / den).quantize(Decimal(1).scaleb(-k), rounding=ROUND_HALF_UP)


def _cases(seed=7, n=3000):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        den = rnd.choice([rnd.randint(1, 9), rnd.randint(1, 10**6), rnd.randint(1, 10**12)])
        num_cents = rnd.randint(-10**15, 10**15)
        out.append((Decimal(num_cents).scaleb(-2), den))
    # exact halves and near-halves
    out += [(Decimal("0.05"), 10), (Decimal("-0.05"), 10), (Decimal("0.15"), 2),
            (Decimal("1.00"), 8), (Decimal("-1.00"), 8), (Decimal("0.00"), 3),
            (Decimal("12345678901234.56"), 1), (Decimal("-0.01"), 2), (Decimal("0.01"), 2)]
    return out


@pytest.mark.parametrize("k", [0, 2, 4, 16])
def test_div_round_matches_decimal(spark, k):
    cases = _cases(seed=k)
    schema = T.StructType([T.StructField("s", T.DecimalType(25, 2)),
                           T.StructField("n", T.LongType())])
    df = spark.createDataFrame(cases, schema)
    got = df.select("s", "n", div_round(F.col("s"), F.col("n"), k, num_scale=2).alias("r")).collect()
    for row in got:
        exp = _expected(row.s, Decimal(row.n), k)
        assert row.r == exp, (row.s, row.n, row.r, exp)


def test_zero_denominator_null_or_error(spark):
    df = spark.createDataFrame([(5, 0)], "a long, b long")
    assert df.select(div_round(F.col("a"), F.col("b"), 2).alias("r")).first().r is None
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|divide by zero|Division by zero"):
        df.select(div_round(F.col("a"), F.col("b"), 2, zero_is_null=False).alias("r")).collect()


def test_null_propagates(spark):
    df = spark.createDataFrame([(None, 3), (3, None)], "a long, b long")
    assert [r.r for r in df.select(div_round("a", "b", 2).alias("r")).collect()] == [None, None]


def test_scale_of_decimal_denominator(spark):
    # ratio of two money amounts: 10.00 / 3.00 = 3.33; -2.50 / 0.40 = -6.25
    df = spark.createDataFrame([(Decimal("10.00"), Decimal("3.00")),
                                (Decimal("-2.50"), Decimal("0.40"))], "a decimal(15,2), b decimal(15,2)")
    r = [x.r for x in df.select(div_round("a", "b", 2, 2, 2).alias("r")).collect()]
    assert r == [Decimal("3.33"), Decimal("-6.25")]
