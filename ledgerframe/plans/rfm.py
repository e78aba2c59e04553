"""Recency / frequency / monetary scoring of categories.

Per category (groups with more than ``min_rows`` rows and a known last
date): recency = days from the last date to ``as_of``; frequency = rows;
monetary = sum of debit-or-0 plus credit-or-0; flagged %. Each axis is
cut into ``buckets`` quantile groups with NTILE, where score 1 is the
best on that axis (most recent, most frequent, largest). The cell is the
three digits concatenated, the total their sum, and the segment label is
read from the total exactly as the original report does: the highest
totals get the first label. That inverts the meaning of the labels
relative to the scores; it is kept on purpose (``invert_scores=True``
scores 5 as the best instead, so labels and scores agree).

Ties on an axis are broken by category so the cut is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.operators.rollup import Measures

from ledgerframe.functions import calendar as cal
from ledgerframe.functions import labels as L
from ledgerframe.functions.exact import as_count, money, percent
from ledgerframe.operators.bands import above_band, between_band
from ledgerframe.operators.grouped import FLAG
from ledgerframe.operators.ranking import ntile
from ledgerframe.operators.window import top_k
from ledgerframe.plans.reports import _as_of
from ledgerframe.session import staged


def rfm(t: DataFrame, as_of=None, buckets: int = 5, min_rows: int = 5, n: int | None = 50,
        invert_scores: bool = False) -> DataFrame:
    m = Measures(t)
    g = t.groupBy(F.col("description").alias("category")).agg(
        F.max("transaction_date").alias("__last"),
        m.rows().alias("frequency"),
        m.volume().alias("__monetary"),
        m.sum(FLAG).alias("__fs"),
        m.count(FLAG).alias("__fn"),
    ).where(F.col("frequency") > min_rows)
    g = g.select(
        "category",
        cal.days_between(_as_of(as_of), F.col("__last")).alias("recency"),
        as_count("frequency").alias("frequency"),
        money("__monetary").alias("monetary"),
        percent("__fs", "__fn").alias("suspicious_percentage"),
    ).where(F.col("recency").isNotNull())

    g = staged(g, "rfm")  # ranked three times
    tb = F.col("category").asc_nulls_last()
    axes = [
        ("r_score", F.col("recency").asc_nulls_last(), F.col("recency").desc_nulls_first()),
        ("f_score", F.col("frequency").desc_nulls_first(), F.col("frequency").asc_nulls_last()),
        ("m_score", F.col("monetary").desc_nulls_first(), F.col("monetary").asc_nulls_last()),
    ]
    for name, best_first, worst_first in axes:
        order = worst_first if invert_scores else best_first
        g = ntile(g, buckets, order, tb, name)

    total = F.col("r_score") + F.col("f_score") + F.col("m_score")
    out = g.select(
        "category",
        F.col("recency").alias("days_since_last"),
        F.col("frequency").alias("transaction_count"),
        F.col("monetary").alias("total_amount"),
        "suspicious_percentage",
        "r_score",
        "f_score",
        "m_score",
        F.concat(F.col("r_score").cast("string"), F.col("f_score").cast("string"),
                 F.col("m_score").cast("string")).alias("rfm_cell"),
        between_band(total, L.RFM_SEGMENTS, L.RFM_SEGMENT_ELSE).alias("category_segment"),
        above_band("suspicious_percentage", L.RFM_RISK, L.RFM_RISK_ELSE).alias("risk_segment"),
        total.alias("__total"),
    )
    order = [F.col("__total").desc_nulls_first(), F.col("total_amount").desc_nulls_first(),
             F.col("category").asc_nulls_last()]
    out = top_k(out, order, n) if n else out.orderBy(*order)
    return out.drop("__total")
