"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Every round each node takes the smallest label around it and then the
    label of that label, so chains shorten by halves; labels are written
    to the shared folder between rounds and nothing is gathered.
    """
    both = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
                  .unionAll(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges")
    labels = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        around = (both.join(labels.select(F.col("u").alias("v"), F.col("label").alias("near")), "v")
                  .groupBy("u").agg(F.min("near").alias("near")))
        lower = labels.join(around, "u").select("u", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("u").alias("next"), F.col("label").alias("over"))
        after = stored(lower.join(jump, "next")
                       .select("u", F.col("over").alias("label"), (F.col("over") != F.col("label")).alias("moved")), "labels")
        labels = after.select("u", "label")
        if after.where("moved").isEmpty():
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
