"""SparkSession helpers.

The library never needs a particular session to be correct: every
operator states its NULL order, decimal scale and time handling
explicitly. ``build_session`` only sets the knobs that make large runs
behave (AQE, skew splitting, UTC) and is what tests and the bench use.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(
    master: str | None = None,
    app_name: str = "ledgerframe",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # PySpark otherwise records the Python call site of every column
        # function through several JVM calls; plans build much faster without
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # remove checkpoint files once the checkpointed frame is unreachable
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    # Shuffle width: explicit, or 8 for a local run. On a cluster the
    # configured value is kept (size it so post-aggregation partitions are
    # ~128-256 MB; adaptive execution coalesces small ones).
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    elif master and master.startswith("local"):
        conf["spark.sql.shuffle.partitions"] = "8"
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


LOCAL_CHECKPOINT_ROOT = "/tmp/ledgerframe-checkpoints"


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder the cluster names.

    The cluster setting ``spark.checkpoint.dir`` wins. Only when it is
    unset is a fallback installed: ``fallback`` if given, else (local
    mode only, as in tests) a folder under /tmp. On a cluster with no
    checkpoint folder configured this raises instead of writing to a
    machine-local path.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if fallback is None:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; configure a shared folder for the cluster")
        fallback = LOCAL_CHECKPOINT_ROOT
    if "://" not in fallback:
        os.makedirs(fallback, exist_ok=True)
    sc.setCheckpointDir(fallback)
    return fallback


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends, columns stay prunable."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
