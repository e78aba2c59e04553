"""Manifest of stored marts: which mart was built from which fact, and where it lies.

A mart is stored once per fact (its plan, its files, their lengths and
modification times), clock values and code that builds it. The manifest is
a Parquet folder in the shared folder to which every finished build adds one
row; a build that fails adds none, so a reader never meets half a mart. A
row whose folder has been cleaned away counts for nothing.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import inspect
import json
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerframe.session import checkpoint_dir

_ROWS = "mart string, key string, location string, schema string, built_at timestamp_ntz"
#: input files whose lengths and times are listed one by one; beyond, Spark combines them to one digest
LISTED_FILES = 1000


def root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/ledgerframe-marts"


@cache
def _code() -> str:
    """Digest of the modules that build marts: other code, other marts."""
    from ledgerframe.functions import calendar, exact, labels
    from ledgerframe.operators import bands, grouped, rollup, window
    from ledgerframe.plans import marts
    from ledgerframe.sources import tables

    text = "".join(inspect.getsource(m) for m in (calendar, exact, labels, bands, grouped, rollup, window, marts, tables))
    return hashlib.sha1(text.encode()).hexdigest()


def fact_state(t: DataFrame) -> str | None:
    """What tells one state of a fact from another: its plan and its files; None if it is not read from files."""
    files = t.inputFiles()
    if not files:
        return None
    listed = t.sparkSession.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
    if len(files) <= LISTED_FILES:
        state = sorted(map(str, listed.collect()))
    else:
        state = list(listed.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64(*listed.columns))).first())
    return hashlib.sha1(repr((t.semanticHash(), t.schema.json(), state)).encode()).hexdigest()


def key_of(t: DataFrame, mart: str, **clock) -> str | None:
    """The key under which a mart of this fact is known; None if it cannot be known again."""
    state = fact_state(t)
    return state and hashlib.sha1(json.dumps([mart, state, _code(), sorted((k, str(v)) for k, v in clock.items())]).encode()).hexdigest()


def _open(spark: SparkSession, location: str, schema: str) -> DataFrame | None:
    declared = StructType.fromJson(json.loads(schema))
    try:
        return spark.read.schema(declared).parquet(location).select(*declared.names)
    except AnalysisException as gone:
        if "PATH_NOT_FOUND" in (gone.getCondition() or ""):
            return None
        raise


_KNOWN: dict[tuple[str, str, str], tuple[str, str]] = {}


def find(spark: SparkSession, where: str, mart: str, key: str | None = None) -> DataFrame | None:
    """The mart last entered in the manifest of the folder ``where``; with ``key`` the last under that key."""
    known = _KNOWN.get((where, mart, key)) if key else None
    found = known and _open(spark, *known)
    if found is not None:
        return found
    wanted = F.col("mart") == mart
    try:
        row = (spark.read.schema(_ROWS).parquet(f"{where}/manifest").where(wanted & (F.col("key") == key) if key else wanted)
               .orderBy(F.col("built_at").desc()).first())
    except AnalysisException as gone:
        if "PATH_NOT_FOUND" not in (gone.getCondition() or ""):
            raise
        row = None
    found = _open(spark, row["location"], row["schema"]) if row else None
    if found is not None and key:
        _KNOWN[where, mart, key] = (row["location"], row["schema"])
    return found


def store(spark: SparkSession, where: str, mart: str, key: str | None, df: DataFrame,
          write: Callable[[DataFrame, str], None]) -> DataFrame:
    """Write a mart with ``write(df, folder)`` to a new folder under ``where``, then enter it; returns the stored mart."""
    location, schema = f"{where}/{mart}-{uuid.uuid4().hex}", df.schema.json()
    write(df, location)
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    spark.createDataFrame([(mart, key or "", location, schema, now)], _ROWS).coalesce(1).write.mode("append").parquet(f"{where}/manifest")
    if key:
        _KNOWN[where, mart, key] = (location, schema)
    return _open(spark, location, schema)
