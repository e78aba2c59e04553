from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])  # for Python workers


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Build a documents table; ids may repeat or be null."""

    def make(texts, ids=None, sources=None, extra=False):
        ids = list(range(len(texts))) if ids is None else ids
        sources = ["s"] * len(texts) if sources is None else sources
        rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources)]
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        if extra:  # columns that clash with names the operators use
            from pyspark.sql import functions as F

            for name in ("key", "th", "n", "rank", "score", "text_", "component", "size", "__gone", "c0", "label", "__size", "__rate", "__source",
                         "__copies", "__kept", "__removed", "__th", "__best", "__n", "__key", "__of", "__copy", "place", "part", "own", "rate"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make

