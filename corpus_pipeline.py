"""Corpus pipeline: toxicity, line dedup, near duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
hands each stage the result of the one before, written as Parquet in the
shared folder and read back. The last writes its table itself, so that its
tasks get few texts at a time. All stages but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.llm import bpe, jaccard, lines, mixing, toxicity
from ledgerframe.llm.common import TEXT_ROWS, fresh, small_batches, stored, table
from ledgerframe.llm.queries import tokenizer_path

#: near copies of the corpus: shingles of five words, similarity of 0.8 or more (op8 on its own keeps its contract)
WIDTH, PERCENT = 5, 80


def _with_text(docs: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """``found`` with its text replaced and ``n_chars``, where ``docs`` has it, counted anew."""
    new = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return found.withColumns(new).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject (predicted 0); a null text is kept.

    The model learns from all rows of ``labels``. The decision is made in
    the pass that scores the text, and the row goes on with its columns.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, "text", model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated line runs; those left without words go."""
    kept, removed = fresh(docs, "kept"), fresh(docs, "removed")
    found = lines.without_copies(docs, out=(kept, removed))
    emptied = (F.col(removed) > 0) & (F.col(kept) == "")
    return _with_text(docs, found.where(~emptied), kept)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each component of linked documents."""
    return jaccard.representatives(docs, width=WIDTH, percent=PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of the text decoded from them."""
    with small_batches(spark, TEXT_ROWS):
        return stored(bpe.digests(docs, ["doc_id", "source"], "text", tokenizer_path()), "pipeline-bpe")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: stages that return a table they have written (digests only: texts written twice would take 0.9 GB of disk on 0.51 GB)
WRITTEN = {"bpe"}

#: no SQL: the toxicity model and the tokenizer cannot be written in it. Tests hold the operators behind stages 2 to 4 to
#: brute force, the tokens to a library and the toxicity model to labels held out; the stages in a row only to types and counts
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name not in WRITTEN:
            docs = stored(docs, f"pipeline-{name}")
    return docs
