"""The registered queries: each operator over its whole table, reduced to the columns asked for."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, extraction, fingerprints, jaccard, licenses, lines, middle, mixing, quality, search, substrings, toxicity, warc
from .common import shared_dir, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.without_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("__removed").alias("n_removed_lines"),
                        F.length("__kept").cast("long").alias("n_kept_chars"),
                        F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"), ["doc_id"], "text").drop("spans")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(table(spark, sf_dir, "documents"), "doc_id", "text")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), ["doc_id"], "text", tokenizer_path())


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
                        F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_components(table(spark, sf_dir, "documents"))


def _train_fold(labels: DataFrame) -> DataFrame:
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _train_fold(table(spark, sf_dir, "labels")))
    found = toxicity.scored(docs, ["doc_id"], "text", model)
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", "predicted")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, ["doc_id"], "text", quality.train(docs, table(spark, sf_dir, "labels")))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, warc.summary)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = middle.transformed(table(spark, sf_dir, "documents"), ["doc_id"])
    back = middle.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                        F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_fingerprints": op4_fingerprints,
    "op5_bpe": op5_bpe,
    "op6_html_extraction": op6_html_extraction,
    "op7_mixing": op7_mixing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_ranked_search": op11_ranked_search,
    "op12_warc": op12_warc,
    "op13_fill_in_middle": op13_fill_in_middle,
    "pipeline": pipeline,
}


def oracle_sql() -> dict[str, str]:
    from .oracle import ORACLE

    return dict(ORACLE)
