"""Ranked lexical search: documents grouped by their mask of matched terms, best masks first.

The terms of all queries are found in every text once; each segment of
documents (a bounded number) keeps its postings as one stored row. From
counts over all segments come the term weights and the mean length.

In a segment every query's terms are bitmaps over the documents. Read
crosswise, they give each document the mask of the terms it holds; documents
with one mask form a group, and a group's score is at most the sum of the
highest contributions of its terms. Groups are scored in the order of that
bound until it falls below the k-th score that the task has found.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, sql_type, stored, utf8

TOP = 10
#: percent of a document's length that counts against it
LENGTH_PERCENT = 90
#: distinct terms, and queries, looked up in one pass over the documents; more take more passes
BLOCK_TERMS, BLOCK_QUERIES = 1 << 16, 4096
#: documents times terms of a segment, and documents of a segment, at most
SEGMENT_CELLS, SEGMENT_DOCS = 1 << 22, 4096
#: hands through which the best of all tasks pass on their way to one list a query
HANDS = 64

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms: runs of ASCII letters and digits and of all characters beyond ASCII, with only A-Z in lower case."""
    return _TERM.findall(text.translate(_LOWER))


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _queries(items: DataFrame, key: str, text: str) -> DataFrame:
    """(qid, key, terms): distinct terms of every row, numbered apart so that equal keys stay apart."""

    def run(batches):
        for batch in batches:
            found = [sorted(set(terms_of(t))) for t in utf8(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))],
                                             names=["qid", "key", "terms"])

    source = items.select(F.monotonically_increasing_id().alias("qid"), items[key].alias("key"), items[text].cast("string").alias("text"))
    return stored(source.mapInArrow(run, f"qid bigint, key {sql_type(items, key)}, terms array<binary>").where("size(terms) > 0"), "search-queries")


def _blocks(queries: DataFrame, most: int):
    """The queries in blocks of bounded terms and number (a longer query stands alone): one block at a time on the driver."""
    block, vocabulary = [], {}
    for row in queries.orderBy("qid").toLocalIterator():
        new = [t for t in row["terms"] if bytes(t) not in vocabulary]
        if block and (len(vocabulary) + len(new) > most or len(block) >= BLOCK_QUERIES):
            yield block, list(vocabulary)
            block, vocabulary = [], {}
        for t in row["terms"]:
            vocabulary.setdefault(bytes(t), len(vocabulary))
        block.append((row["qid"], np.array([vocabulary[bytes(t)] for t in row["terms"]], np.int64)))
    if block:
        yield block, list(vocabulary)


def segments(docs: DataFrame, key: str, text: str, vocabulary: list[bytes]) -> DataFrame:
    """Segments of documents with the postings of the given terms, stored.

    A row holds the keys of its documents, their numbers of words and the
    postings (term, document, occurrences), ordered by document.
    """
    shipped = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})
    most = max(1, min(SEGMENT_DOCS, SEGMENT_CELLS // max(1, len(vocabulary))))
    to_key = sql_type(docs, key)

    def run(batches):
        known = shipped.value
        names = known.keys()
        keys, words, term, doc, tf = [], [], [], [], []

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([words], pa.list_(pa.int64())), pa.ListArray.from_arrays([0, len(words)], pa.concat_arrays(keys)),
                 *[pa.array([x], pa.list_(pa.int32())) for x in (term, doc, tf)]], names=["words", "keys", "term", "doc", "tf"])

        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in slices([len(t) for t in texts]):
                for i in range(a, b):
                    counts = Counter(terms_of(texts[i]))
                    for t in counts.keys() & names:
                        term.append(known[t])
                        doc.append(len(words))
                        tf.append(counts[t])
                    keys.append(batch.column(0).slice(i, 1))
                    words.append(counts.total())
                    if len(words) >= most:
                        yield flush()
                        keys, words, term, doc, tf = [], [], [], [], []
        if words:
            yield flush()

    source = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    ddl = f"words array<bigint>, keys array<{to_key}>, term array<int>, doc array<int>, tf array<int>"
    return stored(source.mapInArrow(run, ddl), "search-segments")


def _statistics(found: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms in all, and documents that hold each known term (one number a term of the block)."""

    def run(batches):
        held, documents, total = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            for words, term in zip(batch.column(0), batch.column(1)):
                n = words.values.to_numpy()
                documents, total = documents + int((n > 0).sum()), total + int(n.sum())
                held += np.bincount(term.values.to_numpy(), minlength=n_terms)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(held[at], [documents, total]))], names=["term", "n"])

    rows = found.select("words", "term").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    held = np.zeros(n_terms, np.int64)
    numbers = {r["term"]: r["n"] for r in rows}
    for t, n in numbers.items():
        if t >= 0:
            held[t] = n
    return numbers.get(-1, 0), numbers.get(-2, 0), held


def contributions(tf: np.ndarray, words: np.ndarray, documents: int, total: int, percent: int = LENGTH_PERCENT) -> np.ndarray:
    """What an occurrence count is worth before its term's weight; 64-bit integers, divisions round down."""
    m = 100 - percent + (percent * words * documents) // max(1, total)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Best:
    """The k best (score, row) of one query within a task; ``bar`` is the k-th score once there are k."""

    def __init__(self, k: int):
        self.k, self.scores, self.rows = k, np.zeros(0, np.int64), []

    @property
    def bar(self) -> int:
        return int(self.scores[-1]) if len(self.scores) >= self.k else 0

    def add(self, scores: np.ndarray, rows: list) -> None:
        """Merge rows (key order values first); of equal scores the smaller key stays."""
        scores = np.concatenate([self.scores, scores])
        rows = self.rows + rows
        order = sorted(range(len(rows)), key=lambda i: (-int(scores[i]), rows[i]))[:self.k]
        self.scores, self.rows = scores[order], [rows[i] for i in order]


def search_segment(best: Best, terms: np.ndarray, weights: np.ndarray, present: np.ndarray, value: np.ndarray, highest: np.ndarray, keys: list) -> int:
    """Add one segment's best documents for one query; returns how many groups were scored.

    ``present`` holds a bitmap over the documents per term, ``value`` the
    contributions (terms x documents), ``highest`` the largest of each term.
    """
    w = weights[terms]
    here = (highest[terms] > 0) & (w > 0)
    terms, w = terms[here], w[here]
    # no document can beat the bar, not even one with every term at its highest
    if not len(terms) or int((w * highest[terms]).sum()) < max(1, best.bar):
        return 0
    bits = np.unpackbits(present[terms], axis=1, count=len(keys))
    masks = np.ascontiguousarray(np.packbits(bits, axis=0).T)  # a row per document: the mask of its terms
    kinds, group = np.unique(masks.view(f"V{masks.shape[1]}").ravel(), return_inverse=True)
    held = np.unpackbits(kinds.view(np.uint8).reshape(len(kinds), -1), axis=1, count=len(terms)).astype(np.int64)
    bound = held @ (w * highest[terms])
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] > 0]
    members = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[members], np.arange(len(kinds) + 1))
    done, step = 0, 4
    while done < len(order):
        some = order[done:done + step]
        some = some[bound[some] >= max(1, best.bar)]  # an equal bound may win by its key
        if not len(some):
            break
        docs = np.concatenate([members[starts[k]:starts[k + 1]] for k in some])
        scores = w @ value[np.ix_(terms, docs)].astype(np.int64)
        good = np.flatnonzero((scores > 0) & (scores >= best.bar))
        if len(good) > best.k:  # rows below the k-th of these cannot stay
            good = good[scores[good] >= np.partition(scores[good], -best.k)[-best.k]]
        best.add(scores[good], [keys[d] for d in docs[good]])
        done, step = done + len(some), step * 2
    return done


def _ranked(found: DataFrame, block: list, weights: np.ndarray, documents: int, total: int, k: int, percent: int) -> DataFrame:
    """(qid, key, score): the k best of every task for every query of the block."""
    shipped = found.sparkSession.sparkContext.broadcast((block, weights))
    key_type = found.schema["keys"].dataType.elementType.simpleString()
    n_terms = len(weights)

    def run(batches):
        queries, w = shipped.value
        best = [Best(k) for _ in queries]
        arrow_key = None
        for batch in batches:
            for words, keys, term, doc, tf in zip(*batch.columns):
                arrow_key = keys.values.type
                n, t, d = words.values.to_numpy(), term.values.to_numpy(), doc.values.to_numpy()
                # keys in their order, nulls last; rows with one key are alike
                rows = [(x is None, x) if x is not None else (True, 0) for x in keys.values.to_pylist()]
                worth = contributions(tf.values.to_numpy().astype(np.int64), n[d], documents, total, percent)
                value = np.zeros((n_terms, len(n)), np.int32)  # below a million by the formula
                value[t, d] = worth
                present = np.packbits(value > 0, axis=1)
                highest = value.max(axis=1).astype(np.int64) if len(n) else np.zeros(n_terms, np.int64)
                for b, (_, terms) in zip(best, queries):
                    search_segment(b, terms, w, present, value, highest, rows)
        for b, (qid, _) in zip(best, queries):
            if b.rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([qid] * len(b.rows), pa.int64()), pa.array([None if x[0] else x[1] for x in b.rows], arrow_key),
                     pa.array(b.scores, pa.int64())], names=["qid", "key", "score"])

    return found.select("words", "keys", "term", "doc", "tf").mapInArrow(run, f"qid bigint, key {key_type}, score bigint")


def ranked(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
           k: int = TOP, percent: int = LENGTH_PERCENT, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``k`` best documents of every item: item key, rank (from 1), document key and score.

    Only scores above 0 count; equal scores come by ascending document key,
    null keys last. Rows with equal keys are documents of their own, items
    with equal keys are searched apart. Null and empty texts have no terms: such a
    document is never found, such an item finds nothing. Empty tables give
    an empty result. Other columns are not read.

    Items are taken in blocks of ``block_terms`` distinct terms (the driver and
    every task hold one block), each block one pass over all texts. A text is one
    list of its terms in a task. The results of the tasks, ``k`` rows an item
    each, are merged in two steps, so that no task reads those of all tasks.
    """
    out = None
    queries = _queries(items, item_key, item_text)
    for block, vocabulary in _blocks(queries, block_terms):
        found = segments(docs, key, text, vocabulary)
        documents, total, held = _statistics(found, len(vocabulary))
        weights = np.array([term_weight(documents, int(n)) for n in held], np.int64)
        part = stored(_ranked(found, block, weights, documents, total, k, percent).withColumn("hand", F.spark_partition_id() % HANDS), "search-tasks")
        out = part if out is None else out.unionByName(part)
    order = [F.col("score").desc(), F.col("key").asc_nulls_last()]
    if out is None:
        out = docs.limit(0).select(F.lit(0).cast("long").alias("qid"), docs[key].alias("key"), F.lit(0).cast("long").alias("score"), F.lit(0).alias("hand"))
    first = out.withColumn("place", F.row_number().over(Window.partitionBy("qid", "hand").orderBy(*order))).where(F.col("place") <= k)
    last = first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("place") <= k)
    return last.join(queries.select("qid", F.col("key").alias("item")), "qid").select(
        F.col("item").alias(item_key), F.col("place").alias("rank"), F.col("key").alias(key), "score")
