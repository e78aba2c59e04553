"""op11 against brute force: scores, ties, masks and bounds."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerframe.llm import search
from ledgerframe.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_definition(docs, items, k=10):
    """(item, rank, doc, score) of (key, text) rows, by the formulas as stated."""
    words = [terms(t) for _, t in docs]
    n_docs, total = sum(1 for w in words if w), sum(map(len, words))
    holding, counts = Counter(t for w in words for t in set(w)), [Counter(w) for w in words]
    out = []
    for item, text in items:
        found = []
        for (key, _), w, count in zip(docs, words, counts):
            score = 0
            for t in set(terms(text)):
                df, tf = holding[t], count[t]
                if tf:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    m = 100 - 90 + (90 * len(w) * n_docs) // total
                    score += weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out += [(item, r + 1, key, -s) for r, (s, _, _, key) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.mark.parametrize("seed, segment, block", [(1, 4096, 1 << 16), (2, 7, 1 << 16), (3, 16, 9)])
def test_rows_match_the_definition(spark, docs, monkeypatch, seed, segment, block):
    monkeypatch.setattr(search, "SEGMENT_DOCS", segment)
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "été", "a1", "ÀB", "İ", "ß"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    word = lambda: r.choice([str.upper, str.lower, str])(r.choices(vocabulary, weights)[0])
    texts = [r.choice([" ", "-", ", ", "\n", "\x00", "_"]).join(word() for _ in range(r.choice([0, 1, 3, 8, 40, 300]))) for _ in range(220)]
    texts += [None, "", " .,!", "w1 " * 30_000, *["w3 w9 same"] * 25]
    ids = [None, 5, 5, 5, *range(3, len(texts) - 1)]
    items = [(i, " ".join(word() for _ in range(r.randrange(1, 14)))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "nowhere"), (None, "same W3"), (23, "w1 w1 w1"), (23, "w2"), (24, " ".join(vocabulary) + " x" * 5)]
    got = search.ranked(docs(texts, ids=ids, extra=True), items_of(spark, items), block_terms=block)
    assert sorted(map(tuple, got.collect()), key=str) == by_definition(list(zip(ids, texts)), items)


def test_empty_tables(spark, docs):
    some, none = items_of(spark, [(1, "a b")]), items_of(spark, [])
    assert search.ranked(docs([]), some).count() == search.ranked(docs(["a b"]), none).count() == 0
    assert search.ranked(docs(["", None]), some).columns == ["item_id", "rank", "doc_id", "score"]
    assert search.ranked(docs(["", None]), some).count() == 0


def test_groups_below_the_bar_are_not_scored():
    r = np.random.default_rng(4)
    n_terms, n_docs = 30, 3000
    value = np.where(r.random((n_terms, n_docs)) < 0.2, r.integers(1, 1000, (n_terms, n_docs)), 0).astype(np.int32)
    weights = r.integers(0, 5000, n_terms)
    keys = [(False, int(x)) for x in r.permutation(n_docs)]
    present, highest = np.packbits(value > 0, axis=1), value.max(axis=1).astype(np.int64)
    for k, terms_ in [(10, np.arange(n_terms)), (3, np.array([2, 5, 9])), (1, np.array([7])), (4000, np.arange(12))]:
        best = search.Best(k)
        scored = search.search_segment(best, terms_, weights, present, value, highest, keys)
        scores = weights[terms_] @ value[terms_].astype(np.int64)
        want = sorted((-int(s), key) for s, key in zip(scores, keys) if s > 0)[:k]
        assert list(zip((-best.scores).tolist(), best.rows)) == want
        masks = len({tuple(c) for c in (value[terms_] > 0).T.tolist()})
        assert scored <= masks and (k != 10 or scored < masks)


def test_query_returns_ten_for_every_item(spark):
    rows = QUERIES["op11_ranked_search"](spark, "/root/testdata/sf0.001").collect()
    read = lambda t, key: [(x[key], x["text"]) for x in spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").collect()]
    assert sorted(map(tuple, rows), key=str) == by_definition(read("documents", "doc_id"), read("benchmark", "item_id")[:40])
