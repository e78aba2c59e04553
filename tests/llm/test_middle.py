"""op13 against brute force: skip list, cuts, forms and exact restoration."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerframe.llm import middle
from ledgerframe.llm.queries import QUERIES

TEXTS = [None, "", "\n", "a", "a\n", "\n\na", "é\n日本\n\U0001f600x", "has <P> mark\nline", "x <S>", "<M>", "< P>\n<P\n>", "one\r\ntwo three\x0bfour\n",
         "long " * 40_000 + "\n" + "é" * 50_000, "\n".join(f"line {i} ü" for i in range(3000)), "same\ntext\n", "same\ntext\n"]


def by_definition(key, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=700), st.data())
def test_skip_list_reaches_every_rank(chars, data):
    widths = np.array([[1, c, 2 * c] for c in chars], np.int64).reshape(-1, 3)
    units = middle.SkipList(widths)
    for rank in {0, len(chars), data.draw(st.integers(0, len(chars)))}:
        assert units.reach(rank) == (rank, sum(chars[:rank]), 2 * sum(chars[:rank]))
    assert all(len(up) == -(-len(low) // middle.FAN) for low, up in zip(units.lanes, units.lanes[1:]))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab\n\r é日\U0001f600<PSM>", max_size=60))
def test_units_are_those_of_the_pattern(text):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    assert middle.unit_widths(text.encode()).tolist() == [[1, len(x), len(x.encode())] for x in lines]
    assert middle.unit_widths(text.encode(), "char").tolist() == [[1, 1, len(x.encode())] for x in text]


@pytest.mark.parametrize("rate, spm", [(100, 50), (60, 20)])
def test_rows_match_the_definition(spark, docs, rate, spm):
    from pyspark.sql import functions as F

    r = random.Random(5)
    texts = TEXTS + ["".join(r.choices("ab\né<P>", k=r.randrange(40))) for _ in range(300)]
    ids = [None, 7, 7, *range(3, len(texts))]
    table = docs(texts, ids=ids, extra=True).withColumn("n", F.lit("x")).withColumn("output", F.lit("x")).withColumn("k0", F.lit("x"))
    got = middle.transformed(table, ["doc_id"], rate=rate, spm_rate=spm)
    rows = got.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((i, *by_definition(i, t, rate=rate, spm=spm), t or "") for i, t in zip(ids, texts)), key=str)
    assert sorted((tuple(x) for x in rows), key=str) == want
    assert {x["form"] for x in rows} == {"plain", "psm", "spm"}


def test_empty_table_units_and_marks(docs):
    assert middle.transformed(docs([]), ["doc_id"]).count() == 0
    rows = middle.transformed(docs(["añb\nc"] * 40), ["doc_id", "lang"], unit="char").collect()
    assert {x["n"] for x in rows} == {5} and len({x["prefix_chars"] for x in rows}) > 3
    for bad in [("<A>", "<A>", "<B>"), ("<A>", "x<A>", "<B>"), ("ab", "bc", "cd"), ("", "a", "b")]:
        with pytest.raises(ValueError):
            middle.transformed(docs(["a"]), ["doc_id"], marks=bad)
    with pytest.raises(ValueError):
        middle.transformed(docs(["a"]), ["n_chars", "doc_id"], unit="word")


def test_query_restores_every_text(spark):
    rows = QUERIES["op13_fill_in_middle"](spark, "/root/testdata/sf0.001").collect()
    texts = {x["doc_id"]: x["text"] or "" for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for x in rows:
        n, form, p, m, out = by_definition(x["doc_id"], texts[x["doc_id"]])
        assert (x["n"], x["form"], x["prefix_chars"], x["middle_chars"]) == (n, form, p, m)
        assert x["output_sha256"] == hashlib.sha256(out.encode()).hexdigest()
        assert x["restored_sha256"] == hashlib.sha256(texts[x["doc_id"]].encode()).hexdigest()
