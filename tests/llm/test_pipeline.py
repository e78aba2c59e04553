"""The corpus pipeline's stages against brute force on small tables."""

from __future__ import annotations

import corpus_pipeline
import pytest

from ledgerframe.llm import common, jaccard, toxicity


def block_replaced(n, block):
    """A text of n words and a copy with ``block`` words in its middle replaced."""
    words = [f"w{i}" for i in range(n)]
    edited = words[:n // 2] + [f"x{i}" for i in range(block)] + words[n // 2 + block:]
    return " ".join(words), " ".join(edited)


def similarity(a, b, width=5):
    x, y = ({tuple(t.split()[i:i + width]) for i in range(len(t.split()) - width + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_from_four_fifths_on_go(spark, docs):
    near, far = block_replaced(200, 15), block_replaced(150, 15)
    far = tuple(t.replace("w", "v").replace("x", "y") for t in far)
    assert 0.81 < similarity(*near) < 0.83 and similarity(*far) < 0.8
    kept = corpus_pipeline.drop_near_copies(spark, docs([*near, *far]), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 2, 3]


SF = "/root/testdata/sf0.001"


def test_stages_take_null_and_empty_texts_and_columns_of_any_name(spark, docs):
    body = " ".join(f"w{i}" for i in range(60))
    table = docs([None, "", " \n ", body, body, "short text"], ids=[None, 1, 2, 3, 4, 4], extra=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, table, SF)
        assert after.columns == table.columns, name
        rows = after.collect()
        assert all(r["__kept"] == r["__th"] == r["__size"] == "x" for r in rows), name
        ids = sorted((r["doc_id"] or -1, r["text"] or "") for r in rows)
        if name == "toxicity":
            assert len(ids) == 6
        if name == "line_dedup":  # the later copy of the run is left without words and goes
            assert ids == [(-1, ""), (1, ""), (2, " \n "), (3, body), (4, "short text")]
        if name == "ngram_jaccard_join":
            assert ids == [(-1, ""), (1, ""), (2, " \n "), (3, body), (4, "short text")]
    last = corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()
    assert sorted(r["n_tokens"] for r in last)[:2] == [0, 0] and len(last) == 6


def test_stages_take_an_empty_table(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs([]), SF).count() == 0, name


ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_texts_and_sets_reach_python_in_small_batches(spark, docs, monkeypatch):
    before, seen, plain = spark.conf.get(ARROW), {}, common.stored

    def noted(df, name):
        seen[name] = int(spark.conf.get(ARROW))
        return plain(df, name)

    for module in (corpus_pipeline, jaccard, toxicity):
        monkeypatch.setattr(module, "stored", noted)
    table = docs([*block_replaced(200, 15), None])
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, table, SF).collect()
    for name in ("toxic-tokens", "jaccard-rows", "jaccard-sets", "pipeline-bpe"):
        assert seen[name] <= common.TEXT_ROWS, name
    assert seen["jaccard-star"] <= common.PAIR_ROWS and seen["jaccard-links"] <= common.PAIR_ROWS
    assert spark.conf.get(ARROW) == before


@pytest.mark.parametrize("before, within", [("10000", "7"), ("3", "3"), ("0", "7")])
def test_small_batches_return_what_was_set(spark, before, within):
    usual = spark.conf.get(ARROW)
    spark.conf.set(ARROW, before)
    try:
        with pytest.raises(ValueError), common.small_batches(spark, 7):
            assert spark.conf.get(ARROW) == within
            raise ValueError
        assert spark.conf.get(ARROW) == before
    finally:
        spark.conf.set(ARROW, usual)


def test_a_worker_keeps_one_operator_at_a_time():
    first = common.kept("a", dict)
    assert common.kept("a", dict) is first
    common.kept("b", dict)
    assert list(common._KEPT) == ["b"]
    common.released()
    assert not common._KEPT


def test_judged_texts_are_sent_once(docs, monkeypatch):
    given, table = [], docs(["a b", None])
    monkeypatch.setattr(toxicity, "filter_texts", lambda df, columns, make: given.append(columns) or df)
    toxicity.accepted(table, "text", toxicity.Model())
    assert given == [[table.columns.index("text")]]


def test_texts_are_judged_a_slice_at_a_time(docs):
    table = docs([f"{i} " + "x" * 300_000 for i in range(20)]).coalesce(1)

    def even(columns):
        if len(columns[0]) > 5:
            raise ValueError("more than a slice")
        return [i % 2 == 0 for i in columns[1].to_pylist()]

    kept = common.filter_texts(table, [1, table["doc_id"] + 0], lambda: even)
    assert kept.columns == table.columns
    assert sorted((r["doc_id"], len(r["text"])) for r in kept.collect()) == [(i, len(f"{i} ") + 300_000) for i in range(0, 20, 2)]
