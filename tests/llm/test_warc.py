"""op12 against brute force: archives written by Spark, cut at any split, read back whole."""

from __future__ import annotations

import hashlib
import random
import uuid

import numpy as np
import pytest

from ledgerframe.llm import warc
from ledgerframe.llm.common import shared_dir
from ledgerframe.llm.queries import QUERIES

MAGIC = b"WARC/1.1\r\n"


def folder(spark):
    return f"{shared_dir(spark)}/test-warc-{uuid.uuid4().hex}"


def plain_parse(data):
    """Records of one file by following lengths from its start."""
    out, at = [], 0
    while at < len(data):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        assert head.startswith(MAGIC)
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        start = at + len(head) + 4
        block = data[start:start + int(fields[b"Content-Length"])]
        assert data[start + len(block):][:4] == b"\r\n\r\n"
        out.append((at, fields, block))
        at = start + len(block) + 4
    return out


def raw_files(spark, path):
    return [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect()]


def tricky(r):
    """Payloads with magic lines, whole quoted records and records that announce lengths of their own."""
    quoted = lambda n, k: f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {n}\r\n\r\n{'q' * k}\r\n\r\n"
    parts = [MAGIC.decode(), "WARC/1.1", "\r\n\r\n", "WA", "é日", "<p>x</p>", "y" * 300, quoted(9, 9), quoted(50_000, 3), quoted(0, 0),
             "Content-Length: 3\r\n", "WARC/1.1\r\nContent-Length: 99999999999999999999\r\n\r\n"]
    return "".join(r.choices(parts, k=r.randrange(25)))


def pages_of(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    from pyspark.sql import functions as F

    for name in ("key", "digest", "size", "best", "kind", "value", "hit", "body"):  # names the operator uses itself
        df = df.withColumn(name, F.lit("x"))
    return df


def expected(rows):
    groups = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    out = []
    for body, ids in groups.items():
        data = body.encode()
        ids = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        for n, i in enumerate(ids):
            revisit = len(data) >= 1000 and n > 0
            out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", ids[0] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [5_000, 128 << 20])
def test_written_and_read_back_at_any_split(spark, split):
    r = random.Random(split)
    long = "z" * 1500
    rows = [(i, f"http://h/{i}\r\nX: y", tricky(r)) for i in range(150)]
    rows += [(200 + i, None, long) for i in range(90)] + [(None, "u", long), (None, "u", None), (None, None, "n" * 1000)]
    rows += [(500 + i % 3, "u", "w" * 1000 + MAGIC.decode()) for i in range(9)] + [(600, "u", "tiny"), (600, "u", "tiny"), (601, "u", "tiny")]
    rows += [(700, "u", None), (701, "u", ""), (-5, "u", "é" * 500), (-6, "u", "é" * 500), (800, "u", (MAGIC.decode() + "v" * 90) * 400)]
    path = folder(spark)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        warc.write(pages_of(spark, rows), path)
        found = warc.read(spark, path, warc.summary).collect()
        records = warc.opened(spark, path).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((tuple(x) for x in found), key=str) == expected(rows)
    parsed = [x for data in raw_files(spark, path) for x in plain_parse(data)]
    assert len(parsed) == len(rows) and len({f[b"WARC-Record-ID"] for _, f, _ in parsed}) == len(rows)
    by_id = {f[b"WARC-Record-ID"].decode(): (at, block) for at, f, block in parsed}
    for x in records:
        at, block = by_id[x["record_id"]]
        head, _, payload = block.partition(b"\r\n\r\n")
        assert x["offset"] == at and x["http_length"] == int(head.rsplit(b": ", 1)[1])
        assert x["payload"] is None if x["type"] == "revisit" else bytes(x["payload"]) == payload
        assert x["refers_to"] is None or by_id[x["refers_to"]]


def test_chain_leaves_a_split_where_following_would():
    r = random.Random(3)
    for _ in range(300):
        end = r.randrange(1, 60)
        pos = sorted(r.sample(range(-10, end), r.randrange(0, min(20, end + 10))))
        step = [r.choice([-1, max(0, p + r.randrange(1, 30))]) for p in pos]
        leaves, last = warc.chain(np.array(pos, np.int64), np.array(step, np.int64), end)
        for p, out, end_at in zip(pos, leaves, last):
            at = p
            while True:
                nxt = step[pos.index(at)]
                if nxt in pos and 0 <= nxt < end:
                    at = nxt
                    continue
                break
            assert end_at == at and out == (nxt if nxt >= end else -1)


def test_broken_and_empty_archives(spark):
    path = folder(spark)
    warc.write(pages_of(spark, []), path)
    assert warc.read(spark, path, warc.summary).count() == 0
    cut = folder(spark)
    whole = MAGIC + b"WARC-Type: response\r\nWARC-Record-ID: <urn:page:1:x>\r\nContent-Length: 21\r\n\r\nHTTP/1.1 200 OK\r\n\r\nab\r\n\r\n"
    text = (whole + whole[:-9]).decode()
    spark.createDataFrame([(text[:-1],)], "t string").coalesce(1).write.option("lineSep", text[-1]).text(cut)
    with pytest.raises(warc.BrokenArchive):
        warc.read(spark, cut)
    left = warc.read(spark, cut, strict=False).collect()
    assert [(x["offset"], bytes(x["payload"])) for x in left] == [(0, b"ab")]


def test_query_covers_every_page(spark):
    rows = QUERIES["op12_warc"](spark, "/root/testdata/sf0.001").collect()
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    assert sorted((tuple(x) for x in rows), key=str) == expected([(p["page_id"], p["url"], p["html"]) for p in pages])
