"""Document fingerprints: a digest of byte-triplet bucket quartiles and length, with a bounded difference.

Every window of four bytes gives three byte triplets, each hashed to one
of 128 buckets. A bucket is written as 0 to 3 by the quartile of all
bucket counts it falls into; a head holds the length on a log scale and
the ratios of the quartiles. The difference of two digests is the sum of
bucket distances (0 to 3 apart, the widest counted double) and head
distances, cut at ``BOUND``; likeness is one minus its share of the bound.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sql_type, stored, utf8

BUCKETS = 128
#: differences from here on count as no likeness at all
BOUND = 240
_DISTANCE = np.array([0, 1, 2, 6])
#: bytes counted at once
_BLOCK = 1 << 18


def _counts(data: bytes) -> np.ndarray:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, max(0, len(data) - 3), _BLOCK):
        b = np.frombuffer(data[at:at + _BLOCK + 3], dtype=np.uint8).astype(np.uint32)
        if len(b) < 4:
            break
        b0, b1, b2, b3 = b[:-3] * np.uint32(0x9E3779B1), b[1:-2] * np.uint32(0x85EBCA77), b[2:-1], b[3:]
        c2, c3 = b2 * np.uint32(0xC2B2AE3D), b3 * np.uint32(0xC2B2AE3D)
        for h in (b0 + b1 + c2, (b0 + b1 + c3) ^ np.uint32(0x5BD1E995), b0 + b2 * np.uint32(0x85EBCA77) + c3):
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            total += np.bincount(h >> np.uint32(25), minlength=BUCKETS)
    return total


def fingerprint(data: bytes) -> str:
    """Hex digest: two bytes of head, then two bits for each bucket. Texts under 4 bytes differ by length only."""
    counts = _counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = min(255, round(math.log(1 + len(data)) / math.log(1.08)))
    ratio = (int(q1 * 15 // q3) << 4 | int(q2 * 15 // q3)) if q3 else 0
    packed = np.packbits(np.unpackbits(codes.astype(np.uint8)[:, None], axis=1)[:, 6:].reshape(-1))
    return f"{length:02x}{ratio:02x}" + packed.tobytes().hex()


def difference(a: str, b: str) -> int:
    """0 for equal digests, at most ``BOUND``."""
    if a == b:
        return 0
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    two = lambda v: np.packbits(np.pad(np.unpackbits(v[2:]).reshape(-1, 2), ((0, 0), (6, 0))), axis=1)[:, 0]
    body = int(_DISTANCE[np.abs(two(x).astype(int) - two(y).astype(int))].sum())
    head = min(24, abs(int(x[0]) - int(y[0])) // 2)
    head += abs(int(x[1] >> 4) - int(y[1] >> 4)) + abs(int(x[1] & 15) - int(y[1] & 15))
    return min(BOUND, body + head)


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / BOUND


def _edited(text: str, after: str) -> str:
    k = len(text) // 4
    return text[:len(text) - k] + after[:k] if k else text


def _row(text: str, mark: str, after: str, after_mark: str) -> dict:
    changed = _edited(text, after).encode()
    changed_mark = fingerprint(changed)
    return {"n_chars": len(text), "edited_sha256": hashlib.sha256(changed).hexdigest(),
            "fingerprint": mark, "edited_fingerprint": changed_mark,
            "near_edited": likeness(mark, changed_mark), "near_next": likeness(mark, after_mark)}


_OUT = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_DDL = ("n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")
_ARROW = dict(zip(_OUT, [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]))
_ROWS_AT_ONCE = 512


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Fingerprints of every row, of its edited text and of the next row in ascending ``key``.

    Rows are dealt by ranges of the key and sorted inside them, so "next"
    is the row after, in one pass over the text; only the seams (last row
    of a range, first row of the range after it) are joined, one pair per
    range. Null keys come last, equal keys keep the order they are read
    in, and the last row is followed by the first; a single row follows
    itself. Null text is empty; empty tables give no rows.
    """
    key_type = sql_type(docs, key)
    ordered = (docs.select(docs[key].alias("__key"), docs[text].cast("string").alias("__text"))
               .withColumn("__place", F.monotonically_increasing_id()))
    order = [F.col("__key").asc_nulls_last(), F.col("__place").asc()]
    dealt = (ordered.repartitionByRange(*order).sortWithinPartitions(*order).drop("__place"))

    def run(batches):
        here = TaskContext.get().partitionId()
        before, keys, rows = None, [], []

        def flush(kind: int, key_type, texts=None):
            columns = [pa.array(keys, type=key_type), pa.array([kind] * len(keys), type=pa.int32()),
                       pa.array([here] * len(keys), type=pa.int32()),
                       pa.array(texts or [None] * len(keys), type=pa.string())]
            columns += [pa.array([r.get(n) for r in rows], type=t) for n, t in _ARROW.items()]
            return pa.RecordBatch.from_arrays(columns, names=["__key", "__kind", "__part", "__text", *_OUT])

        kept_type = None
        for batch in batches:
            kept_type = batch.schema.field(0).type
            for k, raw in zip(batch.column(0), utf8(batch.column(1))):
                text, mark = raw.decode(), fingerprint(raw)
                if before is None:  # the first row of this range, for the seam
                    keys, rows = [k], [{"fingerprint": mark}]
                    yield flush(2, kept_type, [text])
                    keys, rows = [], []
                else:
                    keys.append(before[0])
                    rows.append(_row(before[1], before[2], text, mark))
                    if len(keys) >= _ROWS_AT_ONCE:
                        yield flush(0, kept_type)
                        keys, rows = [], []
                before = (k, text, mark)
        if before is not None:
            if keys:
                yield flush(0, kept_type)
            keys, rows = [before[0]], [{"fingerprint": before[2]}]
            yield flush(1, kept_type, [before[1]])

    parts = stored(dealt.mapInArrow(
        run, f"__key {key_type}, __kind int, __part int, __text string, {_DDL}"), "fingerprints")
    done = parts.where("__kind = 0").select("__key", *_OUT)
    heads = parts.where("__kind = 2").select(
        F.col("__part").alias("__head"), F.col("__text").alias("__after"), F.col("fingerprint").alias("__after_mark"))
    # one row per range that has rows: the range that follows it, the first one after the last
    ranges = parts.where("__kind = 2").select("__part")
    in_order = Window.orderBy("__part")
    follows = ranges.select(
        F.col("__part").alias("__from"),
        F.coalesce(F.lead("__part").over(in_order),
                   F.first("__part").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).alias("__to"))
    seams = (parts.where("__kind = 1").join(follows, F.col("__part") == F.col("__from"))
             .join(heads, F.col("__to") == F.col("__head"))
             .select("__key", "__text", "fingerprint", "__after", "__after_mark"))

    def close(batches):
        for batch in batches:
            _, texts, marks, after, after_marks = (batch.column(i).to_pylist() for i in range(5))
            rows = [_row(*x) for x in zip(texts, marks, after, after_marks)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array([r[n] for r in rows], type=t) for n, t in _ARROW.items()],
                names=["__key", *_OUT])

    joined = seams.mapInArrow(close, f"__key {key_type}, {_DDL}")
    return done.unionByName(joined).withColumnRenamed("__key", key)
