"""WARC archives written and read back by Spark, with boundary-chain verification.

Writing: equal payloads are found by digest on narrow rows; payloads that
occur once go straight to a file, and only rows whose digest may have
copies meet the table of copies. Spark's text writer puts the records out.

Reading: the files are split at every magic ``WARC/1.1`` line, also at those
inside payloads, so every piece is a candidate record. A task follows the
announced lengths of its split's candidates and emits, for each, the
successor behind the split. Pointer jumping from the start of every file
over these offsets (the jump doubles each round) keeps the candidates that
the chain reaches; a magic inside a payload is never landed on. A second
scan cuts the records at the boundaries so found.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slot, stored

VERSION = "1.1"
#: payloads from this size on are stored once
LEAST_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
#: copies from this share of all copies on are hot; there are fewer of them than this number
HOT_SHARE = 256
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
_LENGTH = re.compile(rb"(?i)(?:^|\r\n)content-length:[ \t]*([0-9]{1,18})[ \t]*(?:\r\n|$)")


# ---------------------------------------------------------------- writing


def _copies(rows: DataFrame, least: int) -> DataFrame:
    """(digest, size, copies, best, best_rows) of the payloads that occur more than once; best is the largest key."""
    per_key = rows.where(F.col("size") >= least).groupBy("digest", "size", "key").agg(F.count(F.lit(1)).alias("n"))
    return (per_key.groupBy("digest", "size")
            .agg(F.sum("n").alias("copies"), F.max(F.struct(F.col("key").isNotNull().alias("some"), "key", "n")).alias("b"))
            .where("copies > 1").select("digest", "size", "copies", F.col("b.key").alias("best"), F.col("b.n").alias("best_rows")))


def _bitmap_table(keys: DataFrame, *cols: str) -> DataFrame:
    """(page, bits): slots that the keys fall into, at most 256 rows of 4 kB."""
    place = slot(*[F.col(c) for c in cols]) + 1
    return (keys.groupBy(F.bitmap_bucket_number(place).alias("page"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")))


def _in_bitmap(bits: Column, *cols: Column) -> Column:
    at = F.bitmap_bit_position(slot(*cols) + 1)
    octet = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("getbit", octet, (at % 8).cast("int")) == 1, F.lit(False))


def _record_id(key: Column, own: Column) -> Column:
    name = F.when(key.isNull(), F.lit("nopage")).otherwise(F.concat(F.lit("page:"), F.url_encode(key.cast("string"))))
    return F.concat(F.lit("<urn:"), name, F.lit(":"), own, F.lit(">"))


def records(rows: DataFrame, least: int, date: str) -> Column:
    """The record of a row (key, url, body, size, digest, kind, best), but for its last line break."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
                    line("Content-Length", F.col("size").cast("string")), F.lit(CRLF))
    whole = F.col("kind") == "response"
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    # one response holds a payload of that size: its digest names it, and revisits refer to that name
    own = F.when(whole & (F.col("size") >= least), F.col("digest")).otherwise(F.uuid())
    refers = F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("best"), F.col("digest"))))
    block = F.when(whole, F.concat(http, F.col("body"))).otherwise(http)
    return F.concat(
        F.lit(f"WARC/{VERSION}{CRLF}"), line("WARC-Type", F.col("kind")), line("WARC-Record-ID", _record_id(F.col("key"), own)),
        line("WARC-Date", F.lit(date)), F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), F.when(whole, F.lit("")).otherwise(refers),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block, F.lit(CRLF))


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", body: str = "html",
          least: int = LEAST_BYTES, date: str = DATE) -> None:
    """Write one record per row of ``pages`` as WARC files under ``path``.

    Of rows with equal payloads of at least ``least`` bytes, one with the
    largest key is the response; the others are revisits that refer to it and
    carry only the HTTP head. Rows equal in key and payload: one of them. A
    null key is smaller than any other; a null body is an empty payload; a null
    url leaves its line out. Other columns are not read. An empty table gives
    an empty folder. Payloads without copies are not shuffled; hot ones (fewer
    than ``HOT_SHARE``, by their share) meet their group by broadcast.
    """
    payload = F.coalesce(pages[body].cast("string"), F.lit(""))
    rows = pages.select(pages[key].alias("key"), pages[url].cast("string").alias("url"), payload.alias("body")).withColumns(
        {"size": F.octet_length("body").cast("long"), "digest": F.sha1(F.col("body").cast("binary"))})
    copies = stored(_copies(rows.select("key", "size", "digest"), least), "warc-copies")
    totals = copies.agg(F.sum("copies").alias("all"), F.max("best_rows").alias("twins")).first()
    group = copies.select("digest", "size", "best", "best_rows")
    hot = group.where(copies["copies"] * HOT_SHARE > (totals["all"] or 0))
    cold = group.where(copies["copies"] * HOT_SHARE <= (totals["all"] or 0))
    bits = stored(_bitmap_table(copies, "digest", "size"), "warc-bits")
    bucket = F.bitmap_bucket_number(slot(F.col("digest"), F.col("size")) + 1)
    seen = (rows.join(F.broadcast(bits), bucket == F.col("page"), "left")
            .withColumn("hit", _in_bitmap(F.col("bits"), F.col("digest"), F.col("size"))).drop("page", "bits")
            .join(F.broadcast(hot), ["digest", "size"], "left"))
    sure = ~F.col("hit") | F.col("best_rows").isNotNull()
    judged = seen.where(sure).unionByName(seen.where(~sure).drop("best", "best_rows").join(cold, ["digest", "size"], "left"))
    first = F.col("best_rows").isNull() | F.col("key").eqNullSafe(F.col("best"))
    kind = lambda is_first: F.when(is_first, F.lit("response")).otherwise(F.lit("revisit"))
    if (totals["twins"] or 0) > 1:  # rows equal in key and payload: the first by url is the response
        twin = first & (F.col("best_rows") > 1)
        one = F.row_number().over(Window.partitionBy("digest", "size").orderBy("url")) == 1
        marked = judged.where(~F.coalesce(twin, F.lit(False))).withColumn("kind", kind(first)).unionByName(
            judged.where(twin).withColumn("kind", kind(one)))
    else:
        marked = judged.withColumn("kind", kind(first))
    marked.select(records(marked, least, date).alias("value")).write.option("lineSep", CRLF).text(path)


# ---------------------------------------------------------------- boundaries


def _pieces(spark: SparkSession, path: str, magic: str) -> DataFrame:
    """(file, block, size, place, value): what stands between magic lines, in the order of each split."""
    return (spark.read.option("lineSep", magic).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("place"),
                    F.col("value").cast("binary").alias("value")))


def chain(pos: np.ndarray, step: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the chain from each candidate leaves the split, and the last candidate before; -1: on no boundary.

    ``pos`` ascends; ``step`` is the announced successor (-1: none); offsets
    from ``end`` on lie behind the split. One scan from the back.
    """
    at = np.searchsorted(pos, step)
    inside = (step >= 0) & (step < end)
    lands = inside & (at < len(pos)) & (pos[np.minimum(at, len(pos) - 1)] == step)
    leaves, last = np.where(inside, -1, step), pos.copy()
    for i in np.flatnonzero(lands)[::-1]:
        leaves[i], last[i] = leaves[at[i]], last[at[i]]
    return leaves, last


def _splits(spark: SparkSession, path: str, magic: str) -> DataFrame:
    """One row per split: its length and, for each candidate, offset, exit and last record (from the split's start)."""
    size = len(magic)
    pieces = _pieces(spark, path, magic)
    head = F.substring_index(F.col("value").cast("string"), CRLF * 2, 1).cast("binary")
    narrow = pieces.select("file", "block", "size", F.octet_length("value").cast("long").alias("bytes"), head.alias("head"))
    ddl = "file string, block bigint, size bigint, total bigint, pos array<bigint>, leaves array<bigint>, last array<bigint>"

    def run(batches):
        held, lengths, heads = None, [], []

        def done():
            n = np.array(lengths, np.int64) + size
            after = np.cumsum(n)
            pos = after - n - size
            step = np.full(len(n), -1, np.int64)
            for i, h in enumerate(heads):
                said = _LENGTH.search(h) if len(h) < lengths[i] else None
                if said:
                    step[i] = pos[i] + size + len(h) + 4 + int(said[1]) + 4
            real = np.ones(len(n), bool)
            real[0] = held[1] > 0  # what stands before the first magic of a file is no candidate
            leaves, last = chain(pos[real], step[real], int(after[-1]) - size)
            return pa.RecordBatch.from_arrays(
                [pa.array([held[0]]), pa.array([held[1]], pa.int64()), pa.array([held[2]], pa.int64()), pa.array([int(after[-1])], pa.int64()),
                 *[pa.array([x], pa.list_(pa.int64())) for x in (pos[real], leaves, last)]],
                names=["file", "block", "size", "total", "pos", "leaves", "last"])

        for batch in batches:
            for file, block, of, n, h in zip(*[c.to_pylist() for c in batch.columns]):
                if held is not None and held[:2] != (file, block):
                    yield done()
                    lengths, heads = [], []
                held = (file, block, of)
                lengths.append(n)
                heads.append(h)
        if held is not None:
            yield done()

    return narrow.mapInArrow(run, ddl)


class BrokenArchive(ValueError):
    """A file whose chain of records does not end where the file ends."""


def boundaries(spark: SparkSession, path: str, version: str = VERSION, strict: bool = True) -> DataFrame:
    """(file, block, base, total, entry, owner) per split of the files under ``path``, stored.

    ``base`` is the offset at which the split's first piece stands, ``entry``
    the first record that begins in the split (null: none), ``owner`` the
    record that began before the split and reaches into it (null: none).
    ``strict`` raises ``BrokenArchive`` if a chain does not end with its
    file; else what cannot be reached is left out, and so is a record cut
    short by the end of its file.
    """
    magic = f"WARC/{version}{CRLF}"
    splits = stored(_splits(spark, path, magic), "warc-splits")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(splits.select("file", "block", "size", "total",
                                 F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "warc-bases")
    behind = lambda c: F.when(F.col(f"c.{c}") >= 0, F.col(f"c.{c}") + F.col("base")).alias(c)
    # the first piece of a split other than the first stands behind a magic that ends the split before
    candidates = (splits.select("file", "block", F.explode(F.arrays_zip("pos", "leaves", "last")).alias("c"))
                  .join(bases.select("file", "block", "base", "size"), ["file", "block"])
                  .select("file", "block", "size", (F.col("c.pos") + F.col("base")).alias("at"), behind("leaves"),
                          (F.col("c.last") + F.col("base")).alias("last")))
    starts = bases.select("file", F.lit(0).cast("long").alias("at")).distinct()
    landed = candidates.where("leaves < size").select("file", F.col("leaves").alias("at")).unionAll(starts).distinct()
    nodes = stored(candidates.join(landed, ["file", "at"]), "warc-nodes")
    jump = nodes.select("file", "at", F.col("leaves").alias("to")).where("to IS NOT NULL")
    reached = stored(nodes.select("file", "at").join(starts, ["file", "at"], "left_semi"), "warc-reached")
    known = reached.count()
    while True:  # after k rounds the first 2^k nodes of every chain are reached
        ahead = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at")).join(nodes.select("file", "at"), ["file", "at"], "left_semi")
        reached = stored(reached.unionAll(ahead).distinct(), "warc-reached")
        now = reached.count()
        if now == known:
            break
        known = now
        over = jump.select("file", F.col("at").alias("to"), F.col("to").alias("over"))
        jump = stored(jump.join(over, ["file", "to"]).select("file", "at", F.col("over").alias("to")), "warc-jump")
    entries = nodes.join(reached, ["file", "at"], "left_semi").select("file", "block", F.col("at").alias("entry"), "last", "leaves")
    if strict:
        ends = bases.groupBy("file").agg(F.max("size").alias("size")).join(
            entries.groupBy("file").agg(F.max("leaves").alias("end"), F.max(F.col("leaves").isNull()).alias("lost")), "file", "left")
        bad = ends.where("size > 0 AND (end IS NULL OR lost OR end != size)").select("file").first()
        if bad:
            raise BrokenArchive(f"the records of {bad['file']} do not end where the file ends")
    joined = bases.join(entries, ["file", "block"], "left")
    open_at = F.last(F.when(F.col("leaves") <= F.col("size"), F.col("last")), ignorenulls=True).over(before)
    open_to = F.last(F.when(F.col("leaves") <= F.col("size"), F.col("leaves")), ignorenulls=True).over(before)
    return stored(joined.withColumn("owner", F.when(open_to > F.col("base") - len(magic), open_at))
                  .select("file", "block", "base", "total", "entry", "owner"), "warc-boundaries")


# ---------------------------------------------------------------- records

#: what a second scan says if Spark has planned other splits than for the first (the cluster's size changed in between)
_PLANNED_ANEW = "splits differ from those of the first scan"


def _cut(spark: SparkSession, path: str, found: DataFrame, magic: str) -> DataFrame:
    """(file, offset, record): the bytes of every record behind its magic line."""
    lead = magic.encode()
    # the order of the split is part of the work: rows are sorted back, whichever join Spark takes for the splits
    rows = (_pieces(spark, path, magic).drop("size").join(found, ["file", "block"], "left")
            .sortWithinPartitions("file", "block", "place")
            .select("file", "block", "base", "total", "entry", "owner", "value"))
    ddl = "file string, offset bigint, at bigint, whole boolean, record binary"

    def run(batches):
        held, seen, said, expect, open_at, open_to, parts, own = None, 0, 0, None, None, None, [], False
        out = []

        def flush():
            cols = list(zip(*out)) if out else [[]] * 5
            types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                              names=["file", "offset", "at", "whole", "record"])

        def close():
            if held is not None and seen != said:
                raise RuntimeError(_PLANNED_ANEW)
            if own and parts:  # the record goes on in the next split
                out.append((held[0], open_at, open_at, False, b"".join(parts)))

        for batch in batches:
            for file, block, base, total, entry, owner, value in zip(*[c.to_pylist() for c in batch.columns]):
                if held != (file, block):
                    close()
                    if base is None:
                        raise RuntimeError(_PLANNED_ANEW)
                    held, seen, said, expect, open_at, open_to, parts, own = (file, block), 0, total, entry, owner, entry, [], False
                at = base + seen - len(lead)
                seen += len(value) + len(lead)
                if at < 0:
                    continue
                if at == expect:
                    cut = value.find(b"\r\n\r\n")
                    length = _LENGTH.search(value[:cut]) if cut >= 0 else None
                    if length is None:  # the end of what can be reached
                        expect = open_at = None
                        parts, own = [], False
                        continue
                    expect = at + len(lead) + cut + 4 + int(length[1]) + 4
                    if at + len(lead) + len(value) == expect:
                        out.append((file, at, at, True, value))
                        open_at, parts, own = None, [], False
                    else:
                        open_at, parts, own = at, [value], True
                elif open_at is not None and (expect is None or at < expect):
                    if own:
                        parts.append(lead + value)
                        if at + len(lead) + len(value) == expect:
                            out.append((file, open_at, open_at, True, b"".join(parts)))
                            open_at, parts, own = None, [], False
                    else:
                        out.append((file, open_at, at, False, lead + value))
            if out:
                yield flush()
                out = []
        close()
        if out:
            yield flush()

    return rows.mapInArrow(run, ddl)


def _parsed(cut: DataFrame) -> DataFrame:
    """Header fields and payload of (file, offset, record) rows."""
    record = F.col("record").cast("string")
    head = F.substring_index(record, CRLF * 2, 1)
    field = lambda h, name: F.nullif(F.regexp_extract(h, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))
    size = field(F.col("head"), "Content-Length").cast("long")
    block = F.expr("substring(record, octet_length(head) + 5, cast(content_length as int))")
    http = F.substring_index(F.col("block").cast("string"), CRLF * 2, 1)
    return (cut.withColumn("head", head).withColumn("content_length", size).withColumn("block", block)
            .where(F.octet_length("block") == F.col("content_length")).withColumn("http", http)
            .select("file", "offset", field(F.col("head"), "WARC-Type").alias("type"),
                    field(F.col("head"), "WARC-Record-ID").alias("record_id"), field(F.col("head"), "WARC-Target-URI").alias("target_uri"),
                    field(F.col("head"), "WARC-Date").alias("date"), field(F.col("head"), "WARC-Payload-Digest").alias("payload_digest"),
                    field(F.col("head"), "WARC-Refers-To").alias("refers_to"),
                    field(F.col("http"), "Content-Length").cast("long").alias("http_length"),
                    F.when(field(F.col("head"), "WARC-Type") == "response", F.expr("substring(block, octet_length(http) + 5)")).alias("payload")))


def opened(spark: SparkSession, path: str, version: str = VERSION, strict: bool = True) -> DataFrame:
    """The records of all WARC files under ``path``: file, offset, header fields, http_length and payload (responses).

    Records that stand in one piece leave the scan as they are; the pieces
    of one that its payload's magic lines part are put together by record, or by
    the split where they stand in one. Evaluated with other splits than the
    boundaries were found with, it raises; ``read`` then begins anew.
    """
    magic = f"WARC/{version}{CRLF}"
    cut = _cut(spark, path, boundaries(spark, path, version, strict), magic)
    whole = cut.where("whole").select("file", "offset", "record")
    parted = (cut.where("NOT whole").groupBy("file", "offset")
              .agg(F.sort_array(F.collect_list(F.struct("at", "record"))).alias("pieces"))
              .select("file", "offset", F.aggregate("pieces", F.lit(b""), lambda a, x: F.concat(a, x["record"])).alias("record")))
    return _parsed(whole.unionAll(parted))


def read(spark: SparkSession, path: str, take=lambda records: records, version: str = VERSION, strict: bool = True,
         attempts: int = 3) -> DataFrame:
    """``take(opened(...))``, stored; begun anew if Spark plans other splits for the second scan."""
    for left in range(attempts, 0, -1):
        try:
            return stored(take(opened(spark, path, version, strict)), "warc-read")
        except Exception as fault:
            if left == 1 or _PLANNED_ANEW not in str(fault):
                raise
    raise AssertionError("unreachable")


def page_of(record_id: Column, to: str) -> Column:
    """The key in a record's name (null where it has none)."""
    return F.nullif(F.url_decode(F.regexp_extract(record_id, r"^<urn:page:([^:]*):", 1)), F.lit("")).cast(to)


def summary(records_: DataFrame, key: str = "page_id", key_type: str = "bigint") -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of opened records.

    A response's payload is measured and hashed; a revisit has the length of
    its HTTP head and the digest of its own header.
    """
    whole = F.col("type") == "response"
    return records_.select(
        page_of(F.col("record_id"), key_type).alias(key),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        F.col("type").alias("record_type"), page_of(F.col("refers_to"), key_type).alias("refers_to"))
