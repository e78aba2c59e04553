"""N-gram Jaccard join: exact linking of documents by shared word shingles, by grouped prefixes.

Documents with the same shingle set form one class (copies are never
paired). A class is known by its prefix: its shingles in one global order,
rare ones first, cut so that two linked classes must share at least
``SHARED`` of them. Classes with the same prefix and size form one group.
Only groups are listed by prefix shingle, paired and filtered (sizes, places
in the prefix, shared prefix shingles); the pairs of groups that are left are
expanded to their classes. A pair of classes is verified on the full sets
unless a table of bucket counts of each set already shows too small an overlap
(an upper bound, so no link is lost).

Only components are wanted, so neither a list of groups nor a group is
paired out at once. In the first round all groups of a list are held against
one pivot (the group with most rows), all classes of a group against its head
(the class with most copies). What the first round joined needs no pair; only
groups, and classes of a group, of different components meet in the second
round, in which nothing is left out.

The global order comes from a sketch: counts of all shingles of all texts
in a table of fixed size (2^20 counters), by which a shingle far more
common than its bucket's usual content moves to the end. Any order gives
the same links; this one keeps common passages out of the prefixes.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (PAIR_ROWS, TEXT_ROWS, Words, bitmap, dropped, filter_texts, in_bitmap, repeated, slices, slot, small_batches, sql_type,
                     stored, utf8)
from .components import components

WIDTH, PERCENT = 4, 85
#: prefix shingles that a pair must share (where the smaller set allows it)
SHARED = 3
SKETCH_BITS, BLOCKS = 20, 64


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of each text; a text with fewer words is one shingle, without words none."""
    w = Words(texts, lower=True)
    hashes = w.hash
    at, h = w.windows(width, hashes)
    cut = np.searchsorted(w.doc[at], np.arange(len(texts) + 1))
    first = np.concatenate(([0], np.cumsum(w.count)))
    out = []
    for i in range(len(texts)):
        if 0 < w.count[i] < width:
            words = hashes[first[i]:first[i + 1]].tobytes()
            out.append(np.frombuffer(hashlib.blake2b(words, digest_size=8, person=b"short").digest(), np.uint64))
        else:
            out.append(np.unique(h[cut[i]:cut[i + 1]]))
    return out


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of n shares at least with any set it links to."""
    return -(-percent * n // 100)


def bucket_counts(s: np.ndarray) -> bytes:
    """How many shingles of a set fall into each range of hash values, about four a range, rounded up to a byte each."""
    bits = max(4, (len(s) // 4).bit_length())
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    scale = max(1, -(-int(counts.max()) // 255))
    return scale.to_bytes(8, "little") + (-(-counts // scale)).astype(np.uint8).tobytes()


def most_overlap(x: bytes, y: bytes) -> int:
    """Upper bound of the shingles two sets share, from their ``bucket_counts``."""
    x, y = (np.frombuffer(b, np.uint8, offset=8).astype(np.int64) * int.from_bytes(b[:8], "little") for b in (x, y))
    size = min(len(x), len(y))
    x, y = (c.reshape(size, -1).sum(axis=1) for c in (x, y))
    return int(np.minimum(x, y).sum())


def _sketch(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """How often shingles fall into each of 2^SKETCH_BITS buckets, over all texts."""
    size = 1 << SKETCH_BITS
    per = size // BLOCKS
    schema = pa.schema([("block", pa.int32()), ("counts", pa.binary())])

    def pack(counts: dict[int, np.ndarray]):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.int32()),
             pa.array([zlib.compress(c.tobytes(), 1) for c in counts.values()], pa.binary())], schema=schema)

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            texts = utf8(batch.column(0))
            for a, b in slices([len(t) for t in texts], 1 << 22):
                _, h = Words(texts[a:b], lower=True).windows(width)
                total += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
        yield pack({i: total[i * per:(i + 1) * per] for i in range(BLOCKS)})

    def add(batches):
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[block] = counts.get(block, 0) + np.frombuffer(zlib.decompress(raw), np.int64)
        yield pack(counts)

    ddl = "block int, counts binary"
    parts = docs.select(docs[text].cast("string")).mapInArrow(count, ddl)
    rows = parts.repartition(BLOCKS, "block").mapInArrow(add, ddl).collect()  # BLOCKS rows of fixed size
    total = np.zeros(size, np.int64)
    for r in rows:
        total[r["block"] * per:(r["block"] + 1) * per] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return total


def _common(counts: np.ndarray) -> np.ndarray:
    """How far above the usual a bucket is, in powers of two (0: usual)."""
    usual = max(1.0, 2 * float(np.median(counts)))
    return np.log2(np.maximum(1.0, counts / usual)).astype(np.uint8)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _prefixes(docs: DataFrame, key: str, text: str, width: int, percent: int, order: np.ndarray) -> DataFrame:
    """(key, th, n, node, grp, prefix, counts) of every row; node and grp are 128-bit digests of the set and of prefix and size."""
    shipped = docs.sparkSession.sparkContext.broadcast(order)
    digest = lambda b: hashlib.blake2b(b, digest_size=16).digest()

    def run(batches):
        rank = shipped.value
        for batch in batches:
            texts = utf8(batch.column(2))
            for a, b in slices([len(t) for t in texts]):
                sizes, nodes, groups, prefixes, counts = [], [], [], [], []
                for s in shingle_sets(texts[a:b], width):
                    n = len(s)
                    sizes.append(n)
                    if not n:
                        nodes.append(None)
                        groups.append(None)
                        prefixes.append(None)
                        counts.append(None)
                        continue
                    least = least_overlap(n, percent)
                    place = np.lexsort((s, rank[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
                    p = s[place[:n - least + min(SHARED, least)]]
                    nodes.append(digest(s.tobytes()))
                    groups.append(digest(n.to_bytes(8, "little") + p.tobytes()))
                    prefixes.append(_signed(p))
                    counts.append(bucket_counts(s))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()),
                     pa.array(groups, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(counts, pa.binary())],
                    names=["key", "th", "n", "node", "grp", "prefix", "counts"])

    body = docs[text].cast("string")
    source = docs.select(docs[key].alias("key"), F.xxhash64(body).alias("th"), body.alias("text"))
    return source.mapInArrow(
        run, f"key {sql_type(docs, key)}, th bigint, n bigint, node binary, grp binary, prefix array<bigint>, "
             "counts binary")


def _meeting(groups: DataFrame) -> DataFrame:
    """Prefix entries (token, gid, n, place, rows) that another group shares."""
    entries = groups.select(F.posexplode("prefix").alias("place", "token"), "gid", "n", "rows")
    return repeated(entries, ["token"])


def _sets(docs: DataFrame, key: str, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """(node, shingles, left) of the classes in ``wanted`` (node, key of one of its rows, left).

    A bitmap of the wanted keys, of fixed size, lets the scan skip other
    texts; what it lets through by chance is dropped by the join.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, "key"))

    def run(batches):
        wanted_bits = shipped.value
        done: set[bytes] = set()
        for batch in batches:
            rows = np.flatnonzero(in_bitmap(wanted_bits, batch.column(0)))
            texts = utf8(batch.column(1).take(pa.array(rows)))
            for a, b in slices([len(t) for t in texts]):
                nodes, sets = [], []
                for s in shingle_sets(texts[a:b], width):
                    if len(s):
                        node = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                        if node not in done:
                            done.add(node)
                            nodes.append(node)
                            sets.append(s.tobytes())
                if len(done) > 1_000_000:
                    done.clear()
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())],
                                                 names=["node", "shingles"])

    source = docs.select(slot(docs[key]).alias("__slot"), docs[text].cast("string").alias("__text"))
    found = source.mapInArrow(run, "node binary, shingles binary")
    return (found.join(wanted.select("node", "left"), "node")
            .groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("left").alias("left")))


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the bucket counts of both classes do not rule out."""
    x = nodes.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("counts").alias("ac"))
    y = nodes.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("counts").alias("bc"))

    def run(batches):
        for batch in batches:
            an, ac, bn, bc = (batch.column(i).to_pylist() for i in range(2, 6))
            both = np.array([most_overlap(p, q) for p, q in zip(ac, bc)], np.int64)
            keep = 100 * both >= percent * (np.array(an, np.int64) + np.array(bn, np.int64) - both)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return (pairs.join(y, "b").join(x, "a").select("a", "b", "an", "ac", "bn", "bc")
            .mapInArrow(run, "a binary, b binary"))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets meet the similarity, by intersecting the full sets."""
    left = sets.where("left").select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return (pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb")
            .mapInArrow(run, "a binary, b binary"))


def _assigned(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """(key, th, n, node, component) of every row; node and component are null without words."""
    spark = docs.sparkSession
    with small_batches(spark, TEXT_ROWS):
        order = _common(_sketch(docs, text, width))
        rows = stored(_prefixes(docs, key, text, width, percent, order), "jaccard-rows")
    some = rows.where("node IS NOT NULL")
    nodes = stored(some.groupBy("node").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.first("grp").alias("grp"),
                                            F.first("n").alias("n"), F.first("counts").alias("counts")), "jaccard-nodes")
    # groups get small numbers, fixed by this table: the long lists below hold no digests
    heads = stored(nodes.groupBy("grp").agg(F.max(F.struct("copies", "node"))["node"].alias("head"), F.count(F.lit(1)).alias("classes"))
                   .withColumn("gid", F.monotonically_increasing_id()), "jaccard-groups")
    ids = heads.select("grp", "gid")
    groups = (some.groupBy("grp").agg(F.first("prefix").alias("prefix"), F.first("n").alias("n"), F.count(F.lit(1)).alias("rows"))
              .join(ids, "grp"))
    overlap = lambda n: F.least(F.lit(SHARED), F.ceil(F.lit(percent) * F.col(n) / F.lit(100)))
    # entries before a shared one that no other group has are in no set that shares it (one global order):
    # so many shingles of the set at least are lost to any link found there; with too few shared entries there is none
    by_group = Window.partitionBy("gid")
    lost = F.col("place") - (F.row_number().over(by_group.orderBy("place")) - 1)
    meeting = (_meeting(groups).withColumn("left", F.col("n") - lost).withColumn("met", F.count(F.lit(1)).over(by_group))
               .where(F.col("met") >= overlap("n")).drop("place", "met"))
    # sizes that can link lie in one band or in two that touch: a list holds a band and the one below
    step = float(-np.log(percent / 100))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(step))
    lists = (meeting.withColumn("band", band)
             .select("token", "gid", "n", "left", "rows", F.explode(F.array(
                 F.struct(F.col("band").alias("list"), F.lit(True).alias("own")),
                 F.struct((F.col("band") + 1).alias("list"), F.lit(False).alias("own")))).alias("at"))
             .select(F.xxhash64("token", "at.list").alias("list"), "gid", "n", "left", "rows", F.col("at.own").alias("own")))
    lists = stored(lists, "jaccard-lists")
    pivots = (lists.groupBy("list").agg(F.max(F.struct("rows", "gid", "n", "own", "left")).alias("p"), F.min("gid").alias("low"),
                                        F.max("gid").alias("high"))
              .where("low != high").select("list", F.col("p.gid").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.own").alias("pown"),
                                             F.col("p.left").alias("pleft")))
    short = lists
    lists = stored(lists.drop("rows").join(pivots, "list"), "jaccard-shared")
    dropped(short)

    def fits(x: str, y: str, left_x: str, left_y: str):
        """Sizes can link, and so can what is left of both sets at this place."""
        x, y = F.col(x), F.col(y)
        return ((F.least(x, y) * 100 >= F.greatest(x, y) * percent)
                & (F.least(left_x, left_y) * (100 + percent) >= (x + y) * percent))

    def counted(pairs: DataFrame) -> DataFrame:
        """Pairs of groups (ga, gb) that share enough prefix shingles."""
        return (pairs.groupBy("ga", "gb").agg(F.count(F.lit(1)).alias("times"), F.first("an").alias("an"), F.first("bn").alias("bn"))
                .where(F.col("times") >= F.least(overlap("an"), overlap("bn"))).select("ga", "gb"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        with small_batches(spark, PAIR_ROWS):
            pairs = stored(_likely(pairs, nodes, percent), f"jaccard-{name}")
        wanted = (pairs.select(F.col("a").alias("node"), F.lit(True).alias("left"))
                  .unionAll(pairs.select(F.col("b").alias("node"), F.lit(False).alias("left")))
                  .groupBy("node").agg(F.max("left").alias("left")).join(nodes.select("node", "key"), "node"))
        with small_batches(spark, TEXT_ROWS):
            sets = stored(_sets(docs, key, text, width, wanted), "jaccard-sets")
        with small_batches(spark, PAIR_ROWS):
            links = stored(_linked(pairs, sets, percent), "jaccard-links")
        dropped(sets)
        return links

    members = nodes.select("grp", "node").join(ids, "grp").drop("grp")
    # the first round: groups against the pivot of a list, classes against the head of a group
    star = counted(lists.where((F.col("gid") != F.col("pivot")) & (F.col("own") | F.col("pown")) & fits("n", "pn", "left", "pleft"))
                   .select(F.col("pivot").alias("ga"), F.col("gid").alias("gb"), F.col("pn").alias("an"), F.col("n").alias("bn")))
    across = (star.join(members.select(F.col("gid").alias("gb"), F.col("node").alias("b")), "gb")
              .join(heads.select(F.col("gid").alias("ga"), F.col("head").alias("a")), "ga").select("a", "b"))
    inside = (members.select("gid", F.col("node").alias("b")).join(heads.where("classes > 1"), "gid")
              .where("b != head").select(F.col("head").alias("a"), "b"))
    first = verified(across.unionAll(inside), "star")
    joined = components(first, "a", "b")
    # the second round: lists and groups that still hold several components
    labelled = stored(members.join(joined, "node", "left")
                      .withColumn("component", F.coalesce("component", "node")), "jaccard-labelled")
    whole = labelled.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    # a component goes by its lowest group; a group in several counts as one of its own, unlike all others
    alike = Window.partitionBy("low", F.when(F.col("low") != F.col("high"), F.col("gid")))
    labels = stored(whole.select("gid", F.min("gid").over(alike).alias("component")), "jaccard-labels")
    shared = lists
    lists = stored(lists.select("list", "gid", "n", "left", "own").join(labels, "gid"), "jaccard-shared")
    dropped(shared)
    mixed = (lists.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high"))
             .where("low != high").select("list"))
    open_lists = stored(lists.join(mixed, "list", "left_semi"), "jaccard-open")
    dropped(lists)
    x = open_lists.select("list", *[F.col(c).alias(f"x_{c}") for c in ("gid", "n", "left", "own", "component")])
    y = open_lists.select("list", *[F.col(c).alias(f"y_{c}") for c in ("gid", "n", "left", "own", "component")])
    rest = counted(x.join(y, "list").where((F.col("x_gid") < F.col("y_gid")) & (F.col("x_component") != F.col("y_component"))
                                           & (F.col("x_own") | F.col("y_own")) & fits("x_n", "y_n", "x_left", "y_left"))
                   .select(F.col("x_gid").alias("ga"), F.col("y_gid").alias("gb"), F.col("x_n").alias("an"), F.col("y_n").alias("bn")))
    a_side = labelled.select(F.col("gid").alias("ga"), F.col("node").alias("a"), F.col("component").alias("ca"))
    b_side = labelled.select(F.col("gid").alias("gb"), F.col("node").alias("b"), F.col("component").alias("cb"))
    across = rest.join(a_side, "ga").join(b_side, "gb").where("ca != cb").select("a", "b")
    parted = labelled.join(whole.where("low != high").select("gid"), "gid", "left_semi")
    inside = (parted.select("gid", F.col("node").alias("a"), F.col("component").alias("ca"))
              .join(parted.select("gid", F.col("node").alias("b"), F.col("component").alias("cb")), "gid")
              .where("a < b AND ca != cb").select("a", "b"))
    second = verified(across.unionAll(inside), "rest")
    final = components(first.unionAll(second), "a", "b")
    return stored(rows.select("key", "th", "n", "node").join(final, "node", "left")
                  .withColumn("component", F.coalesce("component", "node")), "jaccard-assigned")


def linked_components(docs: DataFrame, key: str = "doc_id", text: str = "text",
                      width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of every row of ``docs``.

    component_id is the smallest key reachable by links, null keys aside. A
    row without words (null and empty texts too) is linked with nothing and
    keeps its own key. Equal sets are one node, however many rows hold it.
    """
    rows = _assigned(docs, key, text, width, percent)
    lowest = rows.where("component IS NOT NULL").groupBy("component").agg(F.min("key").alias("component_id"))
    return (rows.join(lowest, "component", "left")
            .select(F.col("key").alias(key), F.col("n").alias("n_shingles"),
                    F.when(F.col("component").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id")))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each component: the smallest key (nulls last), then text hash.

    Rows without words stay. Only rows of components with several rows are
    shuffled; a bitmap of fixed size lets all others pass by the join.
    """
    rows = _assigned(docs, key, text, width, percent).where("component IS NOT NULL")
    rank = F.struct(F.col("key").isNull().alias("none"), "key", "th")
    several = (rows.groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.min(rank).alias("best"))
               .where("rows > 1"))
    touched = stored(rows.join(several, "component")
                     .select(F.col("key").alias("__key"), F.col("th").alias("__of"), (rank == F.col("best")).alias("__best"))
                     .distinct(), "jaccard-touched")
    shipped = docs.sparkSession.sparkContext.broadcast(bitmap(touched, "__key", "__of"))
    at = slot(docs[key], F.xxhash64(docs[text].cast("string")))
    hit = filter_texts(docs, [at], lambda: lambda c: in_bitmap(shipped.value, c[0]))
    other = filter_texts(docs, [at], lambda: lambda c: ~in_bitmap(shipped.value, c[0]))
    names = docs.columns
    left = hit.toDF(*[f"c{i}" for i in range(len(names))])  # no column of the input can have a name used below
    own_key, own_text = (F.col(f"c{names.index(c)}") for c in (key, text))
    own = F.xxhash64(own_text.cast("string"))
    on = own_key.eqNullSafe(touched["__key"]) & (own == touched["__of"])
    same = Window.partitionBy(own_key, own).orderBy("__best")
    kept = (left.join(touched, on, "left").where("__best IS NULL OR __best")
            .withColumn("__n", F.when(F.col("__best").isNull(), 1).otherwise(F.row_number().over(same))).where("__n = 1"))
    return other.unionAll(kept.select(*left.columns).toDF(*names))
