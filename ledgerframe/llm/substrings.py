"""Suffix-array dedup: repeated byte strings by distributed prefix doubling over content-defined phrases.

A suffix array over every byte does not fit a cluster's disks, so
positions are thinned first. An anchor is a place whose next ``GRAM``
bytes hash below a bound; equal strings have their anchors at equal
places, and bytes between two anchors form a phrase. Ranks are given to
anchors in three rounds: by one phrase, by runs of 2 phrases (the one
doubling), then by chains of such runs as long as the threshold needs. In
every round Spark sorts the (rank, position) rows, and anchors whose rank
is unique leave. Ranks of phrases and runs are 64-bit hashes; those of
chains are 128 bits wide, over the 64-bit ranks of their runs.

What is left gives two exact tests for a window of ``length`` bytes. If
the chain of phrases that contains it repeats, so does the window. If a
run of phrases inside it is unique, so is the window. Only windows between
the two (those that reach into the phrase at the edge of a repeated
passage) are hashed (128 bits) and sorted themselves, together with the
windows of other places that could equal them. So the result is that of
the full suffix array with the given threshold, at about a fiftieth of its
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE_CODE, _MULT, bitmap, filter_texts, in_bitmap, mix64, repeated, slices, slot, sql_type, stored, utf8

LENGTH = 400
GRAM = 12
#: one place in so many is an anchor, on average
EVERY = 32
RUN = 2
_BLOCK = 1 << 18
_SEED2 = np.uint64(0xD6E8FEB86659FD93)


def _grams(b: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the ``GRAM`` (12) bytes at every place."""
    x2 = b[:-1].astype(np.uint16) | b[1:].astype(np.uint16) << np.uint16(8)
    x4 = x2[:-2].astype(np.uint32) | x2[2:].astype(np.uint32) << np.uint32(16)
    x = x4[:-8] * np.uint32(0x9E3779B1)
    for part, odd in ((x4[4:-4], 0x85EBCA77), (x4[8:], 0xC2B2AE3D)):
        x += part
        x ^= x >> np.uint32(15)
        x *= np.uint32(odd)
    return x


class Text:
    """Texts one after another, with their anchors and phrases; all places count from the start of ``data``."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        found = []
        for low in range(0, max(0, len(self.data) - GRAM + 1), _BLOCK):
            grams = _grams(self.data[low:low + _BLOCK + GRAM - 1])
            found.append(np.flatnonzero(grams < np.uint32((1 << 32) // EVERY)) + low)
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        of = np.searchsorted(self.end, at, side="right")
        inside = at + GRAM <= self.end[of] if len(at) else np.zeros(0, bool)
        self.at, self.of = at[inside], of[inside]
        self.number = np.arange(len(self.at)) - np.searchsorted(self.of, self.of, side="left")

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """Anchors that another one of the same text follows; fingerprint of the bytes up to that one."""
        if len(self.at) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        low, high = self.at[0], self.at[-1]
        size = np.diff(self.at)
        value = _BYTE_CODE[self.data[low:high]]
        within = np.arange(high - low) - np.repeat(self.at[:-1] - low, size)
        value *= _powers(int(size.max()))[within]
        hashes = mix64(np.add.reduceat(value, self.at[:-1] - low) + mix64(size.astype(np.uint64)))
        here = np.flatnonzero(self.of[1:] == self.of[:-1])
        return here, hashes[here]

    def reach(self, length: int) -> np.ndarray:
        """Phrases from each anchor until they hold every window that starts before the next anchor; 0 if they never do."""
        n = len(self.at)
        out = np.zeros(n, np.int64)
        if n > 1:
            # phrases end where the last anchor begins: its gram may differ between equal chains
            end = np.searchsorted(self.at, self.at[1:] - 1 + length, side="left")
            ok = (end < n) & (self.of[np.minimum(end, n - 1)] == self.of[:-1]) & (self.of[1:] == self.of[:-1])
            out[:-1] = np.where(ok, end - np.arange(n - 1), 0)
        return out

    def least_inside(self, length: int) -> np.ndarray:
        """For each anchor the phrases inside any window whose first anchor it is, at least; huge if there is none."""
        if not len(self.at):
            return np.zeros(0, np.int64)
        start = np.where(self.number == 0, self.start[self.of], np.concatenate(([0], self.at[:-1])) + 1)
        last = np.searchsorted(self.at, start + length - GRAM, side="right") - 1
        return np.where(start + length <= self.end[self.of], np.maximum(last - np.arange(len(self.at)), RUN), 1 << 30)

    def counts(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every place with a whole buffer window after it: anchors up to it, before it, up to its last gram."""
        n = len(self.data) - length + 1
        is_anchor = np.zeros(len(self.data), np.int32)
        is_anchor[self.at] = 1
        so_far = np.cumsum(is_anchor, dtype=np.int32)
        return so_far[:n], so_far[:n] - is_anchor[:n], so_far[length - GRAM:length - GRAM + n]

    def bare(self, length: int) -> list[tuple[int, np.ndarray]]:
        """Texts with windows of fewer than ``RUN`` phrases, which no rank can judge, and where these start."""
        if len(self.data) < length:
            return []
        _, first, last = self.counts(length)
        x = np.flatnonzero(last - first - 1 < RUN)
        of = np.searchsorted(self.end, x, side="right")
        ok = x + length <= self.end[of] if len(x) else np.zeros(0, bool)
        x, of = x[ok], of[ok]
        cut = np.flatnonzero(np.diff(of)) + 1
        return [(int(of[a]), x[a:b] - self.start[of[a]]) for a, b in zip([0, *cut], [*cut, len(x)]) if b > a]


def _powers(n: int, base: np.uint64 = _MULT | np.uint64(1)) -> np.ndarray:
    p = np.full(n + 1, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def _combine(parts: list[np.ndarray], seed: np.uint64 = _MULT) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = mix64(out * seed + p)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _scan(docs: DataFrame, length: int) -> DataFrame:
    """Every phrase with its fingerprint (kind 0), and what windows without ``RUN`` phrases give (kinds 1 and 2).

    kind 0: i the anchor, m its reach, least as ``least_inside``; kind 1: a
    window at i with its hash; kind 2: bytes i to m that repeat inside the text.
    """
    def run(batches):
        for batch in batches:
            texts = utf8(batch.column(2))
            for a, b in slices([len(t) for t in texts]):
                t = Text(texts[a:b])
                here, rank = t.phrases()
                parts = [(t.of[here] + a, 0, rank, np.zeros(len(here), np.uint64), t.number[here],
                          t.reach(length)[here], t.least_inside(length)[here])]
                for r, x in t.bare(length):
                    parts += _rows(r + a, *_decide(texts[r + a], np.zeros(len(texts[r + a]) - length + 1, bool), x, length), length)
                yield _pack(batch, parts)

    return docs.mapInArrow(run, f"rank bigint, second bigint, kind int, i int, m int, least int, sure boolean, "
                                f"key {sql_type(docs, 'key')}, th bigint")


def _rows(r: int, spans: np.ndarray, x: np.ndarray, one: np.ndarray, two: np.ndarray, length: int) -> list[tuple]:
    """Parts of ``_pack``: windows of text r (kind 1), and spans (kind 2) with keys of no meaning."""
    mixed = mix64(spans[:, 0].astype(np.uint64) + (np.uint64(r + 1) << np.uint64(40)))
    return [(np.full(len(x), r), 1, one, two, x, x + length, np.zeros(len(x), np.int64)),
            (np.full(len(spans), r), 2, mixed, mix64(mixed), spans[:, 0], spans[:, 1], np.zeros(len(spans), np.int64))]


def _pack(batch, parts) -> pa.RecordBatch:
    own = pa.array(np.concatenate([p[0] for p in parts]))
    kind = np.repeat([p[1] for p in parts], [len(p[2]) for p in parts])
    rank, second, i, m, least = (np.concatenate([p[c] for p in parts]) for c in range(2, 7))
    return pa.RecordBatch.from_arrays(
        [pa.array(_signed(rank)), pa.array(_signed(second)), pa.array(kind, pa.int32()), pa.array(i, pa.int32()),
         pa.array(m, pa.int32()), pa.array(np.minimum(least, 1 << 30), pa.int32()), pa.array(kind == 2),
         batch.column(0).take(own), batch.column(1).take(own)],
        names=["rank", "second", "kind", "i", "m", "least", "sure", "key", "th"])


def _by_text(rows: DataFrame, *fields: str) -> DataFrame:
    """(key, th, at): one row per text, with its anchors in order."""
    return rows.groupBy("key", "th").agg(F.sort_array(F.collect_list(F.struct("i", *fields))).alias("at"))


class _Anchors:
    """The anchors of a batch of texts as flat arrays; ``at`` orders them by text and number."""

    def __init__(self, batch: pa.RecordBatch, fields: list[str]):
        lists = batch.column(2)
        values = lists.flatten()
        self.batch = batch
        self.text = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        self.f = {n: values.field(n).to_numpy(zero_copy_only=False) for n in ("i", *fields)}
        self.at = self.text << 32 | self.f["i"].astype(np.int64)

    def take(self, rows: np.ndarray) -> None:
        self.text, self.at = self.text[rows], self.at[rows]
        self.f = {n: v[rows] for n, v in self.f.items()}

    def once(self) -> np.ndarray:
        """Drop repeats of an anchor (the same row stands in the table twice); tells which texts had some."""
        again = np.concatenate(([False], self.at[1:] == self.at[:-1]))
        many = np.zeros(self.batch.num_rows, bool)
        many[self.text[again]] = True
        self.take(np.flatnonzero(~again))
        return many

    def find(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(self.at, at), max(0, len(self.at) - 1))
        return place, self.at[place] == at if len(self.at) else np.zeros(len(at), bool)

    def rows(self, rows: np.ndarray, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        own = pa.array(self.text[rows])
        out = columns | {"key": self.batch.column(0).take(own), "th": self.batch.column(1).take(own),
                         "i": pa.array(self.f["i"][rows], pa.int32())}
        return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def _hopeful(a: _Anchors, run: int) -> np.ndarray:
    """Rows of stretches of anchors long enough, somewhere, to hold the inside of a window."""
    n = len(a.at)
    if not n:
        return np.zeros(0, np.int64)
    new = np.concatenate(([True], a.at[1:] != a.at[:-1] + 1))
    stretch = np.cumsum(new) - 1
    end = np.concatenate((np.flatnonzero(new)[1:], [n]))
    enough = end[stretch] - np.arange(n) >= a.f["least"] - run + 1
    return np.flatnonzero(np.bincount(stretch, enough)[stretch] > 0)


def _longer(texts: DataFrame) -> DataFrame:
    """Ranks of runs of ``RUN`` phrases, from the ranks of their phrases."""
    def run(batches):
        for batch in batches:
            a = _Anchors(batch, ["rank", "m", "least"])
            many = a.once()
            a.take(_hopeful(a, 1))
            rank = a.f["rank"].view(np.uint64)
            place, ok = a.find(a.at + (RUN - 1))  # anchors are distinct and in order: the run is whole if its last one
            here = np.flatnonzero(ok & (place - np.arange(len(place)) == RUN - 1))  # stands RUN - 1 places on
            yield a.rows(here, {"rank": pa.array(_signed(_combine([rank[here + j] for j in range(RUN)]))),
                                "m": pa.array(a.f["m"][here], pa.int32()), "least": pa.array(a.f["least"][here], pa.int32()),
                                "many": pa.array(many[a.text[here]])})

    return texts.mapInArrow(run, f"rank bigint, m int, least int, many boolean, key {sql_type(texts, 'key')}, th bigint, i int")


def _reaching(texts: DataFrame) -> DataFrame:
    """Runs (rank, 0), and ranks of the chains that reach the threshold: runs one after another, the last overlapping.

    ``pass`` marks rows that stay without an equal: runs, and rows of a
    text that stands in the table more than once.
    """
    def run(batches):
        for batch in batches:
            a = _Anchors(batch, ["rank", "m", "least", "many"])
            flag = np.zeros(batch.num_rows, bool)
            flag[a.text[a.f["many"]]] = True
            many = a.once() | flag
            a.take(_hopeful(a, RUN))
            rank, m = a.f["rank"].view(np.uint64), a.f["m"]
            n = len(rank)
            found, one, two = [np.arange(n)], [rank], [np.zeros(n, np.uint64)]
            for size in np.unique(m[m >= RUN]):
                here = np.flatnonzero(m == size)
                parts = []
                for step in [*range(0, size - RUN, RUN), size - RUN]:
                    place, ok = a.find(a.at[here] + step)
                    here, parts = here[ok], [p[ok] for p in parts] + [place[ok]]
                end = [np.full(len(here), size, np.uint64)]
                found.append(here)
                one.append(_combine([rank[p] for p in parts] + end))
                two.append(_combine([rank[p] for p in parts] + end, _SEED2))
            here = np.concatenate(found)
            chain = np.arange(len(here)) >= n
            yield a.rows(here, {"r1": pa.array(_signed(np.concatenate(one))), "r2": pa.array(_signed(np.concatenate(two))),
                                "chain": pa.array(chain), "pass": pa.array(~chain | many[a.text[here]])})

    return texts.mapInArrow(run, f"r1 bigint, r2 bigint, chain boolean, pass boolean, key {sql_type(texts, 'key')}, th bigint, i int")


def _hash_tables(seed: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte codes, powers of an odd base, powers of its inverse."""
    odd = seed | np.uint64(1)
    return (mix64(_BYTE_CODE * seed), _powers(2 * _BLOCK, odd),
            _powers(2 * _BLOCK, np.uint64(pow(int(odd), -1, 1 << 64))))


_HASH1, _HASH2 = _hash_tables(_MULT), _hash_tables(_SEED2)


def window_hashes(data: bytes, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the ``length`` bytes at each place (places ascending)."""
    b = np.frombuffer(data, dtype=np.uint8)
    one, two = np.zeros(len(places), np.uint64), np.zeros(len(places), np.uint64)
    if not len(places):
        return one, two
    # runs of near places share one table of running sums
    cut = np.flatnonzero((np.diff(places) > length) | (np.diff(places // _BLOCK) > 0)) + 1
    for start, end in zip([0, *cut], [*cut, len(places)]):
        low = int(places[start])
        piece = b[low:int(places[end - 1]) + length]
        at = places[start:end] - low
        for out, codes, powers, back in ((one, *_HASH1), (two, *_HASH2)):
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(codes[piece] * powers[:len(piece)], out=total[1:])
            # bring every window to the same power (an odd base has an inverse)
            out[start:end] = mix64((total[at + length] - total[at]) * back[at])
    return one, two


def _asked(texts: DataFrame) -> DataFrame:
    """Runs, and whether a window that starts at or before them may be left to hashing."""
    def run(batches):
        for batch in batches:
            a = _Anchors(batch, ["chain", "r1"])
            chains = a.at[a.f["chain"]]
            a.take(np.flatnonzero(~a.f["chain"]))
            a.once()
            left = ~(np.isin(a.at, chains) & np.isin(a.at - 1, chains) & (a.f["i"] > 0))
            yield a.rows(np.arange(len(left)), {"rank": pa.array(a.f["r1"]), "open": pa.array(left)})

    return texts.mapInArrow(run, f"rank bigint, open boolean, key {sql_type(texts, 'key')}, th bigint, i int")


def _wanted(asked: DataFrame) -> DataFrame:
    """Rows of runs of which one place at least is open: those stand first in their run's sorted rows."""
    def run(batches):
        held = (None, False)
        for batch in batches:
            if not batch.num_rows:
                continue
            rank = batch.column(0).to_numpy()
            is_open = batch.column(1).to_numpy(zero_copy_only=False)
            new = np.concatenate(([rank[0] != held[0]], rank[1:] != rank[:-1]))
            start = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            keep = np.where(start >= 0, is_open[np.maximum(start, 0)], held[1])
            held = (rank[-1], bool(keep[-1]))
            yield batch.filter(pa.array(keep)).select(["key", "th", "i"])

    return (asked.repartition("rank").sortWithinPartitions("rank", F.col("open").desc())
            .mapInArrow(run, f"key {sql_type(asked, 'key')}, th bigint, i int"))


def windows(data: bytes, runs: np.ndarray, chains: np.ndarray, wanted: np.ndarray, leading: np.ndarray,
            length: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts that repeat for sure (mask), and places to hash: those left open and those others may equal.

    ``runs``, ``chains`` and ``wanted``: numbers of the anchors whose run of
    ``RUN`` phrases repeats, whose chain repeats, whose run is asked for;
    ``leading``: those of ``chains`` that answer for their equals (all
    windows that start before the next anchor are equal with the chain).
    Windows with fewer phrases are left out; equals of theirs have as few.
    """
    if len(data) < length:
        return np.zeros(0, bool), np.zeros(0, np.int64)
    t = Text([data])
    block, first, last = t.counts(length)  # block: 1 + the anchor at or before
    last = last - 1

    def flags(numbers: np.ndarray, shift: int = 0) -> np.ndarray:
        mask = np.zeros(len(t.at) + 2, bool)
        mask[numbers + shift] = True
        return mask

    sure = flags(chains, 1)[block]
    unique = np.concatenate(([0], np.cumsum(~flags(runs))))
    maybe = unique[np.maximum(first, last - RUN + 1)] == unique[first]
    hashed = (last - first >= RUN) & np.where(sure, flags(wanted)[first] & flags(leading, 1)[block], maybe)
    return sure, np.flatnonzero(hashed)


def _covered(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:-1]) > 0


def _spans(mask: np.ndarray) -> np.ndarray:
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)


def _decide(data: bytes, sure: np.ndarray, x: np.ndarray, length: int) -> tuple:
    """Spans of windows that repeat for sure, and the windows (place, hashes) to be compared with other texts."""
    one, two = window_hashes(data, x, length)
    # windows that repeat inside the text are sure; each hash is handed on once
    order = np.lexsort((x, two, one))
    new = np.ones(len(x), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    group = np.cumsum(new) - 1
    inside = np.bincount(group, minlength=1)[group] > 1
    spans = _spans(_covered(np.concatenate((np.flatnonzero(sure), x[order][inside])), len(data), length))
    first = order[new]
    return spans, x[first], one[first], two[first]


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, th, spans): the byte spans of each text that a repeated string of ``length`` bytes covers.

    ``th`` is ``xxhash64`` of the text: together with the key it names a
    row. Texts with nothing to remove have no row. Rows equal in key and
    text are repeats of one another.
    """
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    source = docs.select(docs[key].alias("key"), F.xxhash64(body).alias("th"), body.alias("text"))
    long = source.where(F.octet_length("text") >= length)
    single = stored(repeated(_scan(long, length), ["rank", "second"], "sure").drop("sure", "second"), "phrases")
    runs = repeated(_longer(_by_text(single.where("kind = 0"), "rank", "m", "least")), ["rank"], "many")
    places = stored(repeated(_reaching(_by_text(runs, "rank", "m", "least", "many")), ["r1", "r2"], "pass", "leads")
                    .drop("r2", "pass"), "places")
    wanted = _wanted(_asked(_by_text(places, "chain", "r1")))
    levels = (places.select("key", "th", "i", F.when(~F.col("chain"), 0).when(F.col("leads"), 3).otherwise(1).alias("level"))
              .unionAll(wanted.select("key", "th", "i", F.lit(2))))
    marks = stored(levels.groupBy("key", "th").agg(*[
        F.collect_set(F.when(F.col("level") == k, F.col("i"))).alias(f"l{k}") for k in range(4)]), "marks")

    def run(batches):
        for batch in batches:
            texts = utf8(batch.column(2))
            lists = [batch.column(3 + j) for j in range(4)]
            for a, b in slices([len(t) for t in texts], 1 << 22):
                parts = []
                for r in range(a, b):
                    found = [x[r].values.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
                    chains = np.concatenate((found[1], found[3]))
                    sure, x = windows(texts[r], found[0], chains, found[2], found[3], length)
                    if len(x) or sure.any():
                        parts += _rows(r, *_decide(texts[r], sure, x, length), length)
                if parts:
                    yield _pack(batch, parts).drop_columns(["least"])

    hashed = _with_marks(long, marks).mapInArrow(
        run, f"rank bigint, second bigint, kind int, i int, m int, sure boolean, key {sql_type(source, 'key')}, th bigint")
    covered = (single.where("kind > 0").select("key", "th", "i", "m")
               .unionAll(repeated(hashed, ["rank", "second"], "sure").select("key", "th", "i", "m")))
    return covered.groupBy("key", "th").agg(F.sort_array(F.collect_set(
        F.struct(F.col("i").cast("long").alias("start"), F.col("m").cast("long").alias("end")))).alias("spans"))


def _with_marks(long: DataFrame, marks: DataFrame) -> DataFrame:
    """Texts that have marks, with them; a bitmap of fixed size keeps all others out of the shuffle."""
    shipped = long.sparkSession.sparkContext.broadcast(bitmap(marks, "key", "th"))
    hit = filter_texts(long, [slot(long["key"], long["th"])], lambda: lambda c: in_bitmap(shipped.value, c[0]))
    left, right = hit.alias("x"), marks.alias("y")
    on = F.col("x.key").eqNullSafe(F.col("y.key")) & (F.col("x.th") == F.col("y.th"))
    return left.join(right, on).select(F.col("x.key").alias("key"), F.col("x.th").alias("th"), "text", "l0", "l1", "l2", "l3")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, n_removed, spans, kept) of every row: what is left of its bytes when repeats are cut out.

    Null text is empty. Texts under ``length`` bytes stay whole. Rows
    without repeats pass by the join, so only texts that lose bytes are
    shuffled.
    """
    found = stored(repeats(docs, key, text, length), "spans")
    shipped = docs.sparkSession.sparkContext.broadcast(bitmap(found, "key", "th"))
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    source = docs.select(docs[key].alias("key"), F.xxhash64(body).alias("th"), body.alias("text"))
    key_type = sql_type(source, "key")
    out = f"key {key_type}, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for batch in batches:
            removed, spans, kept = [], [], []
            texts = utf8(batch.column(1))
            for data, given in zip(texts, batch.column(2).to_pylist()):
                runs: list[dict] = []  # spans come in order of start
                for s in given or ():
                    if runs and s["start"] <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], s["end"])
                    else:
                        runs.append(dict(s))
                spans.append(runs)
                removed.append(sum(s["end"] - s["start"] for s in runs))
                edges = [0, *(x for s in runs for x in (s["start"], s["end"])), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])) if runs else data)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, kind), pa.array(kept, pa.binary())], names=["key", "n_bytes", "n_removed", "spans", "kept"])

    def whole(batches):
        """Rows that no span can belong to, as they are."""
        for batch in batches:
            rest = batch.filter(pa.array(~in_bitmap(shipped.value, batch.column(2))))
            texts = rest.column(1).cast(pa.binary())
            n = rest.num_rows
            yield pa.RecordBatch.from_arrays(
                [rest.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(np.zeros(n, np.int64)),
                 pa.array([[]] * n, kind), texts], names=["key", "n_bytes", "n_removed", "spans", "kept"])

    at = slot(source["key"], source["th"])
    hit = filter_texts(source, [at], lambda: lambda c: in_bitmap(shipped.value, c[0]))
    left, right = hit.alias("x"), found.alias("y")
    on = F.col("x.key").eqNullSafe(F.col("y.key")) & (F.col("x.th") == F.col("y.th"))
    joined = left.join(right, on, "left").select(F.col("x.key").alias("key"), "text", "spans")
    return (source.select("key", "text", at.alias("slot")).mapInArrow(whole, out)
            .unionAll(joined.mapInArrow(cut, out)).withColumnRenamed("key", key))
