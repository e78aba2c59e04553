"""Shared helpers: tables in the cluster's shared folder, Arrow text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: bytes of text handled at once inside a task (working arrays are about 60 times as large)
SLICE_BYTES = 1 << 20
#: texts, or pairs of sets, that a Python task is handed at once
TEXT_ROWS, PAIR_ROWS = 1000, 500


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of its own only where that is unset in a local session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="llm-shared-", dir="/tmp")
    return _OWN[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python tasks of what runs within get at most ``rows`` rows at a time.

    For wide rows: Spark holds each batch outside the heap, in buffers that double as they grow,
    so that one of 10,000 texts or sets takes a hundred MB and more a task.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored``, once what reads it is itself stored."""
    spark = df.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent()
    if not folder.getName().startswith("llm-"):
        raise ValueError(f"{folder} holds no stored table")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores before it as it takes to be no column of ``df`` (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def sql_type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null counts as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Cut rows 0..n into runs of about ``most`` bytes each (a longer row stands alone)."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


_KEPT: dict = {}


def kept(key, make: Callable[[], object]):
    """What a Python worker keeps from task to task under ``key``, made when missing; what it kept under another goes first."""
    if key not in _KEPT:
        released()
        _KEPT[key] = make()
    return _KEPT[key]


def released() -> None:
    """Drop what the tasks of other operators left in this Python worker (workers live on from query to query)."""
    _KEPT.clear()


def map_texts(
    df: DataFrame,
    keep: list[str],
    text: str,
    make: Callable[[], Callable[[list[bytes]], dict[str, list]]],
    out: str,
) -> DataFrame:
    """Per-row results of a text column, beside the columns named in ``keep``.

    ``make()`` runs once per task and returns a function from a list of
    UTF-8 texts to the result columns. ``out`` is their DDL. Only the
    needed columns leave the scan, so other columns of ``df`` cannot clash.
    """
    kept = [df[c].alias(f"__k{i}") for i, c in enumerate(keep)]
    source = df.select(*kept, df[text].cast("string").alias("__text"))
    ddl = ", ".join(f"__k{i} {sql_type(df, c)}" for i, c in enumerate(keep))
    schema = f"{ddl}, {out}" if keep else out
    fields = [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(out)]
    names = [n for n, _ in fields]
    n_keep = len(keep)

    def run(batches):
        work = make()
        for batch in batches:
            texts = batch.column(n_keep).cast(pa.binary())
            for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                cols = work(utf8(texts.slice(a, b - a)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(a, b - a) for i in range(n_keep)]
                    + [pa.array(cols[n], type=t) for n, t in fields],
                    names=[f"__k{i}" for i in range(n_keep)] + names)

    result = source.mapInArrow(run, schema)
    return result.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], *names)


def filter_texts(df: DataFrame, columns: list, make: Callable[[], Callable[[list[pa.Array]], np.ndarray]]) -> DataFrame:
    """Rows of ``df``, with all its columns, for which a function of the Arrow arrays of ``columns`` is true.

    ``columns`` holds expressions, or the places of columns of ``df``: those are read where they
    stand and not sent twice. About a slice of the rows is judged and handed back at a time.
    """
    names = df.columns
    plain = [f"c{i}" for i in range(len(names))]
    extra = [c for c in columns if not isinstance(c, int)]
    place = iter(range(len(plain), len(plain) + len(extra)))
    read = [c if isinstance(c, int) else next(place) for c in columns]
    source = df.select(*[df[n].alias(p) for n, p in zip(names, plain)], *[c.alias(f"x{i}") for i, c in enumerate(extra)])
    schema = source.select(*plain).schema

    def run(batches):
        keep = make()
        for batch in batches:
            step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                mask = keep([part.column(i) for i in read])
                yield part.select(plain).filter(pa.array(mask, pa.bool_()))

    return source.mapInArrow(run, schema).toDF(*names)


#: bits of the bitmaps by which a scan skips rows that a later join has no use for (1 MB, whatever the input)
FILTER_BITS = 23


def slot(*cols):
    return F.pmod(F.xxhash64(*cols), F.lit(1 << FILTER_BITS))


def bitmap(df: DataFrame, *cols: str) -> np.ndarray:
    """Bitmap of the slots that the keys of ``df`` fall into; at most 256 rows of 4 kB reach the driver."""
    place = slot(*[F.col(c) for c in cols]) + 1
    pages = (df.groupBy(F.bitmap_bucket_number(place).alias("page"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect())
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in pages:
        out[(r["page"] - 1) * 4096:r["page"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_bitmap(bits: np.ndarray, slots: pa.Array) -> np.ndarray:
    at = slots.to_numpy().astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def repeated(df: DataFrame, key: list[str], always: str | None = None, first: str | None = None) -> DataFrame:
    """Rows whose ``key`` (numbers, none null) occurs more than once, or where ``always`` is true.

    ``first`` adds a column that is true for one row of each key.

    Rows are dealt by the key and sorted by its first number alone (one
    number Spark sorts by its digits). A task reads them as a stream and
    keeps in hand the last row of each key with the last first number: one,
    or a few where hashes collide in it. So no run is ever gathered.
    """
    places = [df.columns.index(c) for c in key]
    flag = None if always is None else df.columns.index(always)

    def run(batches):
        held, last = {}, None  # key: its last row, or None if that was given
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in places]
            same = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
            if ((columns[0][1:] == columns[0][:-1]) & ~same).any():
                order = np.lexsort(columns[::-1])
                batch, columns = batch.take(pa.array(order)), [c[order] for c in columns]
                same = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
            keep = (np.zeros(batch.num_rows, bool) if flag is None
                    else batch.column(flag).to_numpy(zero_copy_only=False).astype(bool))
            keep[1:] |= same
            keep[:-1] |= same
            new = np.concatenate(([True], ~same))
            start = np.flatnonzero(new)
            if columns[0][0] == last:
                for s in start[start < np.searchsorted(columns[0], last, side="right")]:
                    k = tuple(c[s] for c in columns)
                    if k in held:
                        keep[s], new[s] = True, False
                        if held[k] is not None:
                            yield held[k]
                            held[k] = None
            if first is not None:
                batch = batch.append_column(first, pa.array(new))
            yield batch.filter(pa.array(keep))
            if columns[0][-1] != last:
                held, last = {}, columns[0][-1]
            ends = np.append(start[1:], batch.num_rows) - 1
            for e in ends[ends >= np.searchsorted(columns[0], last)]:
                held[tuple(c[e] for c in columns)] = None if keep[e] else batch.slice(e, 1)

    schema = df.schema if first is None else StructType(df.schema.fields).add(first, "boolean")
    return df.repartition(*key).sortWithinPartitions(key[0]).mapInArrow(run, schema)


# ---------------------------------------------------------------- words as arrays

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * _MULT)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of several texts as arrays.

    ``starts``/``ends`` are byte places in ``data``; ``doc`` is the text
    of each word; ``count`` the number of words per text; ``hash`` a
    64-bit fingerprint of each word.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b" ".join(texts) + b" "
        if lower:
            joined = joined.translate(_LOWER)
        self.raw = joined
        self.n_docs = len(texts)
        self.data = np.frombuffer(joined, dtype=np.uint8)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.doc_start = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if texts else np.zeros(0, np.int64)
        self.doc_end = self.doc_start + sizes
        inside = ~_WHITE[self.data]
        edge = np.diff(np.concatenate(([0], inside.view(np.int8))))
        self.inside = inside
        self.starts = np.flatnonzero(edge == 1)
        self.ends = np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(self.doc_start, self.starts, side="right") - 1
        self.count = np.bincount(self.doc, minlength=self.n_docs)

    @property
    def hash(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        length = self.ends - self.starts
        power = np.full(int(length.max()) + 1, _MULT | np.uint64(1), dtype=np.uint64)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        place = np.flatnonzero(self.inside)
        within = place - np.repeat(self.starts, length)
        value = _BYTE_CODE[self.data[place]] * power[within]
        first = np.concatenate(([0], np.cumsum(length)[:-1]))
        return mix64(np.add.reduceat(value, first) + length.astype(np.uint64))

    def windows(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First word and fingerprint of every run of ``k`` words inside one text."""
        h = self.hash if hashes is None else hashes
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        out = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            out = mix64(out * _MULT + h[j:j + n])
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1:])
        return at, out[at]
