"""Fill-in-middle transformation: texts cut at unit ranks through an indexable skip list.

The units of a text (lines or code points) stand under express lanes: a link
of the lowest lane spans one unit, a link of every lane above spans ``FAN``
links of the lane below. Each link carries its width in units, in code points
and in bytes. A cut at unit rank r descends from the highest lane, taking
every link that does not pass r; the widths taken add up to the exact code
point and byte at which the text is cut. The order of the parts comes from
a hash of the key, so reruns and other partitionings give the same rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, sql_type, utf8

FAN = 8
SEED = 7
#: percent of texts transformed, and percent of those in suffix-first order
RATE, SPM_RATE = 100, 50
#: marks of prefix, suffix and middle; texts that hold one stay plain
MARKS = ("<P>", "<S>", "<M>")
UNITS = ("line", "char")
OUT = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


class SkipList:
    """Units in order under express lanes; ``widths`` holds one row a unit: (units, code points, bytes)."""

    def __init__(self, widths: np.ndarray):
        self.lanes = [widths]
        while len(self.lanes[-1]) > FAN:
            below = self.lanes[-1]
            self.lanes.append(np.add.reduceat(below, np.arange(0, len(below), FAN), axis=0))

    def reach(self, rank: int) -> tuple[int, int, int]:
        """Units, code points and bytes in front of the unit with this rank (the number of units: the whole text)."""
        units = chars = size = at = 0
        for lane in reversed(self.lanes):
            at *= FAN
            while at < len(lane) and units + lane[at, 0] <= rank:
                units, chars, size = units + int(lane[at, 0]), chars + int(lane[at, 1]), size + int(lane[at, 2])
                at += 1
        return units, chars, size


def unit_widths(text: bytes, unit: str = "line") -> np.ndarray:
    """(units, code points, bytes) of each unit; a line ends behind its line break, the last one at the end of the text."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.zeros((0, 3), np.int64)
    leads = (data & 0xC0) != 0x80  # every byte but those that continue a code point
    starts = np.concatenate(([0], np.flatnonzero(data[:-1] == 10) + 1)) if unit == "line" else np.flatnonzero(leads)
    chars = np.add.reduceat(leads.astype(np.int64), starts)
    return np.stack([np.ones(len(starts), np.int64), chars, np.diff(np.append(starts, len(data)))], axis=1)


def rearranged(text: bytes, draws: tuple[int, int, int, int], unit: str = "line", rate: int = RATE, spm_rate: int = SPM_RATE,
               marks: tuple[str, str, str] = MARKS) -> dict:
    """One text by its four draws: two cut ranks, whether it is transformed, and in which order."""
    widths = unit_widths(text, unit)
    n = len(widths)
    p, s, m = (x.encode() for x in marks)
    if not text or p in text or s in text or m in text or draws[2] % 100 >= rate:
        return {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": text}
    units = SkipList(widths)
    (_, first, a), (_, second, b) = (units.reach(r) for r in sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
    form = "spm" if draws[3] % 100 < spm_rate else "psm"
    parts = [s, text[b:], p, text[:a]] if form == "spm" else [p, text[:a], s, text[b:]]
    return {"n": n, "form": form, "prefix_chars": first, "middle_chars": second - first, "output": b"".join([*parts, m, text[a:b]])}


def transformed(docs: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", seed: int = SEED, unit: str = "line",
                rate: int = RATE, spm_rate: int = SPM_RATE, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``keep`` columns with n, form, prefix_chars, middle_chars (code points) and the output text of every row.

    Row by row, without a shuffle. A null or empty text is plain with no
    units. A null key draws as the empty word, equal keys draw alike (rows
    repeated stay repeated). Other columns, whatever their names, are left
    out; ``keep`` may not name a column of the result. An empty table gives
    an empty table. A task holds one slice of texts (1 MB, or one longer
    text) with 24 bytes a unit and a seventh of that in lanes.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    if len(set(marks)) < 3 or any(not x or x in y for x in marks for y in marks if x is not y) or any(
            x[-i:] == y[:i] for x in marks for y in marks for i in range(1, min(len(x), len(y)))):
        raise ValueError("marks must not hold or overlap one another")
    results = [x.split()[0] for x in OUT.split(", ")]
    if set(keep) & set(results):
        raise ValueError(f"keep may not name {results}")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[key].cast("string"), F.lit(""))).cast("binary"), 256)
    plain = [f"k{i}" for i in range(len(keep))]
    source = docs.select(*[docs[c].alias(p) for c, p in zip(keep, plain)], docs[text].cast("string").alias("t"), digest.alias("d"))
    width = len(keep)
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            texts, digests = utf8(batch.column(width)), batch.column(width + 1).to_pylist()
            for a, b in slices([len(t) for t in texts]):
                rows = [rearranged(t, tuple(int(d[i:i + 8], 16) for i in (0, 8, 16, 24)), unit, rate, spm_rate, marks)
                        for t, d in zip(texts[a:b], digests[a:b])]
                found = [pa.array([r[c] for r in rows], t) for c, t in zip(results, types)]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(width)]
                                                 + [*found[:-1], found[-1].cast(pa.string())], names=plain + results)

    ddl = ", ".join([*(f"{p} {sql_type(docs, c)}" for p, c in zip(plain, keep)), OUT])
    return source.mapInArrow(run, ddl).toDF(*keep, *results)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text behind an output and its form: no part holds a mark, so the marks alone tell the parts."""
    parts = F.split(output, "|".join(re.escape(x) for x in marks), -1)
    piece = lambda i: F.get(parts, F.lit(i))
    return (F.when(form == "psm", F.concat(piece(1), piece(3), piece(2)))
            .when(form == "spm", F.concat(piece(2), piece(3), piece(1))).otherwise(output))
