"""Quality rules: boosted trees over document statistics, flattened into numpy node arrays.

Statistics of whole texts come from vectorised passes over slices of a
batch. The trees are grown here (logistic loss, histogram splits, newton
leaves) on a bounded sample of labelled rows; chosen features are
monotonic: a split that would let the score rise with them is refused,
and children stay on their side of the split's middle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, map_texts, mix64

#: labelled rows the trees are fitted on, at most (those with the smallest key hashes)
SAMPLE_ROWS = 20_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
THRESHOLD = 0.5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share",
            "digit_share", "upper_share", "mark_share", "bar_share", "line_words", "long_share", "stop_share"]
#: -1: the score never rises with the feature
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "bar_share": -1}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_UPPER = np.zeros(256, bool)
_UPPER[range(65, 91)] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_BAR = np.zeros(256, bool)
_BAR[ord("|")] = True


def _dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word; those of them equal to an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines), len(lines) - len(set(lines))


def statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """``COUNTS`` and ``FEATURES`` of every text; a text without words has zeros."""
    w = Words(texts)
    n = len(texts)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[w.doc_end] - total[w.doc_start]

    hashes = w.hash
    at, h = w.windows(3, hashes)
    repeat = np.zeros(n, np.int64)
    if len(at):
        _, which, times = np.unique(mix64(h + mix64(w.doc[at].astype(np.uint64))), return_inverse=True, return_counts=True)
        first = at[times[which] >= 2]
        step = np.zeros(len(w.starts) + 1, np.int64)
        np.add.at(step, first, 1)
        np.add.at(step, first + 3, -1)
        repeat = np.bincount(w.doc[np.cumsum(step[:-1]) > 0], minlength=n)
    distinct = np.zeros(n, np.int64)
    if len(hashes):
        order = np.lexsort((hashes, w.doc))
        sorted_doc, sorted_hash = w.doc[order], hashes[order]
        new = np.concatenate(([True], (sorted_doc[1:] != sorted_doc[:-1]) | (sorted_hash[1:] != sorted_hash[:-1])))
        distinct = np.bincount(sorted_doc[new], minlength=n)
    chars = per_doc(w.inside & ((w.data & 0xC0) != 0x80))
    lines = np.array([_dup_lines(t) for t in texts], dtype=np.int64).reshape(n, 2)
    words = w.count
    some, letters = np.maximum(words, 1), np.maximum(chars, 1)
    length = w.ends - w.starts
    out = {"n_words": words, "word_chars": chars, "n_symbols": per_doc(_SYMBOL[w.data]),
           "n_dup_lines": lines[:, 1], "n_repeat_words": repeat}
    out |= {"log_words": np.log1p(words), "word_length": chars / some, "symbol_share": out["n_symbols"] / letters,
            "dup_line_share": lines[:, 1] / np.maximum(lines[:, 0], 1), "repeat_share": repeat / some,
            "distinct_share": distinct / some, "digit_share": per_doc(_DIGIT[w.data]) / letters,
            "upper_share": per_doc(_UPPER[w.data]) / some, "mark_share": per_doc(_MARK[w.data]) / some,
            "bar_share": per_doc(_BAR[w.data]) / some, "line_words": words / np.maximum(lines[:, 0], 1),
            "long_share": np.bincount(w.doc[length > 12], minlength=n) / some,
            "stop_share": np.bincount(w.doc[length <= 3], minlength=n) / some}
    return out


# ---------------------------------------------------------------- trees


@dataclass
class Trees:
    """All trees in one set of node arrays; a leaf points to itself."""

    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    roots: list[int] = field(default_factory=list)
    start: float = 0.0
    depth: int = 0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; every step moves all rows one level down all at once."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root, dtype=np.int32)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], n_trees: int = 60, depth: int = 4,
        rate: float = 0.2, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Grow the trees. ``monotone``: -1, 0 or 1 for each feature."""
    if not len(y) or y.min() == y.max():
        return Trees(start=20.0 if not len(y) or y.min() == 1 else -20.0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    nodes: list[list] = []  # feature, cut, left, right, value
    start = float(np.log(y.mean() / (1 - y.mean())))
    total, roots = np.full(len(y), start), []

    def leaf_value(g: float, h: float, low: float, high: float) -> float:
        return min(max(-g / (h + ridge), low), high)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        nodes.append([0, np.inf, me, me, rate * leaf_value(gs, hs, low, high)])
        if level == 0 or len(rows) < 2 * least:
            total[rows] += nodes[me][4]
            return me
        best = None
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            size = len(c) + 1
            gl = np.cumsum(np.bincount(code[rows, j], g[rows], size))[:-1]
            hl = np.cumsum(np.bincount(code[rows, j], h[rows], size))[:-1]
            nl = np.cumsum(np.bincount(code[rows, j], minlength=size))[:-1]
            gain = gl ** 2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs ** 2 / (hs + ridge)
            vl = np.clip(-gl / (hl + ridge), low, high)
            vr = np.clip(-(gs - gl) / (hs - hl + ridge), low, high)
            allowed = (nl >= least) & (len(rows) - nl >= least) & (monotone[j] * (vr - vl) >= 0)
            gain = np.where(allowed, gain, -np.inf)
            k = int(gain.argmax())
            if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                best = (gain[k], j, k, float(vl[k]), float(vr[k]))
        if best is None:
            total[rows] += nodes[me][4]
            return me
        _, j, k, vl, vr = best
        go_left = code[rows, j] <= k
        middle = (vl + vr) / 2
        l_low, l_high, r_low, r_high = low, high, low, high
        if monotone[j] > 0:
            l_high, r_low = middle, middle
        elif monotone[j] < 0:
            l_low, r_high = middle, middle
        a = grow(rows[go_left], g, h, level - 1, l_low, l_high)
        b = grow(rows[~go_left], g, h, level - 1, r_low, r_high)
        nodes[me] = [j, float(cuts[j][k]), a, b, 0.0]
        return me

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-total))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth, -np.inf, np.inf))
    columns = list(zip(*nodes))
    return Trees(np.array(columns[0], np.int32), np.array(columns[1], float), np.array(columns[2], np.int32),
                 np.array(columns[3], np.int32), np.array(columns[4], float), roots, start, depth)


def _matrix(s: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([s[f] for f in FEATURES], axis=1).astype(float) if len(s["n_words"]) else np.zeros((0, len(FEATURES)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fit on at most ``sample_rows`` labelled keys; the statistics of one row each, and no texts, come to the driver.

    Rows with a null key or label teach nothing, a key labelled both ways counts as 1. Without labelled rows
    every text passes.
    """
    chosen = (labels.where(labels[key].isNotNull() & labels[label].isNotNull())
              .groupBy(labels[key].alias("__id")).agg(F.max(labels[label].cast("int")).alias("__label"))
              .orderBy(F.xxhash64("__id"), "__id").limit(sample_rows))
    # one row a key, the same in every run: of rows that share a key the one with the smallest text hash
    one = F.min(F.struct(F.xxhash64("__body").alias("hash"), "__body", "__label")).alias("one")
    joined = (docs.select(docs[key].alias("__doc"), docs[text].cast("string").alias("__body"))
              .join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).groupBy("__id").agg(one).select("one.__label", "one.__body"))

    def make():
        def work(texts):
            s = statistics(texts)
            return {"x": list(_matrix(s))}
        return work

    rows = map_texts(joined, ["__label"], "__body", make, "x array<double>").toPandas()
    y = rows["__label"].to_numpy(dtype=float)
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y))  # the fit does not depend on the order in which rows arrive
    return fit(x[order], y[order], [MONOTONE.get(f, 0) for f in FEATURES])


def judged(docs: DataFrame, keep: list[str], text: str, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns with the counts, ``base_failed``, ``score`` (likelihood of good) and ``kept``.

    Null or empty text has no words and fails the base rules.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        trees = shipped.value

        def work(texts):
            s = statistics(texts)
            score = trees.score(_matrix(s))
            failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])
            return {c: s[c] for c in COUNTS} | {
                "base_failed": failed, "score": score, "kept": ~failed & (score >= threshold)}
        return work

    ddl = ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"
    return map_texts(docs, keep, text, make, ddl)
