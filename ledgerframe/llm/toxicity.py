"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme values.

A token is a word or one of its short prefixes (stems carry the meaning
where endings vary). Its weight is the log-odds of its occurrences in
documents labelled toxic against clean ones under a Dirichlet prior drawn
from the whole corpus, kept when documents that hold it, or hold it twice,
are toxic beyond a false-discovery bar. Over a text,
words carry the weight of their best token and all others a small cost;
one linear scan finds every maximal scoring segment. A segment of score S
in n words is expected K n exp(-lambda S) times by chance, lambda from the
clean documents' own rates; the summed excess of the significant segments
gives the document's score through the Gumbel distribution.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import TEXT_ROWS, filter_texts, map_texts, released, slices, small_batches, stored, utf8

#: labelled rows the weights are learned from, at most (those with the smallest key hashes)
SAMPLE_ROWS = 50_000
PREFIXES = (4, 5)
#: documents that the corpus prior counts for, and a floor for unseen tokens
PRIOR_DOCS, PRIOR_FLOOR = 10.0, 0.5
#: share of the tokens that pass which may have passed by chance
FALSE_SHARE = 0.3
MIN_ODDS = 2.5
MIN_DOCS = 3
THRESHOLD = 0.7
#: distinct words counted before a task hands its counts on; words whose weight a worker remembers
FLUSH_TOKENS, KEPT_WORDS = 100_000, 150_000

_WORD = re.compile(r"[^\W\d_]+")


def tokens(word: str) -> set[str]:
    """The word and its prefixes; a prefix is marked so that it is no word."""
    return {word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)}


def bodies(column: pa.Array) -> Iterator[bytes]:
    """The texts of a batch in order (null: empty); about a slice of them is held as Python objects at a time."""
    column = column.cast(pa.binary())
    for a, b in slices(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        yield from utf8(column.slice(a, b - a))


def words_of(text: bytes) -> list[str]:
    return _WORD.findall(text.decode("utf-8", "replace").lower())


@dataclass
class Model:
    weight: dict[str, float] = field(default_factory=dict)
    cost: float = 0.05
    rate: float = 1.0  # lambda

    def __post_init__(self):
        self._known: dict[str, float] = {}

    def of(self, word: str) -> float:
        return max((self.weight.get(t, 0.0) for t in tokens(word)), default=0.0)

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """All maximal scoring segments (first word, last word, score), in one scan."""
        known = self._known
        if len(known) >= KEPT_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.of(w)
        hits = [(i, s) for i, s in enumerate(map(known.__getitem__, words)) if s > 0]
        # open candidates: (first, last, total before it, total up to its end)
        stack: list[tuple[int, int, float, float]] = []
        nearest: list[int] = []  # for each candidate the last one that began lower, or -1
        done = 0.0
        for n, (i, s) in enumerate(hits):
            before = done - self.cost * (i - n)
            candidate, done = (i, i, before, before + s), done + s
            while True:
                j = len(stack) - 1
                while j >= 0 and stack[j][2] >= candidate[2]:
                    j = nearest[j]
                if j < 0 or stack[j][3] >= candidate[3]:
                    stack.append(candidate)
                    nearest.append(j)
                    break
                candidate = (stack[j][0], candidate[1], stack[j][2], candidate[3])
                del stack[j:], nearest[j:]
        return [(a, b, right - left) for a, b, left, right in stack]

    def score(self, words: list[str]) -> tuple[float, list[tuple[int, int, float]]]:
        """Score in 0 to 1 and the significant segments (those expected less than once by chance)."""
        found = self.segments(words)
        if not found:
            return 0.0, []
        chance = math.log(len(words))
        excess = sorted((self.rate * s - chance for _, _, s in found), reverse=True)
        total = excess[0] + sum(x for x in excess[1:] if x > 0)
        significant = [x for x in found if self.rate * x[2] > chance]
        return math.exp(-math.exp(-max(total, -30.0))), significant


def _solve_rate(positive: list[tuple[float, float]], cost: float) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1 over word scores of clean text (bisection)."""
    rest = 1 - sum(p for p, _ in positive)

    def value(x: float) -> float:
        return sum(p * math.exp(min(x * s, 700.0)) for p, s in positive) + rest * math.exp(-x * cost) - 1

    low, high = 1e-6, 1e-6
    while value(high) <= 0 and high < 1e4:
        low, high = high, high * 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) <= 0 else (low, middle)
    return low


def _labelled(docs: DataFrame, chosen: DataFrame, key: str, text: str) -> DataFrame:
    """(label, body) of the documents named in ``chosen``, which is bounded by the sample."""
    return docs.select(docs[key].alias("__doc"), docs[text].cast("string").alias("__body")).join(
        F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("__label", "__body")


_COUNTS = ("n1", "n0", "t1", "t0", "c1", "c0", "g1", "g0")


def damped(n: int) -> int:
    return round(1000 * math.log2(1 + n))


def _count(labelled: DataFrame) -> DataFrame:
    """Per token and label: documents that hold it (n), that hold it twice or more (t), occurrences (c), damped ones (g).

    Damped, c occurrences in one document count log2(1 + c) (in thousandths), so
    that one text full of a word does not outweigh many. The token ""
    carries the documents (n) and words (c, g) of each label.
    """

    def run(batches):
        released()
        counts: dict[str, list[int]] = {}

        def flush():
            rows = list(counts.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in rows], pa.string())] + [pa.array([c[i] for _, c in rows], pa.int64()) for i in range(len(_COUNTS))],
                names=["token", *_COUNTS])
            counts.clear()

        for batch in batches:
            for label, body in zip(batch.column(0).to_pylist(), bodies(batch.column(1))):
                side = 0 if label == 1 else 1
                words = Counter(words_of(body))
                here: Counter = Counter()
                for w, n in words.items():
                    for t in tokens(w):
                        here[t] += n
                for t, n in here.items():
                    c = counts.setdefault(t, [0] * len(_COUNTS))
                    c[side] += 1
                    c[2 + side] += n > 1
                    c[4 + side] += n
                    c[6 + side] += damped(n)
                c = counts.setdefault("", [0] * len(_COUNTS))
                c[side] += 1
                c[4 + side] += words.total()
                c[6 + side] += sum(map(damped, words.values()))
                if len(counts) >= FLUSH_TOKENS:
                    yield from flush()
        yield from flush()

    partial = labelled.mapInArrow(run, "token string, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    return partial.groupBy("token").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _corpus(docs: DataFrame, text: str, names: set[str]) -> tuple[int, int, dict[str, int]]:
    """Documents and words of the whole corpus, and how often each named token occurs in it (one row a token)."""
    shipped = docs.sparkSession.sparkContext.broadcast(names)

    def run(batches):
        released()
        counts, known, documents, total = Counter(), {}, 0, 0
        for batch in batches:
            for body in bodies(batch.column(0)):
                words = Counter(words_of(body))
                documents, total = documents + 1, total + words.total()
                if len(known) >= KEPT_WORDS:
                    known.clear()
                for w, n in words.items():
                    hit = known.get(w)
                    if hit is None:
                        hit = known[w] = tuple(tokens(w) & shipped.value)
                    for t in hit:
                        counts[t] += n
        rows = [*counts.items(), ("", total), ("*", documents)]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["token", "n"])

    rows = docs.select(docs[text].cast("string")).mapInArrow(run, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()
    found = {r["token"]: r["n"] for r in rows}
    return found.pop("*", 0), found.pop("", 0), found


def _contexts(labelled: DataFrame, enough: dict[str, int]) -> dict[str, int]:
    """In how many different surroundings (word before, word after) the named tokens stand in texts labelled 1.

    Words of one text and its many copies keep their neighbours; words that
    carry a meaning of their own do not. A task that has found as many as
    are ``enough`` for a token needs no more of it, so counts below that
    are exact. One row a token reaches the driver.
    """
    shipped = labelled.sparkSession.sparkContext.broadcast(enough)

    def run(batches):
        released()
        wanted = shipped.value
        names = wanted.keys()
        seen: dict[str, set[str]] = {}
        for batch in batches:
            for body in bodies(batch.column(0)):
                words = ["", *words_of(body), ""]
                known = {w: hit for w in set(words) if w and (hit := tokens(w) & names)}
                for i, word in enumerate(words):
                    for t in known.get(word, ()):
                        here = seen.setdefault(t, set())
                        if len(here) < wanted[t]:
                            here.add(f"{words[i - 1]} {words[i + 1]}")
        rows = [(t, c) for t, found in seen.items() for c in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.string())], names=["token", "around"])

    rows = (labelled.where("__label = 1").select("__body").mapInArrow(run, "token string, around string")
            .distinct().groupBy("token").count().collect())
    return {r["token"]: r["count"] for r in rows}


def surprise(n1: int, n0: int, share: float) -> float:
    """Minus the log of the chance (at most) of n1 toxic documents or more among n1 + n0."""
    n = n1 + n0
    q = n1 / n if n else 0.0
    return n1 * math.log(q / share) + (n0 * math.log((1 - q) / (1 - share)) if n0 else 0.0) if q > share else 0.0


def least_surroundings(r, share: float, bar: float) -> int:
    """The smallest m with which min(n1, m) or min(t1, m) documents still surprise enough."""
    def meets(m: int) -> bool:
        n1, t1 = min(r["n1"], m), min(r["t1"], m)
        return max(surprise(n1, r["n0"], share) if n1 >= MIN_DOCS else 0.0, surprise(t1, r["t0"], share) if t1 >= MIN_DOCS else 0.0) - math.log(2) >= bar

    low, high = 1, max(r["n1"], r["t1"], 1)
    while low < high:  # surprise rises with m
        middle = (low + high) // 2
        low, high = (low, middle) if meets(middle) else (middle + 1, high)
    return low


def _surprise(n1: str, n0: str, share: float):
    a, b = F.col(n1).cast("double"), F.col(n0).cast("double")
    q = a / F.nullif(a + b, F.lit(0.0))
    value = a * F.log(q / share) + F.when(b > 0, b * F.log((1 - q) / (1 - share))).otherwise(0.0)
    return F.when(q > share, value).otherwise(0.0)


def _bar(spread: DataFrame, tried: int) -> float:
    """The surprise from which on a share of at most ``FALSE_SHARE`` of the tokens would be there by chance.

    Of ``tried`` tokens, ``tried * exp(-x)`` have a surprise of x by chance: the
    bar is the lowest x at which that is within the share of those that
    have it (counted in steps of a tenth, up to 60).
    """
    step = F.least(F.floor(F.col("surprise") * 10), F.lit(600)).cast("int")
    counts = {r["step"]: r["count"] for r in spread.groupBy(step.alias("step")).count().collect()}  # 601 rows at most
    bar, above = math.inf, 0
    for x in range(600, 0, -1):
        above += counts.get(x, 0)
        if above and tried * math.exp(-x / 10) <= FALSE_SHARE * above:
            bar = x / 10
    return bar


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn token weights from ``labels`` rows (at most ``sample_rows``) and the corpus prior from all ``docs``.

    A token must be in more toxic documents (or be in more of them twice)
    than chance allows, by a bar that holds the share of false ones among
    all that pass; and in as many different surroundings. Its weight is
    the log-odds of its damped occurrences. To the driver come the totals and the
    tokens that pass, all of them: they are tokens of at least ``MIN_DOCS``
    sampled documents, so the sample bounds their number and the broadcast.
    Null keys or labels teach nothing, a key labelled both ways counts as 1;
    without rows of both labels the model is empty and every score 0.
    """
    chosen = stored(labels.where(labels[key].isNotNull() & labels[label].isNotNull())
                    .groupBy(labels[key].alias("__id")).agg(F.max(labels[label].cast("int")).alias("__label"))
                    .orderBy(F.xxhash64("__id"), "__id").limit(sample_rows), "toxic-chosen")
    labelled = _labelled(docs, chosen, key, text)
    with small_batches(docs.sparkSession, TEXT_ROWS):
        spread = stored(_count(labelled).where((F.col("n1") >= MIN_DOCS) | (F.col("token") == "")), "toxic-tokens")
    totals = next(iter(spread.where("token = ''").collect()), None)
    if totals is None or not totals["n1"] or not totals["n0"]:
        return Model()
    share = totals["n1"] / (totals["n1"] + totals["n0"])
    # two tests a token, so each may take half the chance
    tested = spread.where("token != ''").withColumn(
        "surprise", F.greatest(_surprise("n1", "n0", share), F.when(F.col("t1") >= MIN_DOCS, _surprise("t1", "t0", share)).otherwise(0.0)) - math.log(2))
    bar = _bar(tested, tested.count())
    rows = tested.where(F.col("surprise") >= bar).collect() if bar < math.inf else []
    if not rows:
        return Model()
    with small_batches(docs.sparkSession, TEXT_ROWS):
        d, w, corpus = _corpus(docs, text, {r["token"] for r in rows})
    rest = PRIOR_DOCS * w / max(1, d)
    weight = {}
    for r in rows:
        prior = PRIOR_FLOOR + PRIOR_DOCS * corpus.get(r["token"], 0) / max(1, d)
        odds = (math.log((r["g1"] / 1000 + prior) / (totals["g1"] / 1000 + rest))
                - math.log((r["g0"] / 1000 + prior) / (totals["g0"] / 1000 + rest)))
        if odds >= MIN_ODDS:
            weight[r["token"]] = odds
    # the fewest surroundings with which a token would still meet the bar
    rows = [r for r in rows if r["token"] in weight]
    enough = {r["token"]: least_surroundings(r, share, bar) for r in rows}
    with small_batches(docs.sparkSession, TEXT_ROWS):
        around = _contexts(labelled, enough) if enough else {}
    rows = [r for r in rows if around.get(r["token"], 0) >= enough[r["token"]]]
    weight = {r["token"]: weight[r["token"]] for r in rows}
    hits = sum(r["c1"] for r in rows if not r["token"].endswith("*"))
    background = [(r["c0"] or 0.5, weight[r["token"]]) for r in rows]
    clean_words = max(1, totals["c0"])
    if not weight:
        return Model()
    cost = max(0.01, -math.log(1 - min(0.5, hits / max(1, totals["c1"]))))
    background = [((n if n >= 1 else n / len(weight)) / clean_words, odds) for n, odds in background]
    return Model(weight, cost, _solve_rate(background, cost))


def scored(docs: DataFrame, keep: list[str], text: str, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns with ``score``, ``predicted`` and the significant ``segments`` (in words) of every row.

    Null or empty text and text without known tokens score 0.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((model.weight, model.cost, model.rate))

    def make():
        released()
        learned = Model(*shipped.value)

        def work(texts):
            found = [learned.score(words_of(t)) for t in texts]
            return {"score": [s for s, _ in found], "predicted": [int(s >= threshold) for s, _ in found],
                    "segments": [[{"first": a, "last": b, "score": x} for a, b, x in g] for _, g in found]}
        return work

    return map_texts(docs, keep, text, make,
                     "score double, predicted int, segments array<struct<first:bigint,last:bigint,score:double>>")


def accepted(docs: DataFrame, text: str, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``scored`` predicts 0, with all their columns."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.weight, model.cost, model.rate))

    def make():
        released()
        learned = Model(*shipped.value)
        return lambda columns: [learned.score(words_of(t))[0] < threshold for t in bodies(columns[0])]

    name = docs.select(docs[text]).columns[0]
    plain = isinstance(docs.schema[name].dataType, StringType)
    return filter_texts(docs, [docs.columns.index(name) if plain else docs[text].cast("string")], make)
