"""Line dedup: repeated runs of lines, by distributed prefix doubling over line ids. Built-in functions only.

Texts become rows of lines with an id (MD5 of the line). The rank of a
line is the first place that holds it; lines that stand nowhere else
leave. Round by round the ranks of a place and of the place 2^k lines on
are paired, pairs are ranked by their first place, and places whose pair
is unique leave. With these ranks any run of m lines is named by two
overlapping runs of the largest power of two within m.

A run is repeated from ``min_words`` words on. Every maximal repeated run
(an interval of the suffix array with that common prefix) is the union of
the shortest runs that reach the threshold from each of its lines on and
back to each of its lines, so only these two runs a line are compared,
and their later copies deleted. The first copy, by key and place, stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

MIN_WORDS = 50
_WORD = r"[^\x20\x09-\x0D]+"
PLACE = ("key", "th", "n")


def _text(docs: DataFrame, text: str) -> Column:
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, th, n, id, words) of every line with a word; n counts such lines."""
    rows = docs.select(docs[key].alias("key"), _text(docs, text).alias("text")).where(F.col("text") != "")
    numbered = rows.select("key", F.xxhash64("text").alias("th"), F.transform(
        F.split("text", "\n", -1), lambda line: F.struct(
            line.alias("line"), F.regexp_count(line, F.lit(_WORD)).alias("words"))).alias("lines"))
    some = numbered.select("key", "th", F.filter("lines", lambda x: x["words"] > 0).alias("lines"))
    return (some.select("key", "th", F.posexplode("lines").alias("n", "x"))
            .select("key", "th", "n", F.unhex(F.md5("x.line")).alias("id"),
                    F.col("x.words").alias("words")))


def _place(*names: str) -> Column:
    return F.struct(*[F.col(n) for n in names])


def _ranked(rows: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """Rows whose ``by`` stands at more than one place, with the first place as ``rank``.

    Counts are combined before the shuffle and the join is one that Spark
    splits when a line is very common.
    """
    firsts = stored(rows.groupBy(*by).agg(F.min(_place(*PLACE)).alias("rank"), F.max(_place(*PLACE)).alias("last"))
                    .where("rank < last").drop("last"), "line-ranks")
    return rows.join(firsts, by).select(*keep, "rank")


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, th, first, last): runs of lines, counted among those with a word, that are later copies.

    ``th`` is ``xxhash64`` of the text. Copies are ordered by key (nulls
    first), th and line; rows equal in key and text are one text.
    """
    doc = Window.partitionBy("key", "th")
    by_line = doc.orderBy("n")
    forward = doc.orderBy("start").rangeBetween(min_words, Window.unboundedFollowing)
    back = doc.orderBy("stop").rangeBetween(Window.unboundedPreceding, -min_words)
    # words up to a line; rows equal in key and text are peers in every line and count once
    so_far = F.sum("words").over(by_line.rangeBetween(Window.unboundedPreceding, 0))
    peers = F.count(F.lit(1)).over(by_line.rangeBetween(0, 0))
    runs = (_lines(docs, key, text)
            .withColumn("stop", (so_far / peers).cast("long"))
            .withColumn("start", F.col("stop") - F.col("words"))
            .withColumn("total", F.max("stop").over(doc)).withColumn("count", F.max("n").over(doc) + 1)
            .withColumn("last", F.coalesce(F.min("n").over(forward) - 1,
                                           F.when(F.col("total") - F.col("start") >= min_words, F.col("count") - 1)))
            .withColumn("first", F.coalesce(F.max("n").over(back) + 1,
                                            F.when(F.col("stop") >= min_words, F.lit(0))))
            .select(*PLACE, "id", "first", "last"))
    runs = stored(runs, "lines")
    keep = [*PLACE, "last", "first"]
    level = stored(_ranked(runs, ["id"], keep), "line-level")
    levels = [level.select(*PLACE, F.lit(0).alias("k"), "rank")]
    longest = level.agg(F.max(F.greatest(F.col("last") - F.col("n"), F.col("n") - F.col("first")) + 1)).first()[0] or 0
    k = 0
    current = level.select(*PLACE, "rank")
    while 2 ** (k + 1) <= longest:
        ahead = doc.orderBy("n").rangeBetween(2 ** k, 2 ** k)
        pairs = current.withColumn("second", F.min("rank").over(ahead)).where("second IS NOT NULL")
        pairs = pairs.withColumnRenamed("rank", "begin")
        current = stored(_ranked(pairs, ["begin", "second"], [*PLACE]), "line-level")
        if current.isEmpty():
            break
        k += 1
        levels.append(current.select(*PLACE, F.lit(k).alias("k"), "rank"))
    ranks = levels[0]
    for more in levels[1:]:
        ranks = ranks.unionAll(more)
    ranks = ranks.dropDuplicates([*PLACE, "k"])
    # the two shortest runs of a line that reach the threshold
    spans = (level.select("key", "th", F.explode(F.array(
        F.struct(F.col("n").alias("a"), F.col("last").alias("b")),
        F.struct(F.col("first").alias("a"), F.col("n").alias("b")))).alias("x"))
        .select("key", "th", "x.a", "x.b").where("a IS NOT NULL AND b IS NOT NULL").distinct()
        .withColumn("m", F.col("b") - F.col("a") + 1)
        .withColumn("k", F.floor(F.log2(F.col("m").cast("double"))).cast("int"))
        .withColumn("c", F.col("b") + 1 - F.pow(F.lit(2.0), F.col("k")).cast("int")))
    r = ranks.select(F.col("key").alias("rkey"), F.col("th").alias("rth"), F.col("n").alias("rn"),
                     F.col("k").alias("rk"), "rank")

    def named(rows: DataFrame, place: str, name: str) -> DataFrame:
        on = (rows["key"].eqNullSafe(r["rkey"]) & (rows["th"] == r["rth"]) & (rows["k"] == r["rk"])
              & (rows[place] == r["rn"]))
        return rows.join(r, on).select(*rows.columns, F.col("rank").alias(name))

    both = named(named(spans, "a", "one"), "c", "two")
    both = stored(both.select("key", "th", "a", "b", "m", "one", "two"), "line-runs")
    firsts = stored(both.groupBy("m", "one", "two").agg(F.min(_place("key", "th", "a")).alias("original")), "line-firsts")
    later = both.join(firsts, ["m", "one", "two"]).where(_place("key", "th", "a") > F.col("original"))
    return later.select("key", "th", F.col("a").alias("first"), F.col("b").alias("last"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    A column of its own would not do: a filter on the result is pushed below
    it and puts its expression back in every place that names it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _rest(text: Column, gone: Column) -> Column:
    """``text`` without the lines numbered in ``gone`` (counted among lines with a word); empty if no word is left."""
    def joined(parts: Column, every: Column, worded: Column) -> Column:
        stay = F.array_except(every, F.transform(gone, lambda n: F.get(worded, n)))
        return F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")

    return _let(F.split(text, "\n", -1), lambda parts: _let(
        F.sequence(F.lit(0), F.size(parts) - 1), lambda every: _let(
            F.filter(every, lambda i: F.regexp_like(F.get(parts, i), F.lit(_WORD))), lambda worded: _let(
                joined(parts, every, worded), lambda kept: F.when(F.regexp_like(kept, F.lit(_WORD)), kept).otherwise(F.lit(""))))))


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                   out: tuple[str, str] = ("__kept", "__removed")) -> DataFrame:
    """Every row of ``docs`` with its text without later copies of repeated runs and the number of lines removed.

    ``out`` names these two columns; ``common.fresh`` finds names that ``docs`` does not use.

    Null text stays null and loses nothing. A text left without any word
    becomes empty. Lines are what ``\\n`` parts; those without a word are
    no part of runs and stay.
    """
    runs = repeated_runs(docs, key, text, min_words)
    gone = (runs.select(F.col("key").alias("__key"), F.col("th").alias("__of"), F.explode(F.sequence("first", "last")).alias("line"))
            .groupBy("__key", "__of").agg(F.collect_set("line").alias("__gone")))
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own_key, own = (F.col(f"c{names.index(c)}") for c in (key, text))
    left = plain.withColumn("__th", F.xxhash64(_text(plain, f"c{names.index(text)}")))
    joined = left.join(gone, own_key.eqNullSafe(gone["__key"]) & (left["__th"] == gone["__of"]), "left")
    kept = _rest(own, F.col("__gone"))
    found = joined.select(
        *plain.columns,
        F.when(F.col("__gone").isNull(), own).otherwise(kept).alias("kept"),
        F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long").alias("removed"))
    return found.toDF(*names, *out)
