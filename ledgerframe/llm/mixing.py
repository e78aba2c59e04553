"""Mixing sources to target weights: tokens per source, repetition rates, hash-seeded copies.

Sizes are summed per source with map-side combine (a hot source is only a
sum) and rates come from the table of sources (one row each). Every document
is taken floor(rate) times and once more with a probability equal to the
fraction. That Bernoulli draw is systematic: the documents of a source stand
in order of size, then of a seeded hash, and from one hash-seeded offset on
each takes a copy where the running sum of fractions passes a whole number.
Each document has the same chance as in draws of its own, but sizes level out,
so that a source ends within about one document of its target. A large
source is dealt to parts of about ``PART_DOCS`` documents by the hash, each
with an offset of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
#: documents of a source ordered in one task, about
PART_DOCS = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) from the MD5 of the seed and the keys (52 bits)."""
    joined = F.concat_ws("\x1f", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("\x00")) for k in keys])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Target and rate of each source of (source, size) rows.

    Targets are the level L times the weight, at most ``most`` times the
    source's size. Ordered by the ratio at which a source stops, L is the
    first level that spends exactly the budget on those that have not
    stopped; a sum over that order finds it, without rounds.
    One row per source: the number of sources is a property of the corpus
    layout, and this table alone is ordered in one task.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = (sums
               .withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
               .withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
               .withColumn("cap", F.lit(most) * F.col("source_size"))
               .withColumn("stop", F.col("cap") / F.col("weight")))
    below = Window.orderBy("stop", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    levels = (weighed
              .withColumn("place", F.row_number().over(Window.orderBy("stop", F.col("source").asc_nulls_last())))
              .withColumn("spent", F.coalesce(F.sum("cap").over(below), F.lit(0)))
              .withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0)))
              .withColumn("level", (F.col("budget") - F.col("spent")) / F.col("left")))
    # sources stop from the left; the first whose stop reaches its level sets it for the rest
    level = F.min(F.when(F.col("stop") >= F.col("level"), F.struct("place", "level"))).over(everything)["level"]
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(
        F.least(F.col("cap").cast("double"), level * F.col("weight")))
    return levels.select(
        "source", "source_size", "docs", target.alias("target"),
        F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target / F.col("source_size")).alias("rate"))


OUT = ("__size", "__source_size", "__target", "__copies")


def copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST,
           seed: str = SEED, out: tuple[str, str, str, str] = OUT) -> DataFrame:
    """Every row of ``docs`` with its size, its source's size and target, and its copies, in columns named by ``out``.

    Null text: size 0. Null source: a source of its own, last in order. Rows
    equal in doc_id and text are drawn as rows of their own, and a rerun draws
    as many of them. An empty table gives an empty table. A source without
    words has target 0 and no copies. Columns of any name pass through;
    ``common.fresh`` finds names for ``out`` that ``docs`` does not use.
    The table of sources has one row each; Spark broadcasts it up to
    ``spark.sql.autoBroadcastJoinThreshold`` and joins by sort merge past it.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text, source = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text", "source"))
    own = F.md5(F.concat_ws("\x1f", F.lit(seed), F.coalesce(key.cast("string"), F.lit("\x00")), F.md5(F.coalesce(text, F.lit("")))))
    tie = F.xxhash64(*[f.name for f in plain.schema.fields if "map<" not in f.dataType.simpleString()])  # rows equal in id and text
    sized = plain.withColumns({"size": n_words(text), "own": own, "tie": tie})
    rates = source_rates(sized.select(source.alias("source"), "size"), weights, share, most)
    joined = sized.join(rates, source.eqNullSafe(F.col("source")))
    # the hash deals a large source to parts (its last digits) and orders documents of one size in a part (the whole)
    part = F.conv(F.substring("own", 25, 8), 16, 10).cast("long") % F.ceil(F.col("docs") / F.lit(PART_DOCS))
    place = F.row_number().over(Window.partitionBy("source", "part").orderBy("size", "own", "tie"))
    offset = unit_hash(seed, F.col("source"), F.col("part"))
    whole = F.floor("rate")
    before = lambda n: F.floor(n * (F.col("rate") - whole) + offset)
    found = joined.withColumn("part", part).withColumn("place", place)
    return found.select(*plain.columns, "size", "source_size", "target",
                        (whole + before(F.col("place")) - before(F.col("place") - 1)).cast("int").alias("copies")).toDF(*names, *out)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    out = tuple(fresh(docs, n) for n in OUT)
    found = copies(docs, out=out, **how).where(F.col(out[3]) > 0)
    return found.withColumn(out[0], F.explode(F.sequence(F.lit(1), F.col(out[3])))).select(*[found[c] for c in docs.columns])
