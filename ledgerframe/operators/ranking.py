"""Global RANK / ROW_NUMBER / NTILE without a single-partition window.

``Window.orderBy`` with no partition key moves the whole frame into one
task. Here one algorithm serves every size:

1. range-partition the frame on (order key, unique tie-break) and sort
   inside the partitions: every partition holds a contiguous slice of the
   global order, also when one key is shared by a third of the rows;
2. number the rows of each slice where they stand and write slice, place
   and all columns once to the cluster's shared folder. Everything after
   reads that table, so no slice can be dealt a second time with other
   bounds;
3. summarise each slice in one row (rows, first and last key, place where
   the last key starts); running sums over these rows, one per slice, give
   the rows before each slice and the place where a key that runs on from
   earlier slices began;
4. row number = rows before the slice + place; rank = the row number at
   which the key begins, the smallest in its slice or the one run on.

``ntile`` follows from the row number and the total count.

Ranks by counting (``ranks_desc``) need no order of the rows at all: a rank is
one more than the rows with a greater key, so only distinct keys with their
counts are ordered, in slices that an order-preserving function of the key
gives (the same in every run), and the counts of greater slices are added.
No job runs before an action, and a key shared by a third of the rows is one
row from the map side on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.session import staged


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _parts(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _numbered(df: DataFrame, key_order: Column, tb_order: Column, n_parts: int | None) -> DataFrame:
    """``df`` with its slice (``__pid``) and place in it from 1 (``__pos``), stored."""
    place = F.monotonically_increasing_id()  # the partition above bit 33, the row in it below
    sliced = (df.repartitionByRange(_parts(df, n_parts), key_order, tb_order)
              .sortWithinPartitions(key_order, tb_order).withColumn("__id", place))
    return staged(sliced.select(*df.columns, F.shiftright("__id", 33).cast("int").alias("__pid"),
                                (F.col("__id").bitwiseAND((1 << 33) - 1) + 1).alias("__pos")), "ranking")


def _offsets(numbered: DataFrame) -> DataFrame:
    """One row per slice: rows before it and rows in all."""
    slices = numbered.groupBy("__pid").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    return slices.select(
        F.col("__pid").alias("__of"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"),
        F.sum("__rows").over(Window.partitionBy()).alias("__total"))


def _with_row_number(df: DataFrame, key_order: Column, tb_order: Column, n_parts: int | None) -> DataFrame:
    numbered = _numbered(df, key_order, tb_order, n_parts)
    return (numbered.join(F.broadcast(_offsets(numbered)), F.col("__pid") == F.col("__of"))
            .withColumn("__rn", F.col("__offset") + F.col("__pos")))


def rank_desc(df: DataFrame, key: str, out: str, tiebreak: str | None = None,
              n_parts: int | None = None) -> DataFrame:
    """RANK() OVER (ORDER BY key DESC), NULLs first as in SQL, as BIGINT."""
    return rank(df, _c(key).desc_nulls_first(), key, out, tiebreak, n_parts)


def rank(df: DataFrame, key_order: Column, key: str, out: str, tiebreak: str | None = None,
         n_parts: int | None = None) -> DataFrame:
    """RANK() over ``key_order``, an order of the column ``key``."""
    numbered = _numbered(df, key_order, F.col(tiebreak or df.columns[0]).asc_nulls_last(), n_parts)
    # where each key starts inside each slice: combined before the shuffle, one row per slice and key
    starts = numbered.groupBy("__pid", F.col(key).alias("__key")).agg(
        F.min("__pos").alias("__start"), F.count(F.lit(1)).alias("__n"))
    slices = starts.groupBy("__pid").agg(
        F.sum("__n").alias("__rows"), F.min_by(F.struct("__key"), "__start").alias("__first"),
        F.max_by(F.struct("__key"), "__start").alias("__last"), F.max("__start").alias("__last_start"))
    in_order = Window.orderBy("__pid")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    runs_on = F.lag("__last").over(in_order).eqNullSafe(F.col("__first"))
    slices = (slices.withColumn("__offset", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
              .withColumn("__runs_on", F.coalesce(F.lag("__rows").over(in_order).isNotNull() & runs_on, F.lit(False))))
    # the row number at which the last key of a slice starts, unless it started earlier
    own = F.when(~(F.col("__runs_on") & (F.col("__last_start") == 1)), F.col("__offset") + F.col("__last_start"))
    slices = (slices.withColumn("__own", own)
              .withColumn("__begun", F.last("__own", ignorenulls=True).over(before))
              .select(F.col("__pid").alias("__of"), "__offset", "__runs_on", "__begun"))
    ranks = starts.join(F.broadcast(slices), F.col("__pid") == F.col("__of")).select(
        F.col("__pid").alias("__of"), "__key",
        F.when(F.col("__runs_on") & (F.col("__start") == 1), F.col("__begun"))
        .otherwise(F.col("__offset") + F.col("__start")).cast("bigint").alias(out))
    on = (numbered["__pid"] == ranks["__of"]) & numbered[key].eqNullSafe(ranks["__key"])
    return numbered.join(ranks, on).select(*[numbered[c] for c in df.columns], out)


# ---------------------------------------------------------------- ranks by counting
def decimal_slice(key: Column) -> Column:
    """Order-preserving slice of a whole number: sign, number of digits and the first three of them.

    At most 900 slices a digit and sign, whatever the values are.
    """
    digits = F.abs(key.cast("decimal(38,0)")).cast("string")
    code = F.length(digits) * 1000 + F.substring(F.rpad(digits, 3, "0"), 1, 3).cast("int")
    return F.when(key < 0, -code).otherwise(code).cast("bigint")


def fraction_key(num: str, den: str) -> Column:
    """An array that orders fractions of whole numbers exactly (den > 0; null or 0: null).

    The terms of the continued fraction, every second one negated: arrays
    compare by the first term that differs, and a greater term makes the
    fraction greater at even places and smaller at odd ones. The end counts
    as a term beyond all others. Equal fractions have equal arrays, whatever
    their denominators; 92 steps serve any pair of 64-bit numbers.
    """
    # one expression string: a call into the JVM for each part would cost more than the work
    step = ("(s, i) -> if(s.b = 0, s, named_struct('a', s.b, 'b', pmod(s.a, s.b), 'key',"
            " concat(s.key, array(if(i % 2 = 0, 1L, -1L) * ((s.a - pmod(s.a, s.b)) div s.b)))))")
    terms = F.expr(f"aggregate(sequence(0, 91), named_struct('a', cast({num} as bigint), 'b', cast({den} as bigint),"
                   f" 'key', cast(array() as array<bigint>)), {step}).key")
    end = F.when(F.size(terms) % 2 == 0, F.lit((1 << 63) - 1)).otherwise(F.lit(-(1 << 63) + 1))
    return F.when((F.col(den) > 0) & F.col(num).isNotNull(), F.concat(terms, F.array(end)))


def ranks_desc(df: DataFrame, axes: dict[str, tuple[Column, Column]]) -> DataFrame:
    """RANK() OVER (ORDER BY key DESC) for several keys at once, NULLs first as in SQL, as BIGINT.

    ``axes`` maps each result column to (key, slice): the key as whole numbers in
    an array (compared by the first that differs; null: no value) and a
    function of it that never falls where the key rises. One pass counts the
    distinct keys of all axes; sums run inside slices and over slices; each
    axis is joined back by its key.
    """
    parts = [F.struct(F.lit(i).alias("__axis"), s.cast("bigint").alias("__slice"), k.cast("array<decimal(38,0)>").alias("__key"))
             for i, (k, s) in enumerate(axes.values())]
    # a row once for each axis; numbered, as rows may be equal
    long = (df.select(F.monotonically_increasing_id().alias("__row"), "*")
            .select("__row", *df.columns, F.inline(F.array(*parts))))
    counts = (df.select(F.inline(F.array(*parts))).groupBy("__axis", "__slice", "__key").agg(F.count(F.lit(1)).alias("__n")))
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("__axis", "__slice").orderBy(F.col("__key").desc_nulls_first()).rowsBetween(*before)
    over = Window.partitionBy("__a").orderBy(F.col("__s").desc_nulls_first()).rowsBetween(*before)
    slices = counts.groupBy(F.col("__axis").alias("__a"), F.col("__slice").alias("__s")).agg(F.sum("__n").alias("__m"))
    slices = slices.select("__a", "__s", F.coalesce(F.sum("__m").over(over), F.lit(0)).alias("__above"))
    placed = (counts.withColumn("__in", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
              .join(slices, (F.col("__axis") == F.col("__a")) & F.col("__slice").eqNullSafe(F.col("__s")))
              .select(F.col("__axis").alias("__b"), F.col("__key").alias("__j"), (F.col("__above") + F.col("__in") + 1).cast("bigint").alias("__rank")))
    found = long.join(placed, (F.col("__axis") == F.col("__b")) & F.col("__key").eqNullSafe(F.col("__j")))
    return found.groupBy("__row").agg(
        *[F.any_value(c).alias(c) for c in df.columns],
        *[F.max(F.when(F.col("__axis") == i, F.col("__rank"))).alias(name) for i, name in enumerate(axes)]).drop("__row")


def row_number(df: DataFrame, key_order: Column, tb_order: Column, out: str,
               n_parts: int | None = None) -> DataFrame:
    """ROW_NUMBER() over (key_order, tb_order); tb must make the order total."""
    j = _with_row_number(df, key_order, tb_order, n_parts)
    return j.withColumn(out, F.col("__rn").cast("bigint")).select(*df.columns, out)


def ntile(df: DataFrame, buckets: int, key_order: Column, tb_order: Column, out: str,
          n_parts: int | None = None) -> DataFrame:
    """NTILE(buckets) over (key_order, tb_order): the first N % b buckets get one extra row."""
    j = _with_row_number(df, key_order, tb_order, n_parts)
    rn, n = F.col("__rn"), F.col("__total")
    q = F.floor(n / buckets).cast("bigint")
    r = (n % buckets).cast("bigint")
    big = r * (q + 1)
    bucket = F.when(rn <= big, F.floor((rn - 1) / (q + 1)) + 1).otherwise(
        F.floor((rn - big - 1) / F.when(q > 0, q)) + r + 1)
    return j.withColumn(out, bucket.cast("bigint")).select(*df.columns, out)
