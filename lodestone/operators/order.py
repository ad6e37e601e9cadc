"""Running sums, neighbours and exact percentiles without a task that holds all rows.

Nothing runs while a plan is built.  For sums and neighbours rows are dealt to ranges of
their key, windows run within a range, and what the ranges before hold comes from one row
per range.  Percentiles need no sorting: a sketch brackets each, one aggregate counts what
lies outside the brackets, and only values inside are looked at one by one.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled keys for each range.
SAMPLE = 16
#: The sketch's accuracy, and how far a bracket reaches beyond a share, in its errors.
ACCURACY, REACH = 10_000, 4


def in_ranges(df: DataFrame, key: str, repeated: bool = False) -> DataFrame:
    """``df`` with ``_range``, the number of the range that holds its key (null: the first).
    With ``repeated`` keys may occur again; each counts once for the bounds.

    Readers of one result must agree on the ranges however often Spark works them out,
    so their bounds come from a sample that is always the same: the keys with the smallest
    hashes.  A key finds its block of bounds, then its place there, so it meets about two
    roots of the number of ranges."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if ranges < 2:
        return df.withColumn("_range", F.lit(0))
    wide = ceil(sqrt(ranges - 1))
    known = df.select(F.col(key).alias("_k")).where("_k is not null")
    sample = (known.distinct() if repeated else known).orderBy(F.xxhash64("_k"), "_k").limit(SAMPLE * ranges).agg(F.sort_array(F.collect_list("_k")).alias("_s"))
    bound = lambda i: F.get("_s", F.floor(i * F.size("_s") / ranges).cast("int"))
    starts = range(1, ranges, wide)
    blocks = sample.select(F.array(*(F.array(*(bound(F.lit(i)) for i in range(start, min(start + wide, ranges)))) for start in starts)).alias("_blocks"))
    blocks = blocks.select("_blocks", F.transform("_blocks", lambda b: F.element_at(b, -1)).alias("_ends"))
    below = lambda bounds: F.coalesce(F.size(F.filter(bounds, lambda b: b < F.col(key))), F.lit(0))
    found = df.crossJoin(F.broadcast(blocks)).withColumn("_full", below(F.col("_ends")))
    last = F.when(F.col("_full") < len(starts), below(F.get("_blocks", F.col("_full")))).otherwise(0)
    return found.withColumn("_range", F.col("_full") * wide + last).drop("_blocks", "_ends", "_full")


def running(df: DataFrame, key: str, *sums: str) -> DataFrame:
    """``df``, whose keys differ, with ``upto_x``: the sum of x over all rows up to this
    one in the key's order, for each x of ``sums``."""
    ranged = in_ranges(df, key)
    here, before = Window.partitionBy("_range").orderBy(key), Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*(F.sum(s).alias(f"_t{i}") for i, s in enumerate(sums)))
    bases = totals.select("_range", *(F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))))
    joined = ranged.join(F.broadcast(bases), "_range")
    return joined.select(*df.columns, *((F.sum(s).over(here) + F.col(f"_b{i}")).alias(f"upto_{s}") for i, s in enumerate(sums)))


def previous(df: DataFrame, key: str, value: str) -> DataFrame:
    """``df``, whose keys differ, with ``previous``: the value of the row before."""
    ranged = in_ranges(df, key)
    here, before = Window.partitionBy("_range").orderBy(key), Window.orderBy("_range")
    lasts = ranged.groupBy("_range").agg(F.max_by(value, key).alias("_last")).select("_range", F.lag("_last").over(before).alias("_last"))
    first = F.row_number().over(here) == 1
    return ranged.join(F.broadcast(lasts), "_range").select(*df.columns, F.when(first, F.col("_last")).otherwise(F.lag(value).over(here)).alias("previous"))


def percentiles(df: DataFrame, value: Column, shares: list[float], weight: Column | None = None, by: str | None = None) -> DataFrame:
    """One row: ``p``, the exact percentiles by linear interpolation (nulls without values);
    or one for each group in ``by`` that has values.  Groups are few (the columns of a
    table): a row of each is broadcast.

    1. A sketch gives two cuts for each share, a little below and above it.
    2. One aggregate counts the rows up to each cut, so the range between cuts that
       holds a wanted rank is known for certain, whatever the sketch was worth.
    3. The distinct values of these ranges, about one row in a thousand for each share,
       are counted and ranked."""
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    keys = [by] if by else []

    def with_row(frame: DataFrame, row: DataFrame) -> DataFrame:
        return frame.join(F.broadcast(row), keys) if keys else frame.crossJoin(F.broadcast(row))

    values = df.select(*keys, value.cast("double").alias("x"), w.alias("w")).where("x is not null and not isnan(x) and w > 0")
    reach = REACH / ACCURACY
    places = sorted({min(1.0, max(0.0, s + d)) for s in shares for d in (-reach, reach)})
    cuts = values.groupBy(*keys).agg(F.percentile_approx("x", places, ACCURACY).alias("cuts"))
    cut = lambda i: F.get("cuts", F.lit(i))
    n = len(places)
    upto = with_row(values, cuts).groupBy(*keys).agg(
        F.sum("w").alias("total"), F.first("cuts").alias("cuts"), F.array(*(F.coalesce(F.sum(F.when(F.col("x") <= cut(i), F.col("w"))), F.lit(0).cast("long")) for i in range(n))).alias("upto")
    )
    # Each share needs the values at the ranks (from 0) around (total - 1) * share.
    place = lambda s: (F.col("total") - 1) * F.lit(float(s))
    side = lambda rank: F.size(F.filter("upto", lambda u: u <= rank))
    wanted = upto.withColumn("sides", F.array_distinct(F.array(*(side(r(place(s))) for s in shares for r in (F.floor, F.ceil)))))
    # A value's side: how many cuts lie below it.
    own = sum(((F.col("x") > cut(i)).cast("int") for i in range(n)), F.lit(0))
    near = with_row(values, wanted).withColumn("side", own).where(F.array_contains("sides", F.col("side")))
    counted = near.groupBy(*keys, "side", "total", F.coalesce(F.get("upto", F.col("side") - 1), F.lit(0)).alias("base"), "x").agg(F.sum("w").alias("n"))
    ends = counted.withColumn("end", F.col("base") + F.sum("n").over(Window.partitionBy(*keys, "side").orderBy("x")))
    at = lambda rank: F.max(F.when((F.col("end") - F.col("n") <= rank) & (rank < F.col("end")), F.col("x")))
    row = ends.groupBy(*keys).agg(*(at(r(place(s))).alias(f"{name}{i}") for i, s in enumerate(shares) for name, r in (("low", F.floor), ("high", F.ceil))), F.max("total").alias("total"))

    def between(i: int, s: float) -> Column:
        low, high = F.col(f"low{i}"), F.col(f"high{i}")
        return F.when(low == high, low).otherwise(low + (high - low) * (place(s) - F.floor(place(s))))

    return row.select(*keys, F.array(*(between(i, s) for i, s in enumerate(shares))).alias("p"))
