"""Relationships between columns: correlations, associations, group differences."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CORRELATION_REPORTED, CRAMER_REPORTED, PEARSON_STRONG
from . import order
from .profile import as_text
from .query import nan_free, q


def correlation(x: Column, y: Column) -> Column:
    """Over pairs with both values; null where either is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_samp(a, b), F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0)))


@nan_free
def pearson_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """All pairs from one aggregate: left_column, right_column, n, r."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*(e for i, (a, b) in enumerate(pairs) for e in (F.count(F.when(q(a).isNotNull() & q(b).isNotNull(), 1)).alias(f"n{i}"), correlation(q(a), q(b)).alias(f"r{i}"))))
    parts = F.array(*(F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.col(f"n{i}").alias("n"), F.round(f"r{i}", 6).alias("r")) for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(parts).alias("p")).select("p.*").where("n >= 3")


def strong_pairs(df: DataFrame, columns: list[str], least: float = 0.9) -> DataFrame:
    """The pairs whose Pearson correlation is at least as strong, with what is said of them."""
    said = F.format_string("'%s' and '%s' are strongly correlated (%.3f).", "left_column", "right_column", "r")
    return pearson_pairs(df, columns).where(F.abs("r") >= least).withColumn("message", said)


@nan_free
def average_ranks(values: DataFrame, column: str) -> DataFrame:
    """value, rank: average ranks from one row per distinct value."""
    counted = values.groupBy(q(column).alias("value")).agg(F.count("*").alias("n"))
    return order.running(counted, "value", "n").select("value", (F.col("upto_n") - (F.col("n") - 1) / 2.0).alias("rank"))


@nan_free
def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """The correlation of average ranks; equal pairs are counted before they join
    their ranks."""
    pairs = df.where(q(a).isNotNull() & q(b).isNotNull()).groupBy(q(a).alias("x"), q(b).alias("y")).agg(F.count("*").alias("w"))
    one = average_ranks(df.where(q(a).isNotNull() & q(b).isNotNull()), a).toDF("x", "rx")
    two = average_ranks(df.where(q(a).isNotNull() & q(b).isNotNull()), b).toDF("y", "ry")
    joined = pairs.join(one, "x").join(two, "y")
    return joined.agg(*_rank_sums()).select(F.col("n").cast("long").alias("n"), F.round(_rank_correlation(), 6).alias("rho"))


@nan_free
def spearman_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """left_column, right_column, n, rho of all pairs together, each over its complete
    rows.  Equal pairs of values are counted first; ranks come from one running sum over
    (pair, side, value)."""
    pairs = list(combinations(columns, 2))
    both = F.array(*(F.struct(F.lit(k).alias("pair"), q(a).cast("double").alias("x"), q(b).cast("double").alias("y")) for k, (a, b) in enumerate(pairs)))
    counted = df.select(F.explode(both).alias("p")).select("p.*").where("x is not null and y is not null").groupBy("pair", "x", "y").agg(F.count("*").alias("w"))
    sides = counted.select("pair", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("v"), "w"), F.struct(F.lit(1).alias("side"), F.col("y").alias("v"), "w"))).alias("s"))
    values = sides.groupBy(F.struct("pair", "s.side", "s.v").alias("key")).agg(F.sum("s.w").alias("n"))
    sums = order.running(values, "key", "n").select("key.*", "n", "upto_n")
    starts = F.broadcast(sums.groupBy("pair", "side").agg(F.min(F.col("upto_n") - F.col("n")).alias("start")))  # two rows for each pair
    ranks = sums.join(starts, ["pair", "side"]).select("pair", "side", "v", (F.col("upto_n") - F.col("start") - (F.col("n") - 1) / 2.0).alias("rank"))
    of = lambda side, name, rank: ranks.where(F.col("side") == side).select("pair", F.col("v").alias(name), F.col("rank").alias(rank))
    joined = counted.join(of(0, "x", "rx"), ["pair", "x"]).join(of(1, "y", "ry"), ["pair", "y"])
    s = joined.groupBy("pair").agg(*_rank_sums())
    lefts, rights = (F.array(*(F.lit(p[i]) for p in pairs)) for i in (0, 1))
    return s.select(F.get(lefts, F.col("pair")).alias("left_column"), F.get(rights, F.col("pair")).alias("right_column"), F.col("n").cast("long").alias("n"), F.round(_rank_correlation(), 6).alias("rho"))


def _rank_sums() -> list[Column]:
    w, x, y = F.col("w").cast("double"), F.col("rx"), F.col("ry")
    return [F.sum(c).alias(n) for n, c in (("n", w), ("sx", w * x), ("sy", w * y), ("sxy", w * x * y), ("sxx", w * x * x), ("syy", w * y * y))]


def _rank_correlation() -> Column:
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    return F.try_divide(F.col("sxy") - sx * sy / n, F.sqrt((F.col("sxx") - sx * sx / n) * (F.col("syy") - sy * sy / n)))


@nan_free
def relationships(df: DataFrame, columns: list[str], least: float = CORRELATION_REPORTED) -> DataFrame:
    """left_column, right_column, n, pearson, spearman, method of the numeric pairs that
    are strongly related: Pearson where it's strong by itself, else Spearman.  Pairs
    with fewer than three complete rows are left out."""
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "left_column string, right_column string, n long, pearson double, spearman double, method string")
    linear = pearson_pairs(df, columns).select("left_column", "right_column", F.col("r").alias("pearson"))
    found = spearman_pairs(df, columns).join(F.broadcast(linear), ["left_column", "right_column"])  # one row for each pair
    strong = F.abs("pearson") >= PEARSON_STRONG
    chosen = found.where("n >= 3").select("left_column", "right_column", "n", "pearson", F.col("rho").alias("spearman"), F.when(strong, "pearson").otherwise("spearman").alias("method"))
    return chosen.where(F.abs(F.when(strong, F.col("pearson")).otherwise(F.col("spearman"))) >= least)


@nan_free
def contingencies(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """left_column, right_column, n, rows, columns, chi_square, v, expected_min of the
    tables of pairs of columns, all together; ``sufficient`` is false with fewer than three
    rows or two levels.  Empty cells count without being made.  Pairs without a complete
    row are left out."""
    both = F.array(*(F.struct(F.lit(k).alias("pair"), as_text(df, a).alias("a"), as_text(df, b).alias("b")) for k, (a, b) in enumerate(pairs)))
    cells = df.select(F.explode(both).alias("p")).select("p.*").where("a is not null and b is not null").groupBy("pair", "a", "b").agg(F.count("*").alias("o"))
    rows, columns = (cells.groupBy("pair", k).agg(F.sum("o").alias(f"n{k}")) for k in "ab")
    s = cells.join(rows, ["pair", "a"]).join(columns, ["pair", "b"]).groupBy("pair").agg(F.sum(F.col("o") * F.col("o") / (F.col("na").cast("double") * F.col("nb"))).alias("phi"), F.sum("o").cast("long").alias("n"))
    sizes = rows.groupBy("pair").agg(F.count("*").alias("rows"), F.min("na").alias("least_a")).join(columns.groupBy("pair").agg(F.count("*").alias("columns"), F.min("nb").alias("least_b")), "pair")
    names = (F.array(*(F.lit(p[i]) for p in pairs)) for i in (0, 1))
    lefts, rights = (F.get(n, F.col("pair")) for n in names)
    return s.join(sizes, "pair").select(lefts.alias("left_column"), rights.alias("right_column"), *_table_figures())


def _table_figures() -> list[Column]:
    chi = F.greatest(F.col("phi") - 1, F.lit(0.0)) * F.col("n")
    v = F.sqrt(F.try_divide(chi, F.col("n") * F.greatest(F.lit(1), F.least("rows", "columns") - 1)))
    expected = F.try_divide(F.col("least_a").cast("double") * F.col("least_b"), "n")
    return [F.col("n"), F.col("rows"), F.col("columns"), F.round(chi, 6).alias("chi_square"), F.round(v, 6).alias("v"), F.round(expected, 6).alias("expected_min"), ((F.col("n") >= 3) & (F.least("rows", "columns") >= 2)).alias("sufficient")]


@nan_free
def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """The one row of a table of two columns, also if it has no rows."""
    found = contingencies(df, [(a, b)]).drop("left_column", "right_column")
    empty = df.sparkSession.createDataFrame([(0, 0, 0, False)], "n long, rows long, columns long, sufficient boolean")
    one = found.unionByName(empty, allowMissingColumns=True)
    return one.orderBy(F.desc("n")).limit(1)


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    return contingency(df, a, b).select("n", "v")


def associations(df: DataFrame, columns: list[str], least: float = CRAMER_REPORTED) -> DataFrame:
    """left_column, right_column and the table's figures of the categorical pairs whose
    Cramer's V is notable."""
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "left_column string, right_column string, n long, chi_square double, v double, expected_min double")
    found = contingencies(df, pairs)
    return found.where(F.col("sufficient") & (F.col("v") >= least)).select("left_column", "right_column", "n", "chi_square", "v", "expected_min")


@nan_free
def target_correlations(df: DataFrame, target: str, features: list[str], most: int = 3) -> DataFrame:
    """feature, r: the ``most`` largest and smallest correlations with a target."""
    row = df.agg(*(correlation(q(f), q(target)).alias(f"r{i}") for i, f in enumerate(features)))
    parts = F.array(*(F.struct(F.lit(f).alias("feature"), F.round(f"r{i}", 6).alias("r")) for i, f in enumerate(features)))
    found = row.select(F.explode(parts).alias("p")).select("p.*").where("r is not null")
    ends = [Window.orderBy(F.desc("r"), "feature"), Window.orderBy("r", "feature")]  # one row per feature
    return found.select("feature", "r", *(F.row_number().over(w).alias(f"k{i}") for i, w in enumerate(ends))).where((F.col("k0") <= most) | (F.col("k1") <= most)).drop("k0", "k1")


@nan_free
def group_spread(df: DataFrame, category: str, column: str) -> DataFrame:
    """How far the means of the groups (null is one) lie apart."""
    means = df.groupBy(q(category).alias("g")).agg(F.avg(q(column)).alias("m")).where("m is not null")
    return means.agg(F.count("*").alias("groups"), F.round(F.max("m") - F.min("m"), 6).alias("spread"))


@nan_free
def group_spreads(df: DataFrame, categories: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """category, column_name, groups, spread: ``group_spread`` of all categories and numeric
    columns together, where there are any groups."""
    if not categories or not columns:
        return df.sparkSession.createDataFrame([], "category string, column_name string, groups long, spread double")
    cells = F.array(*(F.struct(F.lit(i).alias("c"), as_text(df, c).alias("g")) for i, c in enumerate(categories)))
    rows = df.select(F.explode(cells).alias("k"), *(q(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)))
    means = rows.groupBy("k.c", "k.g").agg(*(F.avg(f"x{j}").alias(f"m{j}") for j in range(len(columns))))
    each = means.select("c", F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.col(f"m{j}").alias("m")) for j in range(len(columns))))).alias("x")).where("x.m is not null")
    s = each.groupBy("c", "x.j").agg(F.count("*").alias("groups"), F.round(F.max("x.m") - F.min("x.m"), 6).alias("spread"))
    return s.select(F.get(F.array(*map(F.lit, categories)), F.col("c")).alias("category"), F.get(F.array(*map(F.lit, columns)), F.col("j")).alias("column_name"), "groups", "spread")
