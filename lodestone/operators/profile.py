"""Profiles of a dataset: counts, distributions, outliers, frequencies, time.

Scalars of all columns come from one aggregate, what concerns values from one row for each
value of each column.  Fences and deviations come from frames of a row for each column,
so nothing runs while a plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CATEGORICAL_LENGTH, CATEGORICAL_RATIO, GAP_FACTOR, IDENTIFIER_NAMES, IQR_FACTOR, MAD_CUT, MAD_SCALE, NEAR_CONSTANT, NUMBER_TEXT, TARGET_TOKENS, TEMPORAL_SHARE
from . import order
from .query import nan_free, q

QUARTERS = [0.25, 0.5, 0.75]
#: Readings of a time's text, the first that fits.
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy HH:mm", "MM/dd/yyyy", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "dd MMM yyyy", "MMM dd, yyyy")


@nan_free
def dataset_counts(df: DataFrame) -> DataFrame:
    """Rows, columns, and rows beyond the first of each set of equal rows."""
    grouped = df.groupBy(*map(q, df.columns)).agg(F.count("*").alias("_n"))
    return grouped.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"), F.lit(len(df.columns)).cast("long").alias("column_count"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def as_text(df: DataFrame, column: str) -> Column:
    """A value's text, the same for equal values."""
    c = q(column)
    return F.when(c == 0, 0.0).otherwise(c).cast("string") if dict(df.dtypes)[column] in ("double", "float") else c.cast("string")


def stacked(df: DataFrame, columns: Sequence[str], value) -> DataFrame:
    """c, v: the number and the value of each of the columns, row by row."""
    cells = F.array(*(F.struct(F.lit(i).alias("c"), value(c).alias("v")) for i, c in enumerate(columns)))
    return df.select(F.explode(cells).alias("x")).select("x.c", "x.v")


@nan_free
def column_facts(df: DataFrame) -> DataFrame:
    """column_name, type, non_null, missing, unique_count, and of text columns chars, times
    and numbers: characters, and values that read as a time or a number.

    All columns are counted together, from one row for each value of each."""
    if not df.columns:
        return df.sparkSession.createDataFrame([], "column_name string, type string, non_null long, missing long, unique_count long, chars long, times long, numbers long")
    names = df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)], "c int, column_name string, type string")
    values = stacked(df, df.columns, lambda c: as_text(df, c)).groupBy("c", "v").agg(F.count("*").alias("n"))
    texts = [i for i, f in enumerate(df.schema) if isinstance(f.dataType, T.StringType)]
    text = F.col("c").isin(texts) if texts else F.lit(False)
    total = lambda on, x=F.col("n"): F.sum(F.when(on, x).otherwise(0))
    v = F.col("v")
    sums = values.groupBy("c").agg(
        total(v.isNotNull()).alias("non_null"), total(v.isNull()).alias("missing"), F.count("v").alias("unique_count"), total(text & v.isNotNull(), F.length("v") * F.col("n")).alias("chars"),
        total(F.when(text, parsed_time(v).isNotNull()).otherwise(False)).alias("times"), total(text & F.coalesce(v.rlike(NUMBER_TEXT), F.lit(False))).alias("numbers"),
    )
    return names.join(sums, "c", "left").drop("c").fillna(0)


def counts_of(facts: DataFrame) -> DataFrame:
    """``facts`` (of ``column_facts``) with missing_rate and cardinality."""
    rows = F.col("non_null") + F.col("missing")
    return facts.withColumns({
        "missing_rate": F.round(F.coalesce(F.try_divide("missing", rows), F.lit(0.0)), 6),
        "cardinality": F.round(F.coalesce(F.try_divide("unique_count", "non_null"), F.lit(0.0)), 6),
    })


def attribute_counts(df: DataFrame) -> DataFrame:
    """column_name, non_null, missing, missing_rate, unique_count, cardinality."""
    return counts_of(column_facts(df)).select("column_name", "non_null", "missing", "missing_rate", "unique_count", "cardinality")


def parsed_time(c: Column) -> Column:
    """A text read as a time by the first format that fits, else null."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)) for f in TIME_FORMATS))


def with_kinds(facts: DataFrame) -> DataFrame:
    """``facts`` with kind: boolean, numeric, temporal, categorical, text, or unknown where
    a text column has no value."""
    n = F.col("non_null")
    few = (F.col("unique_count") / n <= CATEGORICAL_RATIO) | (F.col("chars") / n <= CATEGORICAL_LENGTH)
    texts = F.when(n == 0, "unknown").when(F.col("times") / n >= TEMPORAL_SHARE, "temporal").when(few, "categorical").otherwise("text")
    numeric = F.col("type").isin("tinyint", "smallint", "int", "bigint", "float", "double") | F.col("type").startswith("decimal")
    fixed = F.when(F.col("type") == "boolean", "boolean").when(numeric, "numeric").when(F.col("type").isin("timestamp", "timestamp_ntz", "date"), "temporal").otherwise("unknown")
    return facts.withColumn("kind", F.when(F.col("type") == "string", texts).otherwise(fixed))


def column_kinds(df: DataFrame) -> DataFrame:
    return with_kinds(column_facts(df)).select("column_name", "kind")


def with_roles(facts: DataFrame) -> DataFrame:
    """``facts`` with kind, rates, and whether a column may be an identifier, a grouping, a
    target."""
    name = F.lower(F.trim("column_name"))
    identifier = (F.col("unique_count") > 0) & (F.col("unique_count") == F.col("non_null")) & (name.contains("id") | name.isin("key", "index"))
    grouping = (F.col("kind") == "categorical") & F.col("unique_count").between(2, F.least(F.lit(20), F.greatest(F.lit(2), F.floor(F.col("non_null") / 5))))
    target = (F.col("kind") == "numeric") & F.exists(F.array(*map(F.lit, TARGET_TOKENS)), lambda t: name.contains(t))
    return counts_of(with_kinds(facts)).withColumns({"candidate_identifier": identifier, "candidate_grouping": grouping, "candidate_target": target})


def roles(df: DataFrame) -> DataFrame:
    """column_name, kind and the candidate roles."""
    return with_roles(column_facts(df)).select("column_name", "kind", "candidate_identifier", "candidate_grouping", "candidate_target")


def type_counts(df: DataFrame) -> DataFrame:
    return column_kinds(df).groupBy("kind").agg(F.count("*").alias("n"))


@nan_free
def distribution(df: DataFrame, column: str) -> DataFrame:
    """Moments and quartiles; skewness and kurtosis adjusted for the sample."""
    c = q(column)
    row = df.agg(
        F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.var_samp(c).alias("v"), F.stddev_samp(c).alias("s"), F.skewness(c).alias("g1"), F.kurtosis(c).alias("g2"), F.avg((c == 0).cast("double")).alias("zero_fraction"),
    ).crossJoin(F.broadcast(order.percentiles(df, c, QUARTERS)))
    n = F.col("n").cast("double")
    skew = _adjusted_skewness()
    kurt = F.when(n >= 4, F.coalesce(((n + 1) * F.col("g2") + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)), F.lit(0.0)))
    one = F.when(n == 1, 0.0)
    r = lambda x, name: F.round(x, 6).alias(name)
    return row.select(
        F.col("n").alias("count"), r("min", "min"), r("max", "max"), r("mean", "mean"), r(F.coalesce("v", one), "variance"), r(F.coalesce("s", one), "std"), r(F.get("p", F.lit(0)), "q25"), r(F.get("p", F.lit(1)), "median"),
        r(F.get("p", F.lit(2)), "q75"), r(F.get("p", F.lit(2)) - F.get("p", F.lit(0)), "iqr"), r(skew, "skewness"), r(kurt, "kurtosis"), r("zero_fraction", "zero_fraction"),
    )


@nan_free
def outliers(df: DataFrame, column: str) -> DataFrame:
    """Counts beyond the fences and beyond the scaled median absolute deviation."""
    c = q(column).cast("double")
    values = df.select(c.alias("x"))
    fences = order.percentiles(values, F.col("x"), QUARTERS).select(F.get("p", F.lit(0)).alias("q1"), F.get("p", F.lit(1)).alias("med"), F.get("p", F.lit(2)).alias("q3"))
    deviation = order.percentiles(values.crossJoin(F.broadcast(fences)), F.abs(F.col("x") - F.col("med")), [0.5]).select(F.get("p", F.lit(0)).alias("mad"))
    outside, far = _outside(F.col("x"))
    both = values.crossJoin(F.broadcast(fences)).crossJoin(F.broadcast(deviation))
    return both.agg(F.count_if(outside).alias("iqr_outliers"), F.count_if(far).alias("mad_outliers"), F.round(F.first("mad"), 6).alias("mad"))


@nan_free
def shapes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, iqr_outliers, mad_outliers, skewness of each numeric column, all columns
    together; columns without values are left out."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, iqr_outliers long, mad_outliers long, skewness double")
    names = F.array(*map(F.lit, columns))
    values = stacked(df, columns, lambda c: q(c).cast("double")).where("v is not null")
    fences = order.percentiles(values, F.col("v"), QUARTERS, by="c").select("c", *(F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("q1", "med", "q3"))))
    placed = values.join(F.broadcast(fences), "c")
    mads = order.percentiles(placed, F.abs(F.col("v") - F.col("med")), [0.5], by="c").select("c", F.get("p", F.lit(0)).alias("mad"))
    outside, far = _outside(F.col("v"))
    s = placed.join(F.broadcast(mads), "c").groupBy("c").agg(F.count("*").cast("double").alias("n"), F.count_if(outside).alias("iqr_outliers"), F.count_if(far).alias("mad_outliers"), F.skewness("v").alias("g1"))
    return s.select(F.get(names, F.col("c")).alias("column_name"), "iqr_outliers", "mad_outliers", F.round(_adjusted_skewness(), 6).alias("skewness"))


def _outside(x: Column) -> tuple[Column, Column]:
    """Beyond the fences q1 and q3; too far from med for mad."""
    iqr = F.col("q3") - F.col("q1")
    outside = (iqr > 0) & ((x < F.col("q1") - IQR_FACTOR * iqr) | (x > F.col("q3") + IQR_FACTOR * iqr))
    return outside, (F.col("mad") > 0) & (F.abs(x - F.col("med")) > MAD_CUT * MAD_SCALE * F.col("mad"))


def _adjusted_skewness() -> Column:
    """For the sample, from n and g1."""
    n = F.col("n")
    return F.when(n >= 3, F.coalesce(F.col("g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)), F.lit(0.0)))


@nan_free
def value_frequencies(df: DataFrame, column: str, most: int = 20) -> DataFrame:
    counted = df.where(q(column).isNotNull()).groupBy(q(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "value").limit(most)


def text_lengths(df: DataFrame, column: str) -> DataFrame:
    n = F.length(q(column))
    return df.agg(F.min(n).cast("long").alias("min_length"), F.max(n).cast("long").alias("max_length"), F.round(F.avg(n), 6).alias("mean_length"))


def parse_fraction(df: DataFrame, column: str) -> DataFrame:
    """The share of texts that read as numbers."""
    return df.where(q(column).isNotNull()).agg(F.round(F.avg(q(column).rlike(NUMBER_TEXT).cast("double")), 6).alias("numeric_fraction"))


def structure(df: DataFrame) -> DataFrame:
    """Flags and candidate roles of each column."""
    rows = F.col("non_null") + F.col("missing")
    return with_roles(column_facts(df)).select(
        "column_name", (F.col("unique_count") == 0).alias("empty"), (F.col("unique_count") == 1).alias("constant"), ((F.col("cardinality") <= NEAR_CONSTANT) & (F.col("unique_count") > 1)).alias("near_constant"),
        ((F.col("missing") == 0) & (F.col("unique_count") == rows) & (rows > 0)).alias("candidate_key"), F.lower("column_name").isin(*IDENTIFIER_NAMES).alias("candidate_index"), "candidate_identifier", "candidate_grouping", "candidate_target",
    )


def temporal(df: DataFrame, column: str, row: str) -> DataFrame:
    """Span, order in the given row order, repeats, median interval and gaps; with fewer
    than two times ``sufficient`` is false and only the count is given.

    Distinct times are sorted, one narrow column; repeats carry a count."""
    kind = df.schema[column].dataType
    time = parsed_time(q(column)) if isinstance(kind, T.StringType) else q(column).cast("timestamp")
    rows = df.select((F.unix_micros(time) / 1e6).alias("s"), q(row).alias("o")).where("s is not null")
    times = rows.groupBy("s").agg(F.count("*").alias("n"))
    steps = order.previous(times, "s", "s").select("s", "n", (F.col("s") - F.col("previous")).alias("d"))
    # A repeated time adds intervals of zero.
    spread = steps.select(F.explode(F.array(F.struct(F.col("d").alias("d"), F.lit(1).cast("long").alias("w")), F.struct(F.lit(0.0).alias("d"), (F.col("n") - 1).alias("w")))).alias("x")).select("x.d", "x.w").where("d is not null and w > 0")
    middle = order.percentiles(spread, F.col("d"), [0.5], F.col("w")).select(F.get("p", F.lit(0)).alias("median_interval"))
    far = (F.col("median_interval") != 0) & (F.col("d") > GAP_FACTOR * F.col("median_interval"))
    gaps = spread.crossJoin(F.broadcast(middle)).agg(F.coalesce(F.sum(F.when(far, F.col("w")).otherwise(0)), F.lit(0)).alias("gap_count"))
    ordered = order.previous(rows, "o", "s").agg(F.coalesce(F.bool_and(F.col("s") >= F.col("previous")), F.lit(True)).alias("ordered"))
    span = times.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.round(F.min("s"), 6).alias("first_s"), F.round(F.max("s"), 6).alias("last_s"), (F.sum("n") - F.count("*")).alias("duplicate_count"))
    whole = span.crossJoin(ordered).crossJoin(middle.select(F.round("median_interval", 6).alias("median_interval"))).crossJoin(gaps).withColumn("sufficient", F.col("count") >= 2)
    return whole.select("count", "sufficient", *(F.when(F.col("sufficient"), F.col(c)).alias(c) for c in ("first_s", "last_s", "duplicate_count", "ordered", "median_interval", "gap_count")))


@nan_free
def plain_descriptives(df: DataFrame, columns: list[str], time: str | None = None) -> DataFrame:
    """column_name, mean, std (of the population), min, max, sum, first, last; the last
    two by ``time``."""
    ends = lambda c: (F.min_by(c, time), F.max_by(c, time)) if time else (F.lit(None).cast("double"),) * 2
    cells = [f.alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in zip(("m", "s", "lo", "hi", "t", "f", "l"), (F.avg(q(c)), F.stddev_pop(q(c)), F.min(q(c)).cast("double"), F.max(q(c)).cast("double"), F.sum(q(c)).cast("double"), *ends(q(c))))]
    row = df.agg(*cells)
    names = {"m": "mean", "s": "std", "lo": "min", "hi": "max", "t": "sum", "f": "first", "l": "last"}
    parts = F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.round(F.col(f"{k}{i}").cast("double"), 6).alias(v) for k, v in names.items())) for i, c in enumerate(columns)))
    return row.select(F.explode(parts).alias("p")).select("p.*")


@nan_free
def brief(df: DataFrame, column: str, most: int = 5) -> DataFrame:
    """value, n: the most frequent values, null among them."""
    return df.groupBy(q(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(most)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
