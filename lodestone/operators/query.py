"""The constrained structured query: columns, statistics, filter, aggregate, top rows.

Requests are checked against the schema before any plan is built; a wrong request
is an answer with ``success`` false, never an exception.  Data stays lazy.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal, InvalidOperation
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import order

OPERATORS = ("eq", "ne", "gt", "lt", "ge", "le", "in")
AGGREGATES = ("mean", "sum", "count")


@dataclass(frozen=True)
class QueryResult:
    dataset_id: str
    operation: str
    success: bool
    data: DataFrame | None = None
    error: str | None = None
    metadata: dict[str, Any] = field(default_factory=dict)


def q(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _kind(df: DataFrame, column: str) -> T.DataType:
    if column not in df.columns:
        raise ValueError(f"Column not found: {column}")
    return df.schema[column].dataType


def missing_free(df: DataFrame) -> DataFrame:
    """One notion of missing: NaN becomes null."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(q(c), F.lit(None).cast(df.schema[c].dataType)) for c in floats}) if floats else df


def nan_free(run):
    """An operator to whose frames ``missing_free`` is applied first."""

    @functools.wraps(run)
    def wrapped(*args, **named):
        return run(*(missing_free(a) if isinstance(a, DataFrame) else a for a in args), **named)

    return wrapped


def columns(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(df.dtypes, "column_name string, data_type string")


@nan_free
def statistics(df: DataFrame, column: str | None = None) -> DataFrame:
    if column is None:
        return df.agg(F.count("*").alias("row_count"), F.lit(len(df.columns)).cast("long").alias("column_count"))
    c = q(column)
    if isinstance(_kind(df, column), T.NumericType):
        row = df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"), F.stddev_samp(c).alias("std"))
        middle = order.percentiles(df, c, [0.5]).select(F.get("p", F.lit(0)).alias("median"))
        return row.crossJoin(F.broadcast(middle)).select("count", "mean", "median", "min", "max", "std")
    # The most frequent value from one row per value; the smallest on ties.
    counted = df.where(c.isNotNull()).groupBy(c.alias("value")).agg(F.count("*").alias("n"))
    ranked = F.struct(F.col("n").alias("n"))
    top = F.max_by("value", ranked)
    best = counted.agg(F.sum("n").alias("count"), F.count("*").alias("unique"), F.max("n").alias("most"), top.alias("any"))
    least = counted.join(best.select("most"), F.col("n") == F.col("most")).agg(F.min("value").alias("top"))
    return best.select(F.coalesce("count", F.lit(0)).alias("count"), "unique").crossJoin(least)


def condition(df: DataFrame, column: str, operator: str, value: Any) -> Column:
    kind, c = _kind(df, column), q(column)
    if operator not in OPERATORS:
        raise ValueError(f"Unsupported operator: {operator}")
    if operator == "in":
        if isinstance(value, str):
            value = [v.strip() for v in value.split(",")]
        if not isinstance(value, (list, tuple, set)):
            raise ValueError("'in' needs a list of values")
        return c.isin([_literal(v, kind) for v in value])
    v = _literal(value, kind)
    # Not equal keeps rows without a value.
    return {"eq": c == v, "ne": ~c.eqNullSafe(v), "gt": c > v, "lt": c < v, "ge": c >= v, "le": c <= v}[operator]


def _literal(value: Any, kind: T.DataType) -> Column:
    """A value as the column's type has it; text is read, and what can't be is an error.
    A truth value equals 1 or 0, a whole number keeps all its digits, a time is given
    as ISO 8601 or as an object."""
    if value is None:
        raise ValueError("No value to compare with")
    if isinstance(kind, T.BooleanType):
        if isinstance(value, str) and value.strip().lower() in ("true", "false"):
            value = value.strip().lower() == "true"
        if isinstance(value, (bool, int, float)) and value in (0, 1):
            return F.lit(bool(value))
        raise ValueError(f"Not a truth value: {value!r}")
    if isinstance(kind, T.NumericType):
        return _number(value, kind)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return _time(value, kind)
    if isinstance(kind, T.StringType):
        return F.lit(value if isinstance(value, str) else str(value))
    raise ValueError(f"Columns of type {kind.simpleString()} can't be compared")


def _number(value: Any, kind: T.DataType) -> Column:
    if not isinstance(value, (str, int, float, Decimal)):
        raise ValueError(f"Not a number: {value!r}")
    try:
        exact = Decimal(value.strip() if isinstance(value, str) else value)
    except InvalidOperation:
        raise ValueError(f"Not a number: {value!r}") from None
    if exact.is_nan():
        raise ValueError(f"Not a number: {value!r}")
    if isinstance(kind, (T.DoubleType, T.FloatType)) or not exact.is_finite():
        return F.lit(float(exact))
    whole = exact == exact.to_integral_value()
    if whole and abs(exact) < 1 << 63:
        return F.lit(int(exact)).cast("long")
    # Numbers that no long holds, and fractions beside whole or decimal columns.
    digits = max(0, -exact.normalize().as_tuple().exponent)
    if digits <= 18 and abs(exact) < 10**19:
        return F.lit(str(exact)).cast(T.DecimalType(38, digits))
    return F.lit(float(exact))


def _time(value: Any, kind: T.DataType) -> Column:
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value.strip())
        except ValueError:
            raise ValueError(f"Not a date or time: {value!r}") from None
    if not isinstance(value, date):
        raise ValueError(f"Not a date or time: {value!r}")
    # A column of days is compared with a time of day as a time.
    plain = isinstance(kind, T.DateType) and not (isinstance(value, datetime) and (value.hour or value.minute or value.second or value.microsecond or value.tzinfo))
    text = value.isoformat()
    return F.lit(text[:10]).cast("date") if plain else F.lit(text).cast("timestamp" if isinstance(kind, T.DateType) else kind)


@nan_free
def filter_rows(df: DataFrame, column: str, operator: str, value: Any) -> DataFrame:
    return df.where(condition(df, column, operator, value))


@nan_free
def aggregate(df: DataFrame, agg_column: str | None = None, agg_func: str = "mean", group_by: str | None = None) -> DataFrame:
    """Without a group: ``count`` counts rows.  With one: it counts values, rows
    without a key go, and a group of missing values sums to 0."""
    if agg_func not in AGGREGATES:
        raise ValueError(f"Unsupported aggregation: {agg_func}")
    if agg_column is not None and agg_func != "count" and not isinstance(_kind(df, agg_column), (T.NumericType, T.BooleanType)):
        raise ValueError(f"Column is not numeric: {agg_column}")
    if group_by is None:
        _kind(df, agg_column or "")
        c = q(agg_column) if agg_func == "count" else q(agg_column).cast("double")
        return df.agg({"mean": F.avg(c), "sum": F.coalesce(F.sum(c), F.lit(0.0)), "count": F.count("*")}[agg_func].cast("double").alias("value"))
    _kind(df, group_by)
    groups = df.where(q(group_by).isNotNull()).groupBy(q(group_by).alias(group_by))
    if agg_column is None:
        return groups.agg(F.count("*").alias("value"))
    _kind(df, agg_column)
    c = q(agg_column)
    if isinstance(df.schema[agg_column].dataType, T.BooleanType) and agg_func != "count":
        c = c.cast("double")
    return groups.agg({"mean": F.avg(c), "sum": F.coalesce(F.sum(c), F.lit(0.0)), "count": F.count(c)}[agg_func].alias("value"))


@nan_free
def top_rows(df: DataFrame, column: str, n: int = 5, ascending: bool = False, *ties: str) -> DataFrame:
    """Missing values come last either way; plans as one top-n, not a sort."""
    if not isinstance(_kind(df, column), T.NumericType):
        raise ValueError(f"Column is not numeric: {column}")
    if not isinstance(n, int) or isinstance(n, bool) or n < 1:
        raise ValueError(f"Not a positive whole number of rows: {n!r}")
    c = q(column)
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), *(q(t) for t in ties)).limit(n)


def query_dataset(datasets: dict[str, DataFrame], dataset_id: str, operation: str, **args: Any) -> QueryResult:
    run = {"get_columns": columns, "get_statistics": statistics, "filter_rows": filter_rows, "aggregate": aggregate, "get_top_rows": top_rows}
    try:
        if dataset_id not in datasets:
            raise ValueError(f"Unknown dataset: {dataset_id}")
        if operation not in run:
            raise ValueError(f"Unknown operation: {operation}")
        data = run[operation](datasets[dataset_id], **args)
        data.schema  # noqa: B018  resolved here, so that what can't be resolved is an answer
        return QueryResult(dataset_id, operation, True, data, metadata=dict(args))
    except (ValueError, TypeError, PySparkException, Py4JError) as error:
        return QueryResult(dataset_id, operation, False, error=str(error), metadata=dict(args))
