"""Registered queries of folds, models and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning, retrieval
from . import workflows
from .catalog import _r, register

register("hashed_folds", "SELECT o_orderkey, CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 5 AS INT) AS fold FROM orders")(lambda t: learning.hashed_folds(t("orders").select("o_orderkey"), "o_orderkey"))

#: What orders the rows of a supplier; rows that these don't tell apart are equal here.
_KEYS = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"]
_FEATURES = ["l_quantity", "l_discount"]


def _folds(by: str, table: str = "lineitem") -> str:
    return f"(SELECT *, greatest(0, 3 - CAST((n - upto) // (n // 4) AS INT)) AS fold FROM (SELECT *, count(*) OVER (PARTITION BY {by} ORDER BY {', '.join(_KEYS)}) AS upto, count(*) OVER (PARTITION BY {by}) AS n FROM {table}) WHERE n > 3)"


def _ridge(by: str, table: str = "lineitem", least: str = "p.fold < g.fold") -> str:
    """Closed form for two features and a penalty of 1: by, fold, n, a, b1, b2."""
    return f"""(SELECT g, fold, n, sy / n - b1 * s1 / n - b2 * s2 / n AS a, b1, b2 FROM (SELECT *, (c22 * c1y - c12 * c2y) / (c11 * c22 - c12 * c12) AS b1, (c11 * c2y - c12 * c1y) / (c11 * c22 - c12 * c12) AS b2 FROM
(SELECT g, fold, n, s1, s2, sy, s11 - s1 * s1 / n + 1 AS c11, s22 - s2 * s2 / n + 1 AS c22, s12 - s1 * s2 / n AS c12, s1y - s1 * sy / n AS c1y, s2y - s2 * sy / n AS c2y FROM
(SELECT {by} AS g, g.fold, count(*) AS n, sum(x) AS s1, sum(z) AS s2, sum(y) AS sy, sum(x * x) AS s11, sum(z * z) AS s22, sum(x * z) AS s12, sum(x * y) AS s1y, sum(z * y) AS s2y
FROM (SELECT *, l_quantity AS x, l_discount AS z, l_extendedprice AS y FROM {_folds(by, table)}) p JOIN (VALUES (1), (2), (3)) AS g(fold) ON {least} GROUP BY 1, 2))))"""


def _errors(by: str, table: str = "lineitem") -> str:
    return f"(SELECT p.{by} AS g, p.fold, count(*) AS tested, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, 1 - avg(e * e) / var_pop(l_extendedprice) AS r2 FROM (SELECT p.*, l_extendedprice - (a + b1 * l_quantity + b2 * l_discount) AS e FROM {_folds(by, table)} p JOIN {_ridge(by, table)} m ON m.g = p.{by} AND m.fold = p.fold) p GROUP BY 1, 2)"


register("time_folds_by_group", f"SELECT l_suppkey, fold, count(*) AS n, min(l_shipdate) AS first, max(l_shipdate) AS last FROM {_folds('l_suppkey')} GROUP BY 1, 2")(
    lambda t: learning.grouped_time_folds(t("lineitem"), "l_suppkey", _KEYS).groupBy("l_suppkey", "fold").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last")))
register("ridge_time_folds", f"SELECT m.g AS l_suppkey, m.fold, m.n, round(a, 4) AS intercept, round(b1, 4) AS b_quantity, round(b2, 4) AS b_discount, tested, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(r2, 6) AS r2 FROM {_ridge('l_suppkey')} m JOIN {_errors('l_suppkey')} e ON e.g = m.g AND e.fold = m.fold")(
    lambda t: learning.ridge_over_time(t("lineitem"), "l_extendedprice", _FEATURES, "l_suppkey", _KEYS)
    .select("l_suppkey", "fold", "n", F.round("intercept", 4).alias("intercept"), F.round(F.get("coefficients", F.lit(0)), 4).alias("b_quantity"), F.round(F.get("coefficients", F.lit(1)), 4).alias("b_discount"), "tested", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2")))

_SPACE = {"RandomForest": {"numTrees": (5, 10), "maxDepth": (3, 5)}, "GBT": {"maxIter": (2, 4), "maxDepth": (2, 3)}}


def _searched(t):
    found = learning.train(t("part"), ["p_retailprice"], ["p_size", "p_partkey"], "p_partkey", _SPACE, draws=2, tune_folds=2, folds=2)
    return found.results.join(F.broadcast(found.best().select("target", F.col("model").alias("best"))), "target").withColumn("best", F.col("best") == F.col("model"))


register("train_search", None)(_searched)

# --- scoring ----------------------------------------------------------------------

_ASKED = "l_orderkey, l_linenumber, CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 13 = 0 THEN 'n/a' ELSE CAST(l_quantity AS {text}) END AS l_quantity, CASE WHEN l_orderkey % 17 = 0 THEN CAST('NaN' AS DOUBLE) WHEN l_orderkey % 19 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_discount END AS l_discount"
_RANGES = {"l_quantity": (1.0, 45.0), "l_discount": (0.0, 0.0999)}


def _asked(t):
    return t("lineitem").selectExpr(*_cells(_ASKED.format(text="STRING")))


def _cells(sql: str) -> list[str]:
    from .text_queries import _split

    return _split(sql)


_BAD = "nullif(concat_ws(', ', CASE WHEN l_quantity = 'n/a' THEN 'l_quantity' END, CASE WHEN isnan(l_discount) OR isinf(l_discount) THEN 'l_discount' END), '')"
_MISSING = "nullif(concat_ws(', ', CASE WHEN l_quantity IS NULL THEN 'l_quantity' END, CASE WHEN l_discount IS NULL THEN 'l_discount' END), '')"
register("predict_batch", f"""WITH m AS (SELECT sy / n - b1 * s1 / n - b2 * s2 / n AS a, b1, b2 FROM (SELECT *, (c22 * c1y - c12 * c2y) / (c11 * c22 - c12 * c12) AS b1, (c11 * c2y - c12 * c1y) / (c11 * c22 - c12 * c12) AS b2 FROM (SELECT count(*) AS n, sum(l_quantity) AS s1, sum(l_discount) AS s2, sum(l_extendedprice) AS sy,
  sum(l_quantity * l_quantity) - s1 * s1 / n + 1 AS c11, sum(l_discount * l_discount) - s2 * s2 / n + 1 AS c22, sum(l_quantity * l_discount) - s1 * s2 / n AS c12, sum(l_quantity * l_extendedprice) - s1 * sy / n AS c1y, sum(l_discount * l_extendedprice) - s2 * sy / n AS c2y FROM lineitem))),
a AS (SELECT {_ASKED.format(text='VARCHAR')} FROM lineitem), c AS (SELECT *, {_MISSING} AS gone, {_BAD} AS bad FROM a),
i AS (SELECT *, nullif(concat_ws('; ', 'Missing values: ' || gone, 'Invalid values: ' || bad), '') AS issue, try_cast(l_quantity AS DOUBLE) AS x FROM c)
SELECT l_orderkey, l_linenumber, CASE WHEN issue IS NULL THEN round(a + b1 * x + b2 * l_discount, 4) END AS prediction, issue IS NULL AS valid, issue,
  concat_ws('; ', CASE WHEN x < 1 OR x > 45 THEN '''l_quantity'' is outside [1, 45]' END, CASE WHEN NOT isnan(l_discount) AND NOT isinf(l_discount) AND (l_discount < 0 OR l_discount > 0.0999) THEN '''l_discount'' is outside [0, 0.0999]' END) AS warnings FROM i, m""")(
    lambda t: _r(learning.predict(_asked(t), learning.by_line(learning.ridge(learning.moments(t("lineitem"), "l_extendedprice", _FEATURES)), _FEATURES), _RANGES))
    .select("l_orderkey", "l_linenumber", F.round("prediction", 4).alias("prediction"), "valid", "issue", F.array_join("warnings", "; ").alias("warnings")))

_ITEM = "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_size AS {text}) END AS p_size, p_retailprice / 100 AS price"
_KNOWN = "(SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice / 100 AS z FROM part WHERE p_partkey % 2 = 1)"
register("calculator", f"""WITH m AS (SELECT sy / n - b1 * s1 / n - b2 * s2 / n AS a, b1, b2 FROM (SELECT *, (c22 * c1y - c12 * c2y) / (c11 * c22 - c12 * c12) AS b1, (c11 * c2y - c12 * c1y) / (c11 * c22 - c12 * c12) AS b2 FROM (SELECT count(*) AS n, sum(x) AS s1, sum(z) AS s2, sum(p_partkey) AS sy,
  sum(x * x) - s1 * s1 / n + 1 AS c11, sum(z * z) - s2 * s2 / n + 1 AS c22, sum(x * z) - s1 * s2 / n AS c12, sum(x * p_partkey) - s1 * sy / n AS c1y, sum(z * p_partkey) - s2 * sy / n AS c2y FROM {_KNOWN}))),
i AS (SELECT p_partkey, try_cast(p_size AS DOUBLE) AS x, price AS z FROM (SELECT p_partkey, {_ITEM.format(text='VARCHAR')} FROM part) WHERE p_partkey % 50 = 0),
d AS (SELECT i.p_partkey, round(min(sqrt((i.x - k.x) * (i.x - k.x) + (i.z - k.z) * (i.z - k.z))), 6) AS distance FROM i, {_KNOWN} k WHERE i.x IS NOT NULL GROUP BY 1)
SELECT i.p_partkey, CASE WHEN x IS NOT NULL THEN round(a + b1 * x + b2 * z, 4) END AS prediction, x IS NOT NULL AS valid, distance, CASE WHEN x IS NULL THEN 'failed' WHEN distance <= 1.05 THEN 'high' WHEN distance <= 1.82 THEN 'medium' ELSE 'low' END AS confidence FROM i CROSS JOIN m LEFT JOIN d USING (p_partkey)""")(
    lambda t: _calculated(t).select("p_partkey", F.round("prediction", 4).alias("prediction"), "valid", "distance", "confidence"))
register("nearest_distances", "SELECT q.vec_id AS query_id, round(min(list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[])), 6) AS distance FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id GROUP BY 1")(
    lambda t: retrieval.nearest_in_blocks(t("embeddings"), t("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))))


def _calculated(t):
    """The stated inputs, parts whose key is divisible by 50, against all training rows."""
    parts = t("part").selectExpr("p_partkey", "CAST(p_size AS DOUBLE) AS p_size", "p_retailprice / 100 AS price").where("p_partkey % 2 = 1")
    model = learning.ridge(learning.moments(parts, "p_partkey", ["p_size", "price"]))
    asked = t("part").selectExpr("p_partkey", *_cells(_ITEM.format(text="STRING"))).where("p_partkey % 50 = 0")
    return learning.calculate(asked, "p_partkey", learning.by_line(model, ["p_size", "price"]), {"p_size": (1, 50), "price": None}, parts, "p_partkey")


# --- workflows --------------------------------------------------------------------

_RULES = {"small_and_cheap": "l_quantity < 5 AND l_extendedprice < 2000", "never": "l_quantity < 0"}
_ONE = "(SELECT 0 AS g0, * FROM lineitem)"
_REPORT = " UNION ALL ".join(f"SELECT '{s}' AS section, '{n}' AS name, round(CAST({e} AS DOUBLE), 4) AS value FROM {f}" for s, n, e, f in (
    *(("statistics", n, e, "lineitem") for n, e in (("rows", "count(*)"), ("mean", "avg(l_extendedprice)"), ("std", "stddev_pop(l_extendedprice)"), ("min", "min(l_extendedprice)"), ("max", "max(l_extendedprice)"), ("total", "sum(l_extendedprice)"))),
    ("anomalies", "small_and_cheap", "count(*)", "lineitem WHERE l_quantity < 5 AND l_extendedprice < 2000"),
    *(("evaluation", n, e, _errors("g0", _ONE)) for n, e in (("folds", "count(*)"), ("mae", "avg(mae)"), ("rmse", "avg(rmse)"), ("r2", "avg(r2)"))),
))
register("workflow_demand", _REPORT + " UNION ALL SELECT 'regimes', l_returnflag, round(avg(l_extendedprice), 4) FROM lineitem GROUP BY l_returnflag")(
    lambda t: workflows.demand(t("lineitem"), "l_extendedprice", _FEATURES, "l_returnflag", _KEYS, _RULES))
register("workflow_productivity", None)(
    lambda t: workflows.productivity(t("part"), "p_retailprice", ["p_size", "p_partkey"], "p_partkey", {"small": "p_size < 3"}, trees=5, depth=3, folds=2))
