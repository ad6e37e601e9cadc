"""Registered queries over values that are easily taken wrong: NaN in place of gaps, whole
numbers beyond a double's digits, days and times given as text, row ids that are texts.

The SQL has a null wherever the Spark table has NaN.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fidelity
from ..operators import cleaning, profile, query, relate, retrieval
from ..sources import normalise
from .catalog import _r, register

_X, _Y = "event_id % 7 = 0", "event_id % 13 = 5"


def _nan(t):
    """events with NaN in value, and in a second number beside it."""
    return t("events").selectExpr("event_id", "user_id", "event_type", f"CASE WHEN {_X} THEN CAST('NaN' AS DOUBLE) ELSE value END AS value", f"CASE WHEN {_Y} THEN CAST('NaN' AS DOUBLE) ELSE value * (event_id % 10) END AS other")


NAN = f"(SELECT event_id, user_id, event_type, CASE WHEN {_X} THEN NULL ELSE value END AS value, CASE WHEN {_Y} THEN NULL ELSE value * (event_id % 10) END AS other FROM events)"
_COUNTS = "SELECT '{c}' AS column_name, count({c}) AS non_null, count(*) - count({c}) AS missing, round(CAST(count(*) - count({c}) AS DOUBLE) / count(*), 6) AS missing_rate, count(DISTINCT {c}) AS unique_count, round(CAST(count(DISTINCT {c}) AS DOUBLE) / count({c}), 6) AS cardinality FROM " + NAN
_COLUMNS = ("event_id", "user_id", "event_type", "value", "other")
register("nan_counts", " UNION ALL ".join(_COUNTS.format(c=c) for c in _COLUMNS))(lambda t: profile.attribute_counts(_nan(t)))
register("nan_distribution", f"""SELECT count(value) AS count, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance, round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.25), 6) AS q25, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75,
round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(skewness(value), 6) AS skewness, round(kurtosis(value), 6) AS kurtosis, round(avg(CASE WHEN value = 0 THEN 1.0 WHEN value IS NOT NULL THEN 0.0 END), 6) AS zero_fraction FROM {NAN}""")(lambda t: profile.distribution(_nan(t), "value"))
_FAR = f"(SELECT column_name, x, q1, q3, m, median(abs(x - m)) OVER (PARTITION BY column_name) AS mad FROM (SELECT column_name, x, quantile_cont(x, 0.25) OVER w AS q1, quantile_cont(x, 0.75) OVER w AS q3, median(x) OVER w AS m FROM (SELECT 'value' AS column_name, value AS x FROM {NAN} UNION ALL SELECT 'other', other FROM {NAN}) WHERE x IS NOT NULL WINDOW w AS (PARTITION BY column_name)))"
register("nan_shapes", f"SELECT column_name, count(*) FILTER (q3 > q1 AND (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))) AS iqr_outliers, count(*) FILTER (mad > 0 AND abs(x - m) > 3 * 1.4826 * mad) AS mad_outliers, round(skewness(x), 6) AS skewness FROM {_FAR} GROUP BY 1")(lambda t: profile.shapes(_nan(t), ["value", "other"]))
_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
register("nan_spearman", f"SELECT n, round(corr(x, y), 6) AS rho FROM (SELECT {_RANK.format(c='value')} AS x, {_RANK.format(c='other')} AS y, count(*) OVER () AS n FROM {NAN} WHERE value IS NOT NULL AND other IS NOT NULL) GROUP BY n")(lambda t: relate.spearman(_nan(t), "value", "other"))
register("nan_imputed", f"SELECT event_id, round(coalesce(value, (SELECT median(value) FROM {NAN})), 6) AS value FROM {NAN}")(lambda t: _r(cleaning.imputed(_nan(t), "value").select("event_id", "value"), "value"))
register("nan_group_mean", f"SELECT event_type, round(avg(value), 6) AS value FROM {NAN} WHERE event_type IS NOT NULL GROUP BY 1")(lambda t: _r(query.aggregate(_nan(t), "value", "mean", "event_type"), "value"))
#: Vectors with an entry that is NaN, or with one entry less, have no score.
register("unscored_vectors", "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], " + str([1.0] * 64) + "::DOUBLE[]), 6) AS score FROM embeddings WHERE vec_id % 5 <> 0 AND vec_id % 5 <> 1 ORDER BY score DESC, vec_id LIMIT 10")(
    lambda t: retrieval.top_k(t("embeddings").selectExpr("vec_id", "CASE WHEN vec_id % 5 = 0 THEN concat(slice(embedding, 1, 63), array(CAST('NaN' AS FLOAT))) WHEN vec_id % 5 = 1 THEN slice(embedding, 1, 63) ELSE embedding END AS embedding"), [1.0] * 64, 10))

# --- literals -----------------------------------------------------------------

_BIG = 2**53
register("filter_long_digits", f"SELECT o_orderkey, o_orderkey + {_BIG} AS big FROM orders WHERE o_orderkey + {_BIG} IN ({_BIG + 1}, {_BIG + 3}, {_BIG + 32})")(
    lambda t: query.filter_rows(t("orders").selectExpr("o_orderkey", f"o_orderkey + {_BIG}L AS big"), "big", "in", f"{_BIG + 1}, {_BIG + 3}, {_BIG + 32}"))
register("filter_days", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-06-01'")(
    lambda t: query.filter_rows(t("orders").selectExpr("o_orderkey", "CAST(o_orderdate AS DATE) AS day"), "day", "ge", "1997-06-01"))
register("filter_times", "SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-05 12:30:00'")(lambda t: query.filter_rows(t("events").select("event_id", "ts"), "ts", "lt", "2024-01-05T12:30:00"))
register("filter_fraction", "SELECT p_partkey, p_size FROM part WHERE p_size > 25.5")(lambda t: query.filter_rows(t("part").select("p_partkey", "p_size"), "p_size", "gt", "25.5"))

# --- row ids that are texts, facts in other forms, normal forms -------------------

_TEXT_ROW = "printf('row-%08d', event_id)"
register("temporal_text_rows", """SELECT count(*) AS count, true AS sufficient, round(min(s), 6) AS first_s, round(max(s), 6) AS last_s, count(*) - count(DISTINCT s) AS duplicate_count, bool_and(s >= p) AS ordered, round(median(d), 6) AS median_interval, count(*) FILTER (d > 1.5 * m) AS gap_count
FROM (SELECT *, median(d) OVER () AS m FROM (SELECT s, s - lag(s) OVER (ORDER BY s) AS d, coalesce(lag(s) OVER (ORDER BY r), s) AS p FROM (SELECT epoch_us(ts) / 1000000.0::DOUBLE AS s, printf('row-%08d', event_id) AS r FROM events)))""")(
    lambda t: profile.temporal(t("events").select("ts", F.format_string("row-%08d", "event_id").alias("r")), "ts", "r"))
register("fact_forms", "SELECT l_orderkey, l_linenumber, l_linenumber % 3 <> 2 AS passed FROM lineitem")(
    lambda t: t("lineitem").select("l_orderkey", "l_linenumber", fidelity.keeps_facts(
        F.concat(F.lit("A discount of "), F.col("l_discount").cast("string"), F.lit(" applies.")), F.create_map(F.lit("share"), F.col("l_discount")),
        F.expr("CASE l_linenumber % 3 WHEN 0 THEN concat('It is ', CAST(round(l_discount * 100) AS INT), '%.') WHEN 1 THEN concat('It is ', l_discount) ELSE 'It is 99.' END")).alias("passed")))
#: Cutting the normal form of a document gives the chunks of the document.
register("normal_documents", "SELECT 'docs/' || item_id || '.txt' AS source, CAST(0 AS BIGINT) AS position, 'heat' AS topic, 'overview' AS section, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS content FROM benchmark UNION ALL SELECT 'docs/' || item_id || '.txt', 1, 'heat', 'key limits', 'none seen' FROM benchmark")(
    lambda t: _normal(t).select("source", "position", "topic", "section", "content"))


def _normal(t):
    from ..functions import text

    raw = t("benchmark").selectExpr("concat('docs/', item_id, '.txt') AS source", "concat('TOPIC: Heat\\nSECTION: Overview\\n', text, '\\nSECTION: Key limits\\nnone   seen\\n') AS text")
    return text.chunks(normalise.documents_of(text.chunks(raw)))
_NEAR = {"l_quantity": "l_quantity", "l_twice": "l_quantity * 2 + l_tax", "l_tax": "l_tax"}
_STRONG = " UNION ALL ".join(f"SELECT '{a}' AS left_column, '{b}' AS right_column, count(*) AS n, round(corr({_NEAR[a]}, {_NEAR[b]}), 6) AS r FROM lineitem" for a, b in (("l_quantity", "l_twice"), ("l_quantity", "l_tax"), ("l_twice", "l_tax")))
register("strong_pairs", f"SELECT left_column, right_column, n, r, '''' || left_column || ''' and ''' || right_column || ''' are strongly correlated (' || printf('%.3f', r) || ').' AS message FROM ({_STRONG}) WHERE abs(r) >= 0.9")(
    lambda t: relate.strong_pairs(t("lineitem").selectExpr("l_quantity", "l_quantity * 2 + l_tax AS l_twice", "l_tax"), list(_NEAR)))
