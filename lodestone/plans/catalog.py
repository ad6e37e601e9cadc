"""The registered queries of the library's own operators, and their SQL.

Tables without gaps get planted ones by deterministic projections, the same in
both engines.  Doubles are rounded to six digits.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import domain, text
from ..operators import cleaning, evaluate, learning, order, profile, query, relate, retrieval
from ..sources import catalogue, loaders

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _r(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _planted(t):
    """events with missing values and missing keys"""
    return t("events").withColumn("value", F.expr("CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END")).withColumn("event_type", F.expr("CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END"))


EVENTS = "(SELECT event_id, ts, user_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, props FROM events)"


def register(name: str, sql: str | None):
    def wrap(build):
        QUERIES[name] = lambda spark, sf_dir: build(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            SQL[name] = sql
        return build

    return wrap


# --- structured query ---------------------------------------------------------

register("columns_types", "SELECT * FROM (VALUES ('r_regionkey', 'int'), ('r_name', 'string')) AS t(column_name, data_type)")(lambda t: query.columns(t("region")))
register("stats_numeric", "SELECT count(l_extendedprice) AS count, round(avg(l_extendedprice), 6) AS mean, round(median(l_extendedprice), 6) AS median, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(stddev_samp(l_extendedprice), 6) AS std FROM lineitem")(
    lambda t: _r(query.statistics(t("lineitem"), "l_extendedprice"), "mean", "median", "std"))
register("stats_text", "SELECT count(o_orderpriority) AS count, count(DISTINCT o_orderpriority) AS \"unique\", (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top FROM orders")(lambda t: query.statistics(t("orders"), "o_orderpriority"))
register("stats_dataset", "SELECT count(*) AS row_count, CAST(6 AS BIGINT) AS column_count FROM orders")(lambda t: query.statistics(t("orders")))
for _op, _sql in {"eq": "= 'F'", "ne": "IS DISTINCT FROM 'F'", "in": "IN ('F', 'P')"}.items():
    register(f"filter_{_op}", f"SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus {_sql}")(lambda t, op=_op: query.filter_rows(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", op, "F, P" if op == "in" else "F"))
for _op, _sql in {"gt": ">", "lt": "<", "ge": ">=", "le": "<="}.items():
    register(f"filter_{_op}", f"SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity {_sql} 25")(lambda t, op=_op: query.filter_rows(t("lineitem").select("l_orderkey", "l_partkey", "l_quantity"), "l_quantity", op, 25.0))
register("filter_ne_keeps_missing", f"SELECT event_id, value FROM {EVENTS} WHERE value IS DISTINCT FROM 1.0")(lambda t: query.filter_rows(_planted(t).select("event_id", "value"), "value", "ne", 1.0))
for _f, _sql in {"mean": "avg(l_quantity)", "sum": "coalesce(sum(l_quantity), 0)", "count": "count(*)"}.items():
    register(f"agg_global_{_f}", f"SELECT round(CAST({_sql} AS DOUBLE), 6) AS value FROM lineitem")(lambda t, f=_f: _r(query.aggregate(t("lineitem"), "l_quantity", f), "value"))
for _f, _sql in {"mean": "avg(value)", "sum": "coalesce(sum(value), 0)", "count": "count(value)"}.items():
    register(f"agg_group_{_f}", f"SELECT event_type, round({_sql}, 6) AS value FROM {EVENTS} WHERE event_type IS NOT NULL GROUP BY 1")(lambda t, f=_f: _r(query.aggregate(_planted(t), "value", f, "event_type"), "value"))
register("agg_group_size", f"SELECT event_type, count(*) AS value FROM {EVENTS} WHERE event_type IS NOT NULL GROUP BY 1")(lambda t: query.aggregate(_planted(t), group_by="event_type"))
for _d, _asc in {"DESC": False, "ASC": True}.items():
    register(f"top_rows_{_d.lower()}", f"SELECT event_id, value FROM {EVENTS} ORDER BY value {_d} NULLS LAST, event_id LIMIT 10")(lambda t, a=_asc: query.top_rows(_planted(t).select("event_id", "value"), "value", 10, a, "event_id"))

# --- profile ------------------------------------------------------------------

register("profile_dataset", "SELECT count(*) AS row_count, CAST(2 AS BIGINT) AS column_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS duplicate_rows FROM lineitem")(lambda t: profile.dataset_counts(t("lineitem").select("l_orderkey", "l_linenumber")))
_COUNTS = "SELECT '{c}' AS column_name, count({c}) AS non_null, count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*), 6) AS missing_rate, count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) / count({c}), 6) AS cardinality FROM " + EVENTS
register("profile_counts", " UNION ALL ".join(_COUNTS.format(c=c) for c in ("event_id", "user_id", "event_type", "value")))(lambda t: profile.attribute_counts(_planted(t).select("event_id", "user_id", "event_type", "value")))
_DIST = """SELECT count(x) AS count, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(var_samp(x), 6) AS variance, round(stddev_samp(x), 6) AS std, round(quantile_cont(x, 0.25), 6) AS q25, round(median(x), 6) AS median,
round(quantile_cont(x, 0.75), 6) AS q75, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr, round(skewness(x), 6) AS skewness, round(kurtosis(x), 6) AS kurtosis, round(avg(CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_fraction FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {t})"""
register("profile_distribution", _DIST.format(c="value", t="events"))(lambda t: profile.distribution(t("events"), "value"))
register("profile_distribution_ints", _DIST.format(c="n_chars", t="documents"))(lambda t: profile.distribution(t("documents").withColumn("n_chars", F.col("n_chars").cast("double")), "n_chars"))
register("outliers", """WITH f AS (SELECT quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3 FROM events), m AS (SELECT median(abs(value - med)) AS mad FROM events, f)
SELECT count(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1 END) AS iqr_outliers, count(CASE WHEN abs(value - med) > 3 * 1.4826 * mad THEN 1 END) AS mad_outliers, round(any_value(mad), 6) AS mad FROM events, f, m""")(lambda t: profile.outliers(t("events"), "value"))
register("value_frequencies", "SELECT CAST(l_suppkey AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 20")(lambda t: profile.value_frequencies(t("lineitem"), "l_suppkey"))
register("text_lengths", "SELECT CAST(min(length(text)) AS BIGINT) AS min_length, CAST(max(length(text)) AS BIGINT) AS max_length, round(avg(length(text)), 6) AS mean_length FROM documents")(lambda t: profile.text_lengths(t("documents"), "text"))
register("mixed_parse_fraction", r"SELECT round(avg(CASE WHEN regexp_matches(x, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$') THEN 1.0 ELSE 0.0 END), 6) AS numeric_fraction FROM (SELECT CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE CAST(user_id AS VARCHAR) END AS x FROM events)")(
    lambda t: profile.parse_fraction(t("events").selectExpr("CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE CAST(user_id AS STRING) END AS x"), "x"))
_FLAGS = """SELECT '{c}' AS column_name, count(DISTINCT {c}) = 0 AS empty, count(DISTINCT {c}) = 1 AS constant, count(DISTINCT {c}) / count({c}) <= 0.01 AND count(DISTINCT {c}) > 1 AS near_constant, count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AS candidate_key, '{n}' IN ('id', 'index', 'row_id', 'record_id') AS candidate_index, count(DISTINCT {c}) > 0 AND count(DISTINCT {c}) = count({c}) AND (contains('{n}', 'id') OR '{n}' IN ('key', 'index')) AS candidate_identifier,
{k} = 'categorical' AND count(DISTINCT {c}) BETWEEN 2 AND least(20, greatest(2, floor(count({c}) / 5))) AS candidate_grouping, {k} = 'numeric' AND regexp_matches('{n}', 'target|label|outcome|result|score|temperature') AS candidate_target FROM part"""
#: The kind of a text column without times, and of a number.
_TEXT_KIND = "CASE WHEN count({c}) = 0 THEN 'unknown' WHEN count(DISTINCT {c}) / count({c}) <= 0.2 OR avg(length({c})) <= 24 THEN 'categorical' ELSE 'text' END"
_PART = {"p_partkey": ("record_id", None), "p_name": ("p_name", 1), "p_brand": ("p_brand", 1), "p_size": ("result_size", None), "p_type": ("p_type", 1)}
register("structure_flags", " UNION ALL ".join(_FLAGS.replace("'{c}' AS column_name", "'{n}' AS column_name").format(c=c, n=n, k=_TEXT_KIND.format(c=c) if t else "'numeric'") for c, (n, t) in _PART.items()))(lambda t: profile.structure(t("part").select(*(F.col(c).alias(n) for c, (n, _) in _PART.items()))))
register("column_kinds", " UNION ALL ".join(f"(SELECT '{n}' AS column_name, {_TEXT_KIND.format(c=c) if t else chr(39) + 'numeric' + chr(39)} AS kind FROM part" + (")" if t else " LIMIT 1)") for c, (n, t) in _PART.items()) + " UNION ALL SELECT 'stamp', CASE WHEN avg(CASE WHEN p_partkey % 20 = 0 THEN 0.0 ELSE 1.0 END) >= 0.9 THEN 'temporal' ELSE 'text' END FROM part UNION ALL SELECT 'flag', 'boolean' UNION ALL SELECT 'nothing', 'unknown'")(
    lambda t: profile.column_kinds(t("part").select(*(F.col(c).alias(n) for c, (n, _) in _PART.items()), F.expr("CASE WHEN p_partkey % 20 = 0 THEN 'never' WHEN p_partkey % 2 = 0 THEN concat('2024-01-', lpad(p_size % 28 + 1, 2, '0')) ELSE concat(lpad(p_size % 28 + 1, 2, '0'), '/01/2024 10:30') END").alias("stamp"), F.lit(True).alias("flag"), F.lit(None).cast("string").alias("nothing"))))
register("type_counts", "SELECT kind, count(*) AS n FROM (" + " UNION ALL ".join(f"(SELECT {_TEXT_KIND.format(c=c) if t else chr(39) + 'numeric' + chr(39)} AS kind FROM part" + (")" if t else " LIMIT 1)") for c, (n, t) in _PART.items()) + ") GROUP BY 1")(lambda t: profile.type_counts(t("part").select(*_PART)))
register("plain_descriptives", " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max, round(CAST(sum({c}) AS DOUBLE), 6) AS sum, round(CAST(arg_min({c}, event_id) AS DOUBLE), 6) AS first, round(CAST(arg_max({c}, event_id) AS DOUBLE), 6) AS last FROM events" for c in ("value", "user_id")))(lambda t: profile.plain_descriptives(t("events"), ["value", "user_id"], "event_id"))
register("brief_values", "SELECT CAST(event_type AS VARCHAR) AS value, count(*) AS n FROM " + EVENTS + " GROUP BY 1 ORDER BY n DESC, value NULLS LAST LIMIT 5")(lambda t: profile.brief(_planted(t), "event_type"))
register("temporal_props", """WITH s AS (SELECT event_id, epoch_us(ts) / 1e6 AS s FROM events), d AS (SELECT s - lag(s) OVER (ORDER BY s) AS d FROM s), m AS (SELECT median(d) AS m FROM d WHERE d IS NOT NULL), o AS (SELECT s >= lag(s) OVER (ORDER BY event_id) AS up FROM s)
SELECT (SELECT count(*) FROM s) AS count, (SELECT round(min(s), 6) FROM s) AS first_s, (SELECT round(max(s), 6) FROM s) AS last_s, (SELECT count(*) - count(DISTINCT s) FROM s) AS duplicate_count, (SELECT bool_and(up) FROM o) AS ordered, (SELECT round(m, 6) FROM m) AS median_interval, (SELECT count(*) FROM d, m WHERE m <> 0 AND d > 1.5 * m) AS gap_count, true AS sufficient""")(
    lambda t: profile.temporal(t("events"), "ts", "event_id"))
register("temporal_zero_median", """SELECT (SELECT count(*) FROM events) AS count, true AS sufficient, (SELECT count(*) - count(DISTINCT date_trunc('day', ts)) FROM events) AS duplicate_count, CAST(0 AS BIGINT) AS gap_count, 0.0::DOUBLE AS median_interval""")(
    lambda t: profile.temporal(t("events").withColumn("ts", F.date_trunc("day", F.col("ts").cast("timestamp"))), "ts", "event_id").select("count", "sufficient", "duplicate_count", "gap_count", "median_interval"))

# --- relationships ------------------------------------------------------------

_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
register("pearson_pairs", " UNION ALL ".join(f"SELECT '{a}' AS left_column, '{b}' AS right_column, count(*) AS n, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]))(lambda t: relate.pearson_pairs(t("lineitem"), list(_NUM)))
register("spearman", "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS y FROM lineitem) SELECT count(*) AS n, round(corr(x, y), 6) AS rho FROM r")(lambda t: relate.spearman(t("lineitem"), "l_quantity", "l_extendedprice"))
register("cramers_v", """WITH c AS (SELECT l_returnflag a, l_linestatus b, count(*) o FROM lineitem GROUP BY 1, 2), m AS (SELECT a, b, o, sum(o) OVER (PARTITION BY a) r, sum(o) OVER (PARTITION BY b) k FROM c)
SELECT CAST(sum(o) AS BIGINT) AS n, round(sqrt(greatest(sum(CAST(o AS DOUBLE) * o / (CAST(r AS DOUBLE) * k)) - 1, 0) / greatest(1, least(count(DISTINCT a), count(DISTINCT b)) - 1)), 6) AS v FROM m""")(lambda t: relate.cramers_v(t("lineitem"), "l_returnflag", "l_linestatus"))
register("group_mean_spread", f"SELECT count(*) AS groups, round(max(m) - min(m), 6) AS spread FROM (SELECT avg(value) AS m FROM {EVENTS} GROUP BY event_type) WHERE m IS NOT NULL")(lambda t: relate.group_spread(_planted(t), "event_type", "value"))

_TWIN = "(SELECT l_quantity, l_extendedprice, l_quantity * 2 + l_tax AS twin, power(l_quantity, 9) AS steep FROM lineitem)"
_FOUR = ("l_quantity", "l_extendedprice", "twin", "steep")
register("relationships", "WITH p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS left_column, '{b}' AS right_column, count(*) AS n, round(corr({a}, {b}), 6) AS pearson, (SELECT round(corr(x, y), 6) FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS x, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS y FROM {_TWIN})) AS spearman FROM {_TWIN}" for i, a in enumerate(_FOUR) for b in _FOUR[i + 1 :]) + ") SELECT *, CASE WHEN abs(pearson) >= 0.8 THEN 'pearson' ELSE 'spearman' END AS method FROM p WHERE abs(CASE WHEN abs(pearson) >= 0.8 THEN pearson ELSE spearman END) >= 0.7")(
    lambda t: relate.relationships(t("lineitem").selectExpr("l_quantity", "l_extendedprice", "l_quantity * 2 + l_tax AS twin", "power(l_quantity, 9) AS steep"), list(_FOUR)))
_TABLE = """WITH c AS (SELECT l_returnflag a, {b} b, count(*) o FROM lineitem GROUP BY 1, 2), g AS (SELECT a, b FROM (SELECT DISTINCT a FROM c), (SELECT DISTINCT b FROM c)), m AS (SELECT g.a, g.b, coalesce(o, 0) AS o, sum(coalesce(o, 0)) OVER (PARTITION BY g.a) * sum(coalesce(o, 0)) OVER (PARTITION BY g.b) / sum(coalesce(o, 0)) OVER () AS e FROM g LEFT JOIN c ON g.a = c.a AND g.b = c.b)
SELECT {names}CAST(sum(o) AS BIGINT) AS n, {sizes}round(sum((o - e) * (o - e) / e), 6) AS chi_square, round(sqrt(sum((o - e) * (o - e) / e) / (sum(o) * greatest(1, least(count(DISTINCT a), count(DISTINCT b)) - 1))), 6) AS v, round(min(e), 6) AS expected_min{flag} FROM m"""
register("contingency", _TABLE.format(b="l_linestatus", names="", sizes="count(DISTINCT a) AS rows, count(DISTINCT b) AS columns, ", flag=", true AS sufficient"))(lambda t: relate.contingency(t("lineitem"), "l_returnflag", "l_linestatus"))
_STATE = "CASE WHEN l_returnflag = 'R' THEN 'back' ELSE l_linestatus END"
register("associations", "SELECT * FROM (" + _TABLE.format(b=_STATE, names="'l_returnflag' AS left_column, 'state' AS right_column, ", sizes="", flag="") + ") WHERE v >= 0.3")(lambda t: relate.associations(t("lineitem").selectExpr("l_returnflag", "l_linestatus", _STATE + " AS state").drop("l_linestatus"), ["l_returnflag", "state"]))
register("target_correlations", "WITH r AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, l_extendedprice), 6) AS r FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")) + ") SELECT feature, r FROM (SELECT *, row_number() OVER (ORDER BY r DESC, feature) a, row_number() OVER (ORDER BY r, feature) b FROM r) WHERE a <= 1 OR b <= 1")(lambda t: relate.target_correlations(t("lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], 1))

# --- cleaning -----------------------------------------------------------------

register("dup_keep_first", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k > 1")(lambda t: cleaning.duplicates(t("documents").select("doc_id", "text"), ["text"], "doc_id").select("doc_id"))
register("dup_conflicting_id", "WITH k AS (SELECT count(*) n FROM lineitem GROUP BY l_orderkey), r AS (SELECT count(*) n FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT *, repeated_key_rows > exact_duplicates AS conflicting FROM (SELECT CAST((SELECT sum(CASE WHEN n > 1 THEN n ELSE 0 END) FROM k) AS BIGINT) AS repeated_key_rows, CAST((SELECT sum(n - 1) FROM r) AS BIGINT) AS exact_duplicates)")(
    lambda t: cleaning.conflicting_keys(t("lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey"))
register("impute_median", f"SELECT event_id, round(coalesce(value, (SELECT median(value) FROM {EVENTS})), 6) AS value FROM {EVENTS}")(lambda t: _r(cleaning.imputed(_planted(t).select("event_id", "value"), "value"), "value"))
register("impute_mode", f"SELECT event_id, coalesce(event_type, (SELECT event_type FROM {EVENTS} WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS event_type FROM {EVENTS}")(lambda t: cleaning.imputed(_planted(t).select("event_id", "event_type"), "event_type", numeric=False))
register("changes_log", f"SELECT event_id AS row_id, 'value' AS field, 'impute_missing' AS operation, round((SELECT median(value) FROM {EVENTS}), 6) AS after FROM {EVENTS} WHERE value IS NULL")(lambda t: cleaning.changes(_planted(t), "value", "event_id"))
register("missingness_effect_size", f"""WITH s AS (SELECT count(CASE WHEN value IS NULL THEN 1 END) n1, count(CASE WHEN value IS NOT NULL THEN 1 END) n2, avg(CASE WHEN value IS NULL THEN user_id END) m1, avg(CASE WHEN value IS NOT NULL THEN user_id END) m2, var_samp(CASE WHEN value IS NULL THEN user_id END) v1, var_samp(CASE WHEN value IS NOT NULL THEN user_id END) v2 FROM {EVENTS})
SELECT n1, n2, round(least(1.0, abs(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) / 3.0), 6) AS effect FROM s""")(lambda t: cleaning.missingness_effect(_planted(t), "value", "user_id"))
register("missingness_cramers_v", f"""WITH c AS (SELECT value IS NULL AS a, event_type AS b, count(*) o FROM {EVENTS} WHERE event_type IS NOT NULL GROUP BY 1, 2), m AS (SELECT a, b, o, sum(o) OVER (PARTITION BY a) r, sum(o) OVER (PARTITION BY b) k FROM c)
SELECT CAST(sum(o) AS BIGINT) AS n, round(sqrt(greatest(sum(CAST(o AS DOUBLE) * o / (CAST(r AS DOUBLE) * k)) - 1, 0) / greatest(1, least(count(DISTINCT a), count(DISTINCT b)) - 1)), 6) AS v FROM m""")(lambda t: relate.cramers_v(_planted(t).withColumn("gone", F.col("value").isNull()), "gone", "event_type"))
register("entropy_norm", "WITH c AS (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority), p AS (SELECT n / (SELECT sum(n) FROM c) AS p FROM c) SELECT count(*) AS categories, round(-sum(p * ln(p)) / ln(count(*)), 6) AS entropy FROM p")(lambda t: cleaning.entropy(t("orders"), "o_orderpriority"))
register("imputation_confidence", f"SELECT round(0.30 * least(0.95, count(value) / count(*)) + 0.25 * least(1.0, count(value) / 30) + 0.25 / (1 + abs(stddev_samp(value) / avg(value))) + 0.20, 6) AS confidence FROM {EVENTS}")(lambda t: cleaning.imputation_confidence(_planted(t), "value"))
_AFTER = f"(SELECT coalesce(value, (SELECT median(value) FROM {EVENTS})) AS value FROM {EVENTS})"
register("ks_shift", f"""WITH u AS (SELECT v, sum(a) a, sum(b) b FROM (SELECT value v, 1 a, 0 b FROM {EVENTS} WHERE value IS NOT NULL UNION ALL SELECT value, 0, 1 FROM {_AFTER}) GROUP BY v)
SELECT round(max(d), 4) AS ks FROM (SELECT abs(sum(a) OVER (ORDER BY v) / (SELECT sum(a) FROM u) - sum(b) OVER (ORDER BY v) / (SELECT sum(b) FROM u)) AS d FROM u)""")(lambda t: cleaning.ks_distance(_planted(t), cleaning.imputed(_planted(t), "value"), "value"))
register("moment_shift", f"""SELECT n_before, n_after, round(m2 - m1, 6) AS mean_shift, round((s2 - s1) / s1, 6) AS std_shift FROM (SELECT count(value) n_before, avg(value) m1, stddev_samp(value) s1 FROM {EVENTS}), (SELECT count(value) n_after, avg(value) m2, stddev_samp(value) s2 FROM {_AFTER})""")(
    lambda t: cleaning.moment_shift(_planted(t), cleaning.imputed(_planted(t), "value"), "value"))
register("tvd_shift", """WITH a AS (SELECT o_orderstatus v, count(*) / (SELECT count(*) FROM orders) p FROM orders GROUP BY 1), b AS (SELECT o_orderstatus v, count(*) / (SELECT count(*) FROM orders WHERE o_totalprice > 100000) r FROM orders WHERE o_totalprice > 100000 GROUP BY 1)
SELECT round(sum(abs(coalesce(p, 0) - coalesce(r, 0))) / 2, 6) AS tvd, count(CASE WHEN p IS NULL THEN 1 END) AS added, count(CASE WHEN r IS NULL THEN 1 END) AS removed FROM a FULL JOIN b USING (v)""")(lambda t: cleaning.total_variation(t("orders"), t("orders").where("o_totalprice > 100000"), "o_orderstatus"))

# --- retrieval and text -------------------------------------------------------

_QUERY = [((k * 37) % 11 - 5) / 10 for k in range(64)]
_LIST = "[" + ", ".join(map(str, _QUERY)) + "]::DOUBLE[]"
register("vector_topk", f"SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], {_LIST}), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")(lambda t: retrieval.top_k(t("embeddings"), _QUERY, 10))
register("vector_topk_filtered", f"SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], {_LIST}), 6) AS score FROM embeddings WHERE label = 1 ORDER BY score DESC, vec_id LIMIT 5")(lambda t: retrieval.top_k(t("embeddings").where("label = 1"), _QUERY, 5))
register("nearest_distance", f"SELECT d AS distance, CASE WHEN d <= 1.05 THEN 'high' WHEN d <= 1.82 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT round(min(list_distance(embedding::DOUBLE[], {_LIST})), 6) AS d FROM embeddings)")(lambda t: retrieval.nearest(t("embeddings"), _QUERY))


def _measured(e, asked, top):
    found = top(e, asked.select("query_id", "q"), 10).join(e.select("vec_id", "label"), "vec_id").join(asked.select("query_id", "wanted"), "query_id")
    sizes = e.groupBy(F.col("label").alias("wanted")).agg((F.count("*") - 1).alias("n_relevant"))
    return evaluate.retrieval_metrics(found.join(sizes, "wanted").withColumn("relevant", F.col("label") == F.col("wanted")), 5)


def _asked(e, which):
    return e.where(which).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("wanted"))


@register("retrieval_metrics", """WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_inner_product(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score, c.label = q.label AS relevant, q.label FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s), k AS (SELECT query_id, label, rank, relevant FROM r WHERE rank <= 10), n AS (SELECT label, count(*) - 1 AS n FROM embeddings GROUP BY 1),
g AS (SELECT query_id, sum(CASE WHEN relevant AND rank <= 5 THEN 1 ELSE 0 END) AS hits, min(CASE WHEN relevant THEN rank END) AS first, max(n) AS n FROM k JOIN n USING (label) GROUP BY 1)
SELECT count(*) AS queries, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(hits / nullif(n, 0)), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM g""")
def _metrics(t):
    """The stated query set: every row whose vec_id is divisible by 50, against all rows."""
    return _measured(t("embeddings"), _asked(t("embeddings"), "vec_id % 50 = 0"), retrieval.top_k_in_blocks)


register("rerank", "SELECT vec_id, round(CASE WHEN label = 1 THEN s + abs(s) * 0.15 WHEN label = 2 THEN s - abs(s) * 0.25 ELSE s END, 6) AS adjusted FROM (SELECT vec_id, label, list_inner_product(embedding::DOUBLE[], " + _LIST + ") AS s FROM embeddings)")(
    lambda t: t("embeddings").select("vec_id", "label", retrieval.inner_product(F.col("embedding"), F.array(*map(F.lit, _QUERY))).alias("s")).select("vec_id", F.round(retrieval.reranked(F.col("s"), F.col("label") == 1, F.col("label") == 2), 6).alias("adjusted")))
register("edge_order", "SELECT item_id, CAST(CASE WHEN k % 2 = 1 THEN (k + 1) / 2 ELSE n - k / 2 + 1 END AS BIGINT) AS place FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) AS k, count(*) OVER () AS n FROM benchmark)")(
    lambda t: order.running(t("benchmark").select("item_id", F.lit(1).cast("long").alias("one")), "item_id", "one").crossJoin(F.broadcast(t("benchmark").agg(F.count("*").alias("n")))).select("item_id", retrieval.edge_position(F.col("upto_one"), F.col("n")).alias("place")))

register("paragraphs", r"WITH p AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(text || chr(10) || chr(10) || role, '\n[ \t]*\n'), lambda x: trim(regexp_replace(x, '[ \t\r\n]+', ' ', 'g'))), lambda x: x <> '') AS ps FROM conversations) SELECT conv_id * 1000 + turn AS k, i - 1 AS position, ps[i] AS content FROM p, range(1, CAST(len(ps) + 1 AS BIGINT)) AS t(i)")(
    lambda t: text.paragraphs(t("conversations").selectExpr("conv_id * 1000 + turn AS k", "concat(text, '\n\n', role) AS text"), "k"))
register("topic_role", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'heat' ELSE lower(source) END AS topic, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN 'experiment_scenario' ELSE 'reference' END AS role FROM documents")(
    lambda t: t("documents").select("doc_id", "source", F.expr("CASE WHEN doc_id % 3 = 0 THEN concat('TOPIC: Heat\nROLE: Scenario b\n', text) ELSE text END").alias("x"), F.expr("CASE WHEN doc_id % 5 = 0 THEN 'lab/Experiments/a.txt' ELSE 'ref/a.txt' END").alias("path")).select("doc_id", text.topic(F.col("x"), F.col("source")).alias("topic"), text.role(F.col("x"), F.col("path")).alias("role")))
register("topic_detect", "SELECT item_id, CASE WHEN a AND NOT b THEN 'one' WHEN b AND NOT a THEN 'two' END AS topic FROM (SELECT item_id, regexp_matches(x, '(^|[^a-z0-9_])(of the|and)($|[^a-z0-9_])') AS a, regexp_matches(x, '(^|[^a-z0-9_])(que|les|der)($|[^a-z0-9_])') AS b FROM (SELECT item_id, lower(text) AS x FROM benchmark))")(
    lambda t: t("benchmark").select("item_id", text.detected_topic(F.col("text"), {"one": ["of the", "and"], "two": ["que", "les", "der"]}).alias("topic")))


def _turn_pairs(t):
    """conversations with the text of the turn before; first turns have none"""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return t("conversations").select("conv_id", "turn", F.lag("turn").over(order).alias("last"), F.lag("text").over(order).alias("before"), "text").where("last IS NOT NULL")


TURN_PAIRS = "(SELECT * FROM (SELECT conv_id, turn, lag(turn) OVER w AS last, lag(text) OVER w AS before, text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE last IS NOT NULL)"
_WORDS = "list_distinct(regexp_extract_all(lower({c}), '[a-z]{{4,}}'))"
register("novelty_ratio", f"SELECT conv_id, turn, round(coalesce(len(list_filter(b, lambda x: NOT list_contains(a, x))) / nullif(len(b), 0), 0), 6) AS novelty FROM (SELECT conv_id, turn, {_WORDS.format(c='before')} AS a, {_WORDS.format(c='text')} AS b FROM {TURN_PAIRS})")(
    lambda t: _turn_pairs(t).select("conv_id", "turn", F.round(text.novelty(F.col("before"), F.col("text")), 6).alias("novelty")))
_FACTS = r"list_distinct(list_transform(regexp_extract_all({c}, '-?\d+\.?\d*%?'), lambda x: format('{{:g}}', CAST(rtrim(x, '%') AS DOUBLE)) || CASE WHEN suffix(x, '%') THEN '%' ELSE '' END))"
register("number_fidelity", f"SELECT conv_id, turn, CAST(len(a) AS BIGINT) AS n_facts, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS lost FROM (SELECT conv_id, turn, {_FACTS.format(c='before')} AS a, {_FACTS.format(c='text')} AS b FROM {TURN_PAIRS})")(
    lambda t: _turn_pairs(t).select("conv_id", "turn", F.size(text.numeric_facts(F.col("before"))).cast("long").alias("n_facts"), F.array_join(F.array_sort(text.lost_facts(F.col("before"), F.col("text"))), ",").alias("lost")))
register("token_overlap", f"SELECT conv_id, turn, CAST(len(list_intersect({_WORDS.format(c='before')}, {_WORDS.format(c='text')})) AS BIGINT) AS n_shared FROM {TURN_PAIRS}")(
    lambda t: _turn_pairs(t).select("conv_id", "turn", F.size(text.overlap(F.col("before"), F.col("text"))).cast("long").alias("n_shared")))

# --- domain, folds, identity --------------------------------------------------

register("range_scale", "SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - 1) / 49.0, 6) AS scaled FROM lineitem")(lambda t: t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(domain.scaled(F.col("l_quantity"), 1.0, 50.0), 6).alias("scaled")))
register("one_hot", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_F, CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_O, CASE WHEN o_orderstatus IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_unknown FROM orders")(lambda t: t("orders").select("o_orderkey", *domain.one_hot(F.col("o_orderstatus"), ["F", "O", "unknown"], "is_")))
register("range_warnings", "SELECT p_partkey, CAST((CASE WHEN p_size < 5 OR p_size > 40 THEN 1 ELSE 0 END) + (CASE WHEN p_retailprice < 950 OR p_retailprice > 1500 THEN 1 ELSE 0 END) AS BIGINT) AS n_warnings FROM part")(
    lambda t: t("part").select("p_partkey", F.size(domain.range_warnings({"p_size": (5, 40), "p_retailprice": (950, 1500)})).cast("long").alias("n_warnings")))
register("condition_regex", "SELECT p_partkey, CAST(p_size % 40 AS DOUBLE) AS co, CAST(p_size % 10 AS DOUBLE) AS h2, CAST(p_size AS DOUBLE) AS s, CAST(100 - p_size AS DOUBLE) AS o FROM part")(
    lambda t: t("part").selectExpr("p_partkey", "concat('CO= ', p_size % 40, '%, H2=', p_size % 10, '% & N2=60%') AS a", "concat('S1-', p_size, '%+O1-', 100 - p_size, '%') AS b").select("p_partkey", domain.gas(F.col("a"), "CO").alias("co"), domain.gas(F.col("a"), "H2").alias("h2"), domain.burden(F.col("b"), "S").alias("s"), domain.burden(F.col("b"), "O").alias("o")))
register("regime_group_stats", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS n FROM events GROUP BY 1")(lambda t: learning.regimes(t("events"), "event_type", "value"))
register("cv_folds_timeseries", "SELECT event_id, greatest(0, 5 - floor((n - k) / floor(n / 6)))::BIGINT AS fold FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k, count(*) OVER () AS n FROM events)")(lambda t: evaluate.time_folds(t("events"), "event_id"))
register("cv_metrics", "SELECT round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - avg(e * e) / var_pop(y), 6) AS r2 FROM (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 1500 AS e FROM lineitem)")(lambda t: evaluate.regression_metrics(t("lineitem").selectExpr("l_extendedprice AS y", "l_quantity * 1500 AS guess"), "y", "guess"))
register("hash_dedupe", "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")(lambda t: catalogue.by_content(t("documents"), "doc_id", F.encode("text", "UTF-8")))
_ENTRIES = "SELECT 'd/' || doc_id AS path, sha256(text) AS content_hash FROM documents WHERE doc_id % 10 <> 0"
_FILES = "SELECT 'd/' || doc_id AS path, sha256(CASE WHEN doc_id % 10 = 1 THEN text || '!' ELSE text END) AS content_hash FROM documents WHERE doc_id % 10 <> 2"


def _entries(t):
    return t("documents").where("doc_id % 10 <> 0").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), catalogue.content_hash(F.encode("text", "UTF-8")).alias("content_hash"))


def _files(t):
    changed = F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return t("documents").where("doc_id % 10 <> 2").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), catalogue.content_hash(F.encode(changed, "UTF-8")).alias("content_hash"))


register("reconcile", f"SELECT coalesce(e.path, f.path) AS path, CASE WHEN f.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'orphan' WHEN e.content_hash <> f.content_hash THEN 'hash_mismatch' ELSE 'ok' END AS state FROM ({_ENTRIES}) e FULL JOIN ({_FILES}) f ON e.path = f.path")(lambda t: catalogue.reconciled(_entries(t), _files(t)))
register("unreferenced", f"SELECT path AS resource_id, content_hash FROM ({_ENTRIES}) WHERE path NOT IN (SELECT 'd/' || doc_id FROM labels)")(lambda t: catalogue.unreferenced(_entries(t).withColumnRenamed("path", "resource_id"), t("labels").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("resource_id"))))
_KNOWN = "SELECT CASE WHEN doc_id % 2 = 0 THEN 'table' ELSE 'document' END AS source_type, sha256(text) AS content_hash FROM documents WHERE doc_id % 3 = 0"
register("find_duplicate", f"WITH k AS ({_KNOWN}), i AS (SELECT doc_id, 'document' AS source_type, sha256(text) AS content_hash FROM documents) SELECT doc_id, source_type, content_hash, CASE WHEN (source_type, content_hash) IN (SELECT (source_type, content_hash) FROM k) THEN 'known' WHEN content_hash IN (SELECT content_hash FROM k) THEN 'type_conflict' ELSE 'new' END AS status, CASE WHEN (source_type, content_hash) IN (SELECT (source_type, content_hash) FROM k) THEN 'use_existing' WHEN content_hash IN (SELECT content_hash FROM k) THEN 'review' ELSE 'register' END AS action FROM i")(
    lambda t: catalogue.duplicates(t("documents").where("doc_id % 3 = 0").select(F.expr("CASE WHEN doc_id % 2 = 0 THEN 'table' ELSE 'document' END").alias("source_type"), catalogue.content_hash(F.encode("text", "UTF-8")).alias("content_hash")), t("documents").select("doc_id", F.lit("document").alias("source_type"), catalogue.content_hash(F.encode("text", "UTF-8")).alias("content_hash"))))
register("resource_ids", "SELECT item_id, sha256('document' || chr(0) || text) AS resource_id FROM benchmark")(lambda t: t("benchmark").select("item_id", catalogue.resource_id(F.lit("document"), F.encode("text", "UTF-8")).alias("resource_id")))
_LOG = "SELECT CAST(user_id AS VARCHAR) AS resource_id, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'registered' WHEN 1 THEN 'normalized' ELSE 'indexed' END AS state FROM events"
register("source_states", f"SELECT resource_id, arg_max(state, seq) AS before, 'indexed' AS wanted, arg_max(state, seq) = 'normalized' AS allowed FROM ({_LOG}) GROUP BY 1")(
    lambda t: catalogue.allowed(t("events").selectExpr("CAST(user_id AS STRING) AS resource_id", "event_id AS seq", "CASE event_id % 3 WHEN 0 THEN 'registered' WHEN 1 THEN 'normalized' ELSE 'indexed' END AS state"), t("events").selectExpr("CAST(user_id AS STRING) AS resource_id", "'indexed' AS state").distinct()))
register("energy_times", "SELECT event_id, ts AS datetime FROM (SELECT event_id, date_trunc('minute', ts) AS ts FROM events)")(lambda t: loaders.with_time(t("events").select("event_id", F.date_format("ts", "dd/MM/yyyy HH:mm").alias("date"))).select("event_id", "datetime"))

from . import analysis_queries, answer_queries, cleaning_queries, domain_queries, gap_queries, learning_queries, text_queries  # noqa: E402, F401  they register themselves
