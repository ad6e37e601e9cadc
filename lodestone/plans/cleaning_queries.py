"""Registered queries of the cleaning workflow: issues, proposals, decisions, changes,
validation and impact, over orders with planted faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, controlled
from .catalog import EVENTS, _planted, _r, register

register("imputation_confidence_text", "WITH c AS (SELECT count(*) AS n FROM " + EVENTS + " WHERE event_type IS NOT NULL GROUP BY event_type), p AS (SELECT n / (SELECT sum(n) FROM c) AS p FROM c), e AS (SELECT round(-sum(p * ln(p)) / ln(count(*)), 6) AS e FROM p) SELECT round(0.30 * least(0.95, count(event_type) / count(*)) + 0.25 * least(1.0, count(event_type) / 30) + 0.25 * (1 - any_value(e)) + 0.20, 6) AS confidence FROM " + EVENTS + ", e")(
    lambda t: cleaning.imputation_confidence(_planted(t), "event_type"))

_SIDES = ", ".join(f"avg(CASE WHEN value IS NULL THEN {c} END) m1{c}, avg(CASE WHEN value IS NOT NULL THEN {c} END) m2{c}, var_samp(CASE WHEN value IS NULL THEN {c} END) v1{c}, var_samp(CASE WHEN value IS NOT NULL THEN {c} END) v2{c}" for c in ("event_id", "user_id"))
_EFFECT = "round(least(1.0, abs(m1{c} - m2{c}) / sqrt(((n1 - 1) * v1{c} + (n2 - 1) * v2{c}) / (n1 + n2 - 2)) / 3.0), 6)"
register("missingness_association", f"""WITH s AS (SELECT count(CASE WHEN value IS NULL THEN 1 END) n1, count(CASE WHEN value IS NOT NULL THEN 1 END) n2, {_SIDES} FROM {EVENTS}),
t AS (SELECT value IS NULL AS a, event_type AS b, count(*) o FROM {EVENTS} WHERE event_type IS NOT NULL GROUP BY 1, 2), m AS (SELECT o, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e, sum(o) OVER () AS n FROM t),
f AS (SELECT 0 AS k, 'event_id' AS name, 'effect_size' AS method, {_EFFECT.format(c="event_id")} AS effect FROM s UNION ALL SELECT 1, 'user_id', 'effect_size', {_EFFECT.format(c="user_id")} FROM s UNION ALL SELECT 2, 'event_type', 'cramers_v', round(sqrt(sum((o - e) * (o - e) / e) / any_value(n)), 6) FROM m)
SELECT round(max(effect), 4) AS max_association, (SELECT name FROM f ORDER BY effect DESC, k LIMIT 1) AS associated_column, (SELECT method FROM f ORDER BY effect DESC, k LIMIT 1) AS association_method, count(*) AS columns_compared, CAST(0 AS BIGINT) AS columns_skipped FROM f""")(
    lambda t: cleaning.missingness_association(_planted(t).select("event_id", "user_id", "event_type", "value"), "value"))

_FAR = """WITH f AS (SELECT quantile_cont(n_chars, 0.25) AS q1, median(n_chars) AS med, quantile_cont(n_chars, 0.75) AS q3 FROM documents), m AS (SELECT 1.4826 * median(abs(n_chars - med)) AS mad FROM documents, f),
o AS (SELECT doc_id, n_chars, CASE WHEN n_chars < q1 - 1.5 * (q3 - q1) THEN (q1 - 1.5 * (q3 - q1) - n_chars) / (q3 - q1) WHEN n_chars > q3 + 1.5 * (q3 - q1) THEN (n_chars - q3 - 1.5 * (q3 - q1)) / (q3 - q1) END AS d, abs(n_chars - med) / mad AS z FROM documents, f, m) """
register("outlier_confidence", _FAR + """SELECT count(d) AS flagged_count, round(avg(round(d, 4)), 4) AS mean_iqr_distance, count(CASE WHEN z > 3 THEN 1 END) AS mad_flagged_count, count(CASE WHEN d IS NOT NULL AND z > 3 THEN 1 END) AS agreement_count,
round(avg(CASE WHEN d IS NOT NULL THEN least(0.95, least(0.95, greatest(0.5, 0.5 + 0.1 * d)) + CASE WHEN z > 3 THEN 0.05 ELSE 0 END) END), 4) AS confidence, round(count(CASE WHEN d IS NOT NULL AND z > 3 THEN 1 END) / count(d), 4) AS agreement_rate FROM o""")(lambda t: cleaning.outlier_confidence(t("documents"), "n_chars"))
register("outlier_details", _FAR + "SELECT doc_id AS row_id, n_chars AS value, round(d, 4) AS distance, round(z, 4) AS z, z > 3 AS agrees FROM o WHERE d IS NOT NULL ORDER BY doc_id LIMIT 20")(lambda t: cleaning.outlier_details(t("documents"), "n_chars", "doc_id"))
register("modified_z", _FAR + "SELECT doc_id, round(z, 4) AS z FROM o")(lambda t: cleaning.modified_z(t("documents").select("doc_id", "n_chars"), "n_chars").select("doc_id", F.round("z", 4).alias("z")))

#: orders with repeated rows, gaps, a conflicting identifier, texts that mix numbers, and outliers
_DIRTY = [
    "o_orderkey AS line", "CAST(o_orderkey - o_orderkey % 3 AS BIGINT) AS record_id",
    "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN CAST(10000000 AS DOUBLE) ELSE CAST((o_orderkey - o_orderkey % 3) % 100 AS DOUBLE) END AS price",
    "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 50 = 7 THEN '12' ELSE o_orderstatus END AS state",
]
DIRTY = "(SELECT " + ", ".join(_DIRTY) + " FROM orders)"
_APPROVED = ["remove_duplicate_rows", "impute_price", "impute_state"]
_FILLED = f"""(SELECT line, record_id, coalesce(price, (SELECT median(price) FROM {DIRTY})) AS price, coalesce(state, (SELECT state FROM {DIRTY} WHERE state IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS state
FROM (SELECT *, row_number() OVER (PARTITION BY record_id, price, state ORDER BY line) AS k FROM {DIRTY}) WHERE k = 1)"""


def _dirty(t):
    return t("orders").selectExpr(*_DIRTY)


def _issues(t):
    """The SQL of the issues of a table with the columns of DIRTY."""
    repeated = f"(SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT record_id, price, state FROM {t}))"
    gaps = " UNION ALL ".join(f"SELECT 'missing_{c}', 'missing_values', '{c}', count(*), 'Column ''{c}'' has ' || count(*) || ' missing value(s).' FROM {t} WHERE {c} IS NULL" for c in ("record_id", "price", "state"))
    unusual = " UNION ALL ".join(f"SELECT 'unusual:{c}', 'statistical_outliers', '{c}', count(*), count(*) || ' observation(s) are potentially unusual under the IQR rule.' FROM {t}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t}) WHERE q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))" for c in ("record_id", "price"))
    return f"""(SELECT * FROM (SELECT 'duplicate_rows' AS issue_id, 'duplicate_rows' AS kind, NULL AS field, n, n || ' duplicate row(s) can be reviewed.' AS message FROM (SELECT {repeated} AS n)
UNION ALL SELECT 'conflicting_identifier_record_id', 'duplicate_identifier', 'record_id', CASE WHEN k > {repeated} THEN k ELSE 0 END, 'Candidate identifier ''record_id'' has repeated values across non-exact duplicate rows.' FROM (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS k FROM (SELECT count(*) AS n FROM {t} GROUP BY record_id) WHERE n > 1)
UNION ALL {gaps} UNION ALL SELECT 'mixed_values_state', 'mixed_values', 'state', CASE WHEN p < n THEN p ELSE 0 END, 'Column ''state'' mixes numeric-like and non-numeric values.' FROM (SELECT count(state) AS n, count(CASE WHEN state = '12' THEN 1 END) AS p FROM {t})
UNION ALL {unusual}) WHERE n > 0)"""


register("cleaning_issues", f"SELECT * FROM {_issues(DIRTY)}")(lambda t: cleaning.issues(_dirty(t), "line"))
register("cleaning_proposals", f"""SELECT proposal_id, issue_id, action, field, method, CASE WHEN method = 'median' THEN m END AS number, CASE WHEN method = 'mode' THEN s END AS text
FROM (VALUES ('remove_duplicate_rows', 'duplicate_rows', 'remove_duplicates', NULL, 'keep_first'), ('impute_price', 'missing_price', 'impute_missing', 'price', 'median'), ('impute_state', 'missing_state', 'impute_missing', 'state', 'mode'), ('investigate_price_outliers', 'unusual:price', 'flag_for_review', 'price', 'flag')) AS t(proposal_id, issue_id, action, field, method),
(SELECT round(median(price), 6) AS m FROM {DIRTY}), (SELECT state AS s FROM {DIRTY} WHERE state IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) WHERE issue_id IN (SELECT issue_id FROM {_issues(DIRTY)})""")(
    lambda t: cleaning.proposals(_dirty(t), "line").drop("confidence", "rationale"))
register("cleaned_table", f"SELECT line, record_id, round(price, 6) AS price, state FROM {_FILLED}")(lambda t: _r(cleaning.apply_cleaning(_dirty(t), "line", _APPROVED)[0], "price"))
register("change_records", f"""SELECT 'remove_duplicate_rows' AS proposal_id, 'duplicate_rows' AS issue_id, line AS row_id, NULL AS field FROM (SELECT *, row_number() OVER (PARTITION BY record_id, price, state ORDER BY line) AS k FROM {DIRTY}) WHERE k > 1
UNION ALL SELECT 'impute_price', 'missing_price', line, 'price' FROM {DIRTY} WHERE price IS NULL UNION ALL SELECT 'impute_state', 'missing_state', line, 'state' FROM {DIRTY} WHERE state IS NULL""")(
    lambda t: cleaning.apply_cleaning(_dirty(t), "line", _APPROVED)[1].select("proposal_id", "issue_id", "row_id", "field"))


def _decided(t):
    spark = t("region").sparkSession
    proposed = spark.createDataFrame([("remove_duplicate_rows", "duplicate_rows"), ("impute_price", "missing_price"), ("impute_state", "missing_state"), ("investigate_price_outliers", "unusual:price")], "proposal_id string, issue_id string")
    said = [("remove_duplicate_rows", "REJECT"), ("remove_duplicate_rows", "APPROVE"), ("impute_price", "DEFER"), ("impute_state", "REJECT")]
    return cleaning.statuses(proposed, spark.createDataFrame(said, "proposal_id string, action string"))


register("unresolved_issues", f"SELECT issue_id, kind, field, n FROM {_issues(DIRTY)} WHERE issue_id <> 'duplicate_rows'")(lambda t: cleaning.unresolved(cleaning.issues(_dirty(t), "line"), _decided(t)).drop("message"))
_NEW = f"(SELECT line, record_id, price, CASE WHEN line % 4 = 0 THEN NULL ELSE state END AS state FROM {DIRTY} WHERE state IS NOT NULL AND state <> '12')"
_OLD = f"(SELECT line, record_id, price, state FROM {DIRTY} WHERE state IS NOT NULL AND state <> '12')"
register("validation_new_issues", f"""SELECT a.kind, a.field, 'New issue after cleaning — ' || a.kind || ' in ' || CASE WHEN a.field IS NULL THEN 'dataset' ELSE chr(39) || a.field || chr(39) END || ': ' || a.message AS message
FROM {_issues(_NEW)} a WHERE NOT EXISTS (SELECT 1 FROM {_issues(_OLD)} b WHERE b.kind = a.kind AND b.field IS NOT DISTINCT FROM a.field)""")(
    lambda t: cleaning.new_issues(_dirty(t).where("state <> '12'"), _dirty(t).where("state <> '12'").withColumn("state", F.expr("CASE WHEN line % 4 <> 0 THEN state END")), "line"))
register("quality_snapshot", f"SELECT count(*) AS row_count, CAST(3 AS BIGINT) AS column_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT record_id, price, state FROM {DIRTY})) AS duplicate_rows, CAST(sum(CASE WHEN price IS NULL THEN 1 ELSE 0 END + CASE WHEN state IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM {DIRTY}")(lambda t: cleaning.snapshot(_dirty(t), "line"))

def _shift_sql(b, a):
    """The SQL of the shifts of price and state from one table to another."""
    ks = f"WITH u AS (SELECT v, sum(a) a, sum(b) b FROM (SELECT price v, 1 a, 0 b FROM {b} WHERE price IS NOT NULL UNION ALL SELECT price, 0, 1 FROM {a}) GROUP BY v) SELECT round(max(d), 4) FROM (SELECT abs(sum(a) OVER (ORDER BY v) / (SELECT sum(a) FROM u) - sum(b) OVER (ORDER BY v) / (SELECT sum(b) FROM u)) AS d FROM u)"
    tvd = f"WITH x AS (SELECT state v, count(*) / sum(count(*)) OVER () AS p FROM {b} WHERE state IS NOT NULL GROUP BY 1), y AS (SELECT state v, count(*) / sum(count(*)) OVER () AS r FROM {a} WHERE state IS NOT NULL GROUP BY 1) SELECT round(sum(abs(coalesce(p, 0) - coalesce(r, 0))) / 2, 4) FROM x FULL JOIN y USING (v)"
    return f"""SELECT 'price' AS column_name, 'numeric' AS kind, (SELECT count(price) FROM {b}) AS n_before, (SELECT count(price) FROM {a}) AS n_after, round(m1 - m0, 4) AS mean_shift, round(s0, 4) AS std_before, round(s1 - s0, 4) AS std_shift, ({ks}) AS ks, NULL::DOUBLE AS tvd FROM (SELECT avg(price) m0, stddev_samp(price) s0 FROM {b}), (SELECT avg(price) m1, stddev_samp(price) s1 FROM {a})
UNION ALL SELECT 'state', 'categorical', (SELECT count(state) FROM {b}), (SELECT count(state) FROM {a}), NULL, NULL, NULL, NULL, ({tvd})"""


register("distribution_shifts", _shift_sql(DIRTY, _FILLED))(lambda t: cleaning.shifts(_dirty(t), cleaning.apply_cleaning(_dirty(t), "line", _APPROVED)[0], ["price", "state"]).drop("added", "removed"))
_HALF = f"(SELECT price * 2 AS price, CASE WHEN state = 'O' THEN 'F' ELSE state END AS state FROM {DIRTY} WHERE line % 2 = 0)"


def _noted(t):
    after = _dirty(t).where("line % 2 = 0").selectExpr("line", "price * 2 AS price", "CASE WHEN state = 'O' THEN 'F' ELSE state END AS state")
    changed = t("region").sparkSession.createDataFrame([("price",), ("state",), (None,)], "field string")
    return cleaning.loss_notes(cleaning.shifts(_dirty(t), after, ["price", "state"]), changed)


register("loss_notes", f"""WITH s AS ({_shift_sql(DIRTY, _HALF)}), n AS (SELECT *, chr(39) || column_name || chr(39) || ': ' AS q FROM s) SELECT column_name, q || 'standard deviation changed by ' || round(abs(std_shift / std_before) * 100, 1) || '% after cleaning' AS note FROM n WHERE abs(std_shift / std_before) > 0.1
UNION ALL SELECT column_name, q || 'sample size reduced from ' || n_before || ' to ' || n_after || ' due to row removal' FROM n WHERE kind = 'numeric' AND n_after < n_before UNION ALL SELECT column_name, q || 'category distribution shifted with Total Variation Distance ' || printf('%.4f', tvd) FROM n WHERE tvd > 0.15""")(_noted)
_CATEGORY = "CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN 'tap' WHEN event_type = 'error' THEN 'fault' ELSE event_type END"
register("category_difference", f"""WITH b AS (SELECT DISTINCT event_type AS v FROM events WHERE event_type IS NOT NULL), a AS (SELECT DISTINCT {_CATEGORY} AS v FROM events WHERE event_type IS NOT NULL)
SELECT (SELECT coalesce(string_agg(v, ',' ORDER BY v), '') FROM a WHERE v NOT IN (SELECT v FROM b)) AS added, (SELECT coalesce(string_agg(v, ',' ORDER BY v), '') FROM b WHERE v NOT IN (SELECT v FROM a)) AS removed""")(
    lambda t: cleaning.category_shift(t("events"), t("events").withColumn("event_type", F.expr(_CATEGORY)), "event_type").select(*(F.array_join(c, ",").alias(c) for c in ("added", "removed"))))

# --- whole records, rows of issues, cleaning as one call ----------------------------

_GONE = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id, price, state ORDER BY line) AS k FROM {DIRTY}) WHERE k > 1)"
_MODE = f"(SELECT state FROM {DIRTY} WHERE state IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_WHY = {c: cleaning.why_impute(c, m).replace("'", "''") for c, m in (("price", "median"), ("state", "mode"))}
register("change_records_whole", f"""SELECT 'remove_duplicate_rows' AS proposal_id, 'duplicate_rows' AS issue_id, line AS row_id, NULL AS field, record_id AS before_id, state AS before_state, price AS before_price, NULL AS after_number, NULL AS after_text, '{cleaning.WHY_REMOVE}' AS reason FROM {_GONE}
UNION ALL SELECT 'impute_price', 'missing_price', line, 'price', NULL, NULL, NULL, (SELECT median(price) FROM {DIRTY}), NULL, '{_WHY['price']}' FROM {DIRTY} WHERE price IS NULL
UNION ALL SELECT 'impute_state', 'missing_state', line, 'state', NULL, NULL, NULL, NULL, {_MODE}, '{_WHY['state']}' FROM {DIRTY} WHERE state IS NULL""")(
    lambda t: cleaning.apply_cleaning(_dirty(t), "line", _APPROVED)[1].select(
        "proposal_id", "issue_id", "row_id", "field", F.get_json_object("before", "$.record_id").cast("long").alias("before_id"), F.get_json_object("before", "$.state").alias("before_state"), F.get_json_object("before", "$.price").cast("double").alias("before_price"),
        F.when(F.col("field") == "price", F.col("after").cast("double")).alias("after_number"), F.when(F.col("field") == "state", F.col("after")).alias("after_text"), "reason"))
register("issue_rows", f"""WITH r AS (SELECT 'duplicate_rows' AS issue_id, line AS row_id FROM {_GONE} UNION ALL SELECT 'conflicting_identifier_record_id', line FROM {DIRTY} WHERE record_id IN (SELECT record_id FROM {DIRTY} GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'missing_price', line FROM {DIRTY} WHERE price IS NULL UNION ALL SELECT 'missing_state', line FROM {DIRTY} WHERE state IS NULL
UNION ALL SELECT 'unusual:price', line FROM {DIRTY}, (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM {DIRTY}) WHERE q3 > q1 AND (price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)))
SELECT * FROM r WHERE issue_id IN (SELECT issue_id FROM {_issues(DIRTY)})""")(lambda t: cleaning.issue_rows(_dirty(t), "line"))
_AGAIN = "SELECT event_id % 3 AS nth, 'c' || event_id % 40 AS subject FROM events GROUP BY 1, 2"
register("outlier_issues", f"""WITH f AS (SELECT CASE nth WHEN 0 THEN 'outliers_' WHEN 1 THEN 'spread:' ELSE 'unusual:' END || subject AS finding_id, CASE WHEN nth = 1 THEN 'shape' ELSE 'distribution' END AS category, subject, 'seen' AS observation FROM ({_AGAIN})),
n AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY finding_id) - 1 AS k FROM f WHERE category = 'distribution'), s AS (SELECT *, CASE WHEN k = 0 THEN '' ELSE '_' || k END AS x FROM n)
SELECT finding_id || x AS issue_id, 'investigate_' || subject || '_outliers' || x AS proposal_id, 'statistical_outliers' AS kind, subject AS field, observation AS message, 'IQR' AS method FROM s""")(
    lambda t: cleaning.outlier_issues(t("events").selectExpr("event_id % 3 AS nth", "concat('c', event_id % 40) AS subject").distinct().selectExpr("concat(CASE nth WHEN 0 THEN 'outliers_' WHEN 1 THEN 'spread:' ELSE 'unusual:' END, subject) AS finding_id", "CASE WHEN nth = 1 THEN 'shape' ELSE 'distribution' END AS category", "subject", "'seen' AS observation", "'IQR' AS method")))

#: Decisions as people give them, one for each event: the last word of no one counts, approvals win.
_SPOKEN = {0: "remove_duplicate_rows", 1: "impute_price", 2: "impute_state", 3: "investigate_price_outliers", 4: "unheard"}
_ACT = "CASE WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'approve' ELSE 'REJECT' END WHEN event_id % 5 = 1 THEN 'DEFER' WHEN event_id % 5 = 2 THEN 'APPROVE' WHEN event_id % 5 = 4 THEN 'REJECT' END"
_WHO = "CASE event_id % 5 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _SPOKEN.items()) + " END"


def _spoken(t):
    return t("events").selectExpr(f"{_WHO} AS proposal_id", f"{_ACT} AS action").where("action is not null")


register("decision_status", f"""SELECT p.*, coalesce(list_extract(['approved', 'rejected', 'deferred'], d.place), 'proposed') AS status FROM (VALUES ('remove_duplicate_rows', 'duplicate_rows'), ('impute_price', 'missing_price'), ('impute_state', 'missing_state'), ('investigate_price_outliers', 'unusual:price')) AS p(proposal_id, issue_id)
LEFT JOIN (SELECT {_WHO} AS proposal_id, min(list_position(['APPROVE', 'REJECT', 'DEFER'], upper({_ACT}))) AS place FROM events WHERE {_ACT} IS NOT NULL GROUP BY 1) d USING (proposal_id)""")(
    lambda t: cleaning.statuses(cleaning.proposals(_dirty(t), "line").select("proposal_id", "issue_id"), _spoken(t)))


def _cleaned(t):
    from ..shared import new_folder

    df = _dirty(t)
    return controlled.report(controlled.clean(df, "line", _spoken(t), new_folder(df.sparkSession, "cleaning")))


_HALFWAY = f"""(SELECT line, record_id, price, coalesce(state, {_MODE}) AS state FROM (SELECT *, row_number() OVER (PARTITION BY record_id, price, state ORDER BY line) AS k FROM {DIRTY}) WHERE k = 1)"""
_SIZES = " UNION ALL ".join(f"SELECT 'missing_{phase}', '{c}', (count(*) - count({c})) || ' of ' || count(*) FROM {table}" for phase, table in (("before", DIRTY), ("after", _HALFWAY)) for c in ("record_id", "price", "state"))
register("cleaning_call", f"""SELECT section, name, value FROM (VALUES ('proposal', 'remove_duplicate_rows', 'approved'), ('proposal', 'impute_price', 'deferred'), ('proposal', 'impute_state', 'approved'), ('proposal', 'investigate_price_outliers', 'proposed'), ('addressed', '', 'duplicate_rows'), ('addressed', '', 'missing_state'),
('limitation', '', '{controlled.RECHECKED}'), ('limitation', '', '{controlled.APPROXIMATE}')) AS v(section, name, value)
UNION ALL SELECT 'unresolved', issue_id, kind FROM {_issues(DIRTY)} WHERE issue_id NOT IN ('duplicate_rows', 'missing_state')
UNION ALL SELECT 'introduced', '', 'New issue after cleaning — ' || a.kind || ' in ' || CASE WHEN a.field IS NULL THEN 'dataset' ELSE chr(39) || a.field || chr(39) END || ': ' || a.message FROM {_issues(_HALFWAY)} a WHERE NOT EXISTS (SELECT 1 FROM {_issues(DIRTY)} b WHERE b.kind = a.kind AND b.field IS NOT DISTINCT FROM a.field)
UNION ALL SELECT 'row_count_diff', '', CAST((SELECT count(*) FROM {_HALFWAY}) - (SELECT count(*) FROM {DIRTY}) AS VARCHAR) UNION ALL {_SIZES}
UNION ALL SELECT 'changes', 'remove_duplicate_rows', CAST(count(*) AS VARCHAR) FROM {_GONE} UNION ALL SELECT 'changes', 'impute_state', CAST(count(*) AS VARCHAR) FROM {DIRTY} WHERE state IS NULL""")(_cleaned)
